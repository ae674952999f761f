"""A directory tree as a stream of changes: ``spark.readStream.format("tree_changes").option("path", root).option("state", folder).load()``.

An offset is the number of a listing (path -> size, mtime_ns) that is kept in the ``state`` folder, so a batch is the difference of two
listings and the same after a restart: added and modified files with their text, removed ones without. A new listing is made when Spark
asks for the latest offset; the tree's unchanged files are not read. Listings before the last committed one are deleted. Rows are those of
`streaming.feed.CHANGES`, their revision is the listing's number: ``feed.follow(changes_of(...), ...)`` keeps an index in step with a tree.

Defined cases: a file that vanished or changed again before it is read gives what is there now (nothing: a removal), and the next listing
tells the rest; binary and oversize files come with a null text; hidden names and ignore rules are as in `sources.tree`. Listing is the
driver's work (names and times only); the root and the state folder must be visible to the driver and the executors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import invalid
from .tree import FILES, MOST_CONTENT, TreeReader, _shown

CHANGES = "revision long, path string, event string, text string"


class Changed(InputPartition):
    """(path, event) of some files."""

    def __init__(self, revision: int, files: list[tuple[str, str]]):
        self.value = (revision, files)


class ChangeReader(DataSourceStreamReader):
    def __init__(self, options):
        self.tree = TreeReader({**dict(options), "content": "false"})
        self.most = int(options.get("maxBytes", MOST_CONTENT))
        if not options.get("state"):
            raise invalid("a stream of changes needs a state folder")
        self.state = options["state"].removeprefix("file://")
        os.makedirs(self.state, exist_ok=True)

    def _file(self, n: int) -> str:
        return os.path.join(self.state, f"listing-{n}.json")

    def _listing(self, n: int) -> dict[str, list[int]]:
        if n == 0:
            return {}
        with open(self._file(n)) as f:
            return json.load(f)

    def _newest(self) -> int:
        return max((int(f[8:-5]) for f in os.listdir(self.state) if f.startswith("listing-") and f.endswith(".json")), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        n = self._newest()
        now = {r[1]: [r[6], r[7]] for p in self.tree.partitions() for r in self.tree.read(p) if r[3] == "file"}
        if now == self._listing(n):
            return {"listing": n}
        temp = self._file(n + 1) + ".new"
        with open(temp, "w") as f:
            json.dump(now, f)
        os.replace(temp, self._file(n + 1))
        return {"listing": n + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = self._listing(start["listing"]), self._listing(end["listing"])
        files = [(p, "add" if p not in before else "modify") for p, st in after.items() if before.get(p) != st] + [(p, "remove") for p in before if p not in after]
        files.sort()
        return [Changed(end["listing"], files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        revision, files = partition.value
        for path, event in files:
            data = None
            if event != "remove":
                try:
                    with open(os.path.join(self.tree.root, path), "rb") as f:
                        data = f.read(self.most + 1)
                except FileNotFoundError:
                    event = "remove"
            plain = data is not None and len(data) <= self.most and b"\x00" not in data[:8192]
            yield revision, _shown(path), event, data.decode("utf-8", "replace") if plain else None

    def commit(self, end: dict) -> None:
        for f in os.listdir(self.state):
            if f.startswith("listing-") and f.endswith(".json") and int(f[8:-5]) < end["listing"]:
                os.unlink(os.path.join(self.state, f))


class TreeChanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options)


def changes_of(spark: SparkSession, root: str, state: str, **options) -> DataFrame:
    """Stream of the changes of a tree."""
    spark.dataSource.register(TreeChanges)
    reader = spark.readStream.format("tree_changes").option("path", root).option("state", state)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()
