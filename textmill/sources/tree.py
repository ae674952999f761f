"""A directory tree as a Spark data source, hidden and underscore names included (the built-in readers drop those).

``spark.read.format("tree").option("path", root).load()``: rel_path, name, kind (file, dir, symlink), is_hidden, ignored, size,
mtime_ns, content (files up to ``maxBytes``). Options: hidden, respectIgnore, followSymlinks, content, maxBytes. The driver lists
folders from the root down until there are FOLDERS of them; each of those is a partition, files above them are dealt FILES to
one. The root must be visible to the driver and the executors (a shared mount).

Filters on rel_path (equal, in a list, a prefix), kind, is_hidden and size reach the source by `pruned`: folders that cannot hold a match
are not listed and files that do not match are not read. Spark still applies every filter to the rows. `walk` lists whole trees with
exact links and budget.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, Not, StringStartsWith

from ..dialect import ignore_rules, ignored
from ..errors import CorpusError, invalid

SCHEMA = "path string, rel_path string, name string, kind string, is_hidden boolean, ignored boolean, size long, mtime_ns long, content binary"
MOST_ENTRIES, MOST_PATH_BYTES, MOST_IGNORE_BYTES = 1_000_000, 256 << 20, 16 << 20
MOST_CONTENT = 16 << 20


def load_rules(root: str) -> list[tuple[str, bool, bool]]:
    """Rules of the root's .ignore and .rgignore, which must be regular files."""
    rules, total = [], 0
    for name in (".ignore", ".rgignore"):
        path = os.path.join(root, name)
        if os.path.lexists(path):
            st = os.stat(path)
            total += st.st_size
            if not stat.S_ISREG(st.st_mode) or total > MOST_IGNORE_BYTES:
                raise invalid("ignore rules must be regular files of 16 MiB at most", path=path)
            with open(path, encoding="utf-8", errors="replace") as f:
                rules += ignore_rules(f.read())
    return rules


#: Folders to split a tree into, and entries that share a partition.
FOLDERS, FILES = 64, 500


def _shown(s: str) -> str:
    """A name as text: bytes that are no UTF-8 are replaced."""
    return s.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


class Entries(InputPartition):
    """Relative paths, each with whether what lies below it belongs to this partition too."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.value = entries


class TreeReader(DataSourceReader):
    def __init__(self, options):
        flag = lambda k, default: str(options.get(k, default)).lower() == "true"
        self.root = options.get("path") or options.get("root")
        if not self.root:
            raise invalid("the tree source needs a path")
        self.root = os.path.realpath(self.root.removeprefix("file://"))
        if not os.path.isdir(self.root):
            raise CorpusError("notFound", "no such folder", path=self.root)
        self.hidden, self.respect = flag("hidden", "true"), flag("respectIgnore", "true")
        self.follow, self.content = flag("followSymlinks", "false"), flag("content", "true")
        self.most = int(options.get("maxBytes", MOST_CONTENT))
        #: What pushed filters leave: kinds, sizes from and to, whole paths, prefixes of paths.
        self.kinds, self.sizes, self.paths, self.prefixes = None, [0, None], None, []

    def _between(self, low: int, high: int | None) -> None:
        self.sizes[0] = max(self.sizes[0], low)
        if high is not None:
            self.sizes[1] = high if self.sizes[1] is None else min(self.sizes[1], high)

    def _may_hold(self, rel: str) -> bool:
        """Whether an entry below the folder can match the filters on paths."""
        below = rel + "/"
        return all(p.startswith(below) or below.startswith(p) for p in self.prefixes) and (self.paths is None or any(p.startswith(below) for p in self.paths))

    def _wanted(self, rel: str, kind: str, size: int) -> bool:
        return (
            (self.kinds is None or kind in self.kinds)
            and (self.paths is None or rel in self.paths)
            and all(rel.startswith(p) for p in self.prefixes)
            and size >= self.sizes[0]
            and (self.sizes[1] is None or size <= self.sizes[1])
        )

    def partitions(self) -> list[InputPartition]:
        rules = load_rules(self.root) if self.respect else []
        names, single, folders = sorted(os.listdir(self.root)), [], []
        while True:
            below = []
            for rel in names:
                path = os.path.join(self.root, rel)
                folder = os.path.isdir(path) and not os.path.islink(path)
                (below if folder else single).append(rel)
            folders += below
            if not folders or len(folders) >= FOLDERS:
                break
            names = []
            for rel in folders:
                single.append(rel)
                hidden = any(p.startswith(".") for p in rel.split("/"))
                if not (hidden and not self.hidden or ignored(rules, rel, True)) and self._may_hold(rel):
                    names += [f"{rel}/{n}" for n in sorted(os.listdir(os.path.join(self.root, rel)))]
            folders = []
        shallow = [Entries([(r, os.path.islink(os.path.join(self.root, r))) for r in single[k : k + FILES]]) for k in range(0, len(single), FILES)]
        return shallow + [Entries([(f, True)]) for f in folders]

    def _entry(self, rel: str, rules) -> tuple[bool, tuple] | None:
        """(whether the pushed filters want it, its row); content is read only then."""
        path = os.path.join(self.root, rel)
        st = os.lstat(path)
        kind = "symlink" if stat.S_ISLNK(st.st_mode) else "dir" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
        if kind == "symlink" and self.follow and os.path.exists(path):
            st = os.stat(path)
            kind = "dir" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
        if kind is None:
            return None
        is_hidden = any(p.startswith(".") for p in rel.split("/"))
        dropped = self.respect and ignored(rules, rel, kind == "dir")
        data, size = None, st.st_size if kind == "file" else 0
        wanted = self._wanted(_shown(rel), kind, size)
        if wanted and self.content and kind == "file" and st.st_size <= self.most and not dropped and (self.hidden or not is_hidden):
            with open(path, "rb") as f:
                data = f.read(self.most + 1)
            if len(data) != st.st_size:
                raise CorpusError("io", "file changed while being read", path=rel)
        return wanted, (path, rel, os.path.basename(rel), kind, is_hidden, dropped, size, st.st_mtime_ns, data)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        rules, stack, count, size = load_rules(self.root) if self.respect else [], partition.value[::-1], 0, 0
        seen = set()
        while stack:
            rel, deep = stack.pop()
            wanted, row = self._entry(rel, rules) or (False, None)
            if row is None or row[5] or (row[4] and not self.hidden):
                continue
            count, size = count + 1, size + len(rel.encode("utf-8", "surrogateescape"))
            if count > MOST_ENTRIES or size > MOST_PATH_BYTES:
                raise invalid("the tree is too large")
            if wanted:
                yield (row[0], *[_shown(v) if isinstance(v, str) else v for v in row[1:]])
            if row[3] == "dir" and deep and self._may_hold(_shown(rel)):
                real = os.path.realpath(os.path.join(self.root, rel))
                if real not in seen:
                    seen.add(real)
                    stack += [(f"{rel}/{n}", True) for n in sorted(os.listdir(os.path.join(self.root, rel)), reverse=True)]


class PrunedTreeReader(TreeReader):
    """A reader that filters are pushed to; Spark asks for its switch wherever there is such a method, so the plain reader has none."""

    def pushFilters(self, filters):
        """Note what the filters rule out; all of them stay with Spark, so this only saves work."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, EqualTo | In):
                values = set(f.value) if isinstance(f, In) else {f.value}
                if column == ("kind",):
                    self.kinds = values if self.kinds is None else self.kinds & values
                elif column == ("rel_path",):
                    self.paths = values if self.paths is None else self.paths & values
                elif column == ("is_hidden",) and values == {False}:
                    self.hidden = False
                elif column == ("size",) and isinstance(f, EqualTo):
                    self._between(f.value, f.value)
            elif isinstance(f, Not) and isinstance(f.child, EqualTo) and f.child.attribute == ("is_hidden",) and f.child.value is True:
                self.hidden = False
            elif isinstance(f, StringStartsWith) and column == ("rel_path",):
                self.prefixes.append(f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and column == ("size",):
                self._between(f.value + isinstance(f, GreaterThan), None)
            elif isinstance(f, LessThan | LessThanOrEqual) and column == ("size",):
                self._between(0, f.value - isinstance(f, LessThan))
            yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return (PrunedTreeReader if str(self.options.get("pruned")).lower() == "true" else TreeReader)(self.options)


def tree(spark: SparkSession, root: str, **options):
    """The entries of a folder."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root)
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load()


def pruned(spark: SparkSession, root: str, condition: Column, **options):
    """The entries that meet a condition, which the listing is given.

    Turns on `spark.sql.python.filterPushdown.enabled`. Spark 4.1 keeps with a relation what was pushed into it and reads by that again
    when a later query on it pushes nothing. So the relation is new and only handed out under the condition and one more that always
    can be pushed: whatever is asked of the result, filters are pushed anew."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return tree(spark, root, pruned=True, **options).where(condition & F.col("rel_path").isNotNull())


def files(spark: SparkSession, root: str, condition: Column | None = None, **options):
    """(path, content, size, mtime_ns, text, is_binary, valid_utf8, hash_hex) of the files; path is relative to the root. ``condition``: on
    the entries, see `pruned`."""
    from ..corpus import hash_hex, with_text

    some = tree(spark, root, **options) if condition is None else pruned(spark, root, (F.col("kind") == "file") & condition, **options)
    rows = some.where("kind = 'file'").selectExpr("rel_path as path", "content", "size", "mtime_ns")
    return hash_hex(with_text(rows))
