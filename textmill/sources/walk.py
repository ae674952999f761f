"""The entries of a whole tree, listed level by level as Spark jobs: links, cycles and the budget are exact, however the work is split.

A level is a table of folders. Tasks list one folder after another, so a folder is the unit of work; what they find is written, and
the folders among it are the next level, but for those that were entered before: a visited table holds (device, inode) of every folder, so one
that several links lead to is entered once, by its first path (the lowest level, then the least path), and a cycle of links ends. The
budget counts all entries and path bytes of the tree; what exceeds it is an error, never a part of the tree.

Defined cases: a dangling link is a symlink; a followed link to a file is a file, one to a folder a folder, not followed ones are
symlinks; sockets and devices are left out; a folder that vanishes while it is listed is an error; hidden and ignored folders are not
entered. The root must be visible to the driver and the executors.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dialect import ignored
from ..errors import CorpusError, invalid
from ..storage import materialize
from .tree import MOST_CONTENT, MOST_ENTRIES, MOST_PATH_BYTES, _shown, load_rules

ENTRIES = "rel_path string, name string, kind string, is_hidden boolean, size long, mtime_ns long, folder string"
#: Tasks of a level at most, and rows of a batch.
TASKS, ROWS = 1024, 5000


def _entry(root: str, rel: str, follow: bool) -> tuple | None:
    """(kind, size, mtime_ns, id of the folder to enter) of an entry, None for what is neither file, folder nor link."""
    path = os.path.join(root, rel)
    st, link = os.lstat(path), False
    if stat.S_ISLNK(st.st_mode):
        link = True
        if follow and os.path.exists(path):
            st, link = os.stat(path), False
    kind = "symlink" if link else "dir" if stat.S_ISDIR(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else None
    if kind is None:
        return None
    return kind, st.st_size if kind == "file" else 0, st.st_mtime_ns, f"{st.st_dev}:{st.st_ino}" if kind == "dir" else None


def _lister(root: str, hidden: bool, respect: bool, follow: bool):
    import pyarrow as pa

    kinds = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in (ENTRIES + ", at string").split(", "))])

    def rows_of(folder: str, rules) -> Iterator[tuple]:
        with os.scandir(os.path.join(root, os.fsdecode(bytes.fromhex(folder)))) as found:
            for e in found:
                rel = os.path.join(os.fsdecode(bytes.fromhex(folder)), e.name)
                is_hidden = e.name.startswith(".") or any(p.startswith(".") for p in rel.split("/"))
                if is_hidden and not hidden:
                    continue
                got = _entry(root, rel, follow)
                if got is None or respect and ignored(rules, rel, got[0] == "dir"):
                    continue
                yield _shown(rel), _shown(e.name), got[0], is_hidden, got[1], got[2], got[3], os.fsencode(rel).hex()

    def run(batches: Iterator) -> Iterator:
        rules = load_rules(root) if respect else []
        held: list[tuple] = []
        pack = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for at in b["at"].to_pylist():
                for row in rows_of(at, rules):
                    held.append(row)
                    if len(held) >= ROWS:
                        yield pack()
                        held.clear()
        if held:
            yield pack()

    return run


def walk(spark: SparkSession, root: str, hidden: bool = True, respect_ignore: bool = True, follow_symlinks: bool = False, most_entries: int = MOST_ENTRIES, most_path_bytes: int = MOST_PATH_BYTES) -> DataFrame:
    """(rel_path, name, kind, is_hidden, size, mtime_ns, folder, at, level) of all entries: folder is the (device:inode) of a folder, at the
    path's bytes in hexadecimal."""
    root = os.path.realpath(root.removeprefix("file://"))
    if not os.path.isdir(root):
        raise CorpusError("notFound", "no such folder", path=root)
    st = os.stat(root)
    front = spark.createDataFrame([("", f"{st.st_dev}:{st.st_ino}")], "at string, folder string")
    visited, levels, entries, size, n = [front.select("folder")], [], 0, 0, 1
    lister = _lister(root, hidden, respect_ignore, follow_symlinks)
    while n:
        dealt = front.select("at").repartition(min(n, TASKS), "at")
        rows = materialize(dealt.mapInArrow(lister, ENTRIES + ", at string"), "level")
        count, path_bytes = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("at") / 2), F.lit(0))).head()
        entries, size = entries + count, size + int(path_bytes)
        if entries > most_entries or size > most_path_bytes:
            raise invalid("the tree is too large")
        levels.append(rows.withColumn("level", F.lit(len(levels) + 1)))
        new = rows.where("kind = 'dir'").groupBy("folder").agg(F.min("at").alias("at"))
        front = materialize(new.join(reduce(DataFrame.union, visited), "folder", "left_anti").select("at", "folder"), "folders")
        visited.append(front.select("folder"))
        n = front.count()
    return reduce(DataFrame.unionByName, levels)


def contents(entries: DataFrame, root: str, most_bytes: int = MOST_CONTENT) -> DataFrame:
    """(path, content, size, mtime_ns) of the files among ``entries`` of `walk`; null content for files of more than ``most_bytes``. Files are
    read where the rows are: filter and repartition the entries before."""
    import pyarrow as pa

    root = os.path.realpath(root.removeprefix("file://"))
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("mtime_ns", pa.int64())])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for rel, at, size, at_time in zip(*(b[c].to_pylist() for c in ("rel_path", "at", "size", "mtime_ns")), strict=True):
                data = None
                if size <= most_bytes:
                    with open(os.path.join(root, os.fsdecode(bytes.fromhex(at))), "rb") as f:
                        data = f.read(most_bytes + 1)
                    if len(data) != size:
                        raise CorpusError("io", "file changed while being read", path=rel)
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip((rel, data, size, at_time), schema, strict=True)], schema=schema)

    return entries.where("kind = 'file'").select("rel_path", "at", "size", "mtime_ns").mapInArrow(run, "path string, content binary, size long, mtime_ns long")
