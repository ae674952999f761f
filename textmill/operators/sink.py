"""Writes of edited texts to a folder: single files on the driver, tables by tasks that stage and a driver that moves what they staged."""

from __future__ import annotations

import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..errors import CorpusError, invalid
from ..storage import fresh_path

_locks: dict[str, threading.RLock] = {}
_guard = threading.Lock()


@contextmanager
def locked(path: str):
    """One writer at a time for each real path."""
    key = os.path.realpath(path)
    with _guard:
        lock = _locks.setdefault(key, threading.RLock())
    with lock:
        yield


def write(path: str, content: bytes | str, create_dirs: bool = True, mode: str = "atomic", follow_symlinks: bool = True) -> dict:
    """Write one file. atomic: a temporary file in the same folder, then a rename, the old file's mode kept; inPlace: truncate
    the file that is there. Gives bytes_written, existed, path, followed_symlink."""
    if mode not in ("atomic", "inPlace"):
        raise invalid(f"unknown write mode {mode!r}")
    data = content.encode() if isinstance(content, str) else content
    link = os.path.islink(path)
    target = os.path.realpath(path) if link and follow_symlinks else path
    with locked(target):
        if os.path.isdir(target):
            raise CorpusError("isDirectory", "a folder is in the way", path=target)
        folder = os.path.dirname(os.path.abspath(target))
        if create_dirs:
            os.makedirs(folder, exist_ok=True)
        elif not os.path.isdir(folder):
            raise CorpusError("notFound", "no such folder", path=folder)
        existed = os.path.lexists(target)
        if mode == "inPlace":
            with open(target, "r+b" if existed else "wb") as f:
                f.write(data)
                f.truncate()
        else:
            fd, temp = tempfile.mkstemp(dir=folder, prefix=".write-")
            try:
                with os.fdopen(fd, "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                if existed and not os.path.islink(target):
                    os.chmod(temp, os.stat(target).st_mode & 0o7777)
                else:
                    os.chmod(temp, 0o644)
                os.replace(temp, target)
            except BaseException:
                if os.path.exists(temp):
                    os.unlink(temp)
                raise
    return {"bytes_written": len(data), "existed": existed, "path": target, "followed_symlink": link and follow_symlinks}


STAGING = ".staging-"
MANIFEST = "path string, bytes_written long, existed boolean, followed_symlink boolean"


@dataclass
class Staged(WriterCommitMessage):
    """What one task wrote: (path, name of the staged file, bytes)."""

    files: list[tuple[str, str, int]]


class TreeWriter(DataSourceWriter):
    """Writes (path, content) rows below a folder. Tasks put contents into a staging folder beside the targets, under names of their own
    attempt; the driver gets names and sizes only, and moves all files or none: it checks every target first, then renames. A task that
    runs twice leaves one file, since only the committed attempt's names are moved; the staging folder goes with what is left in it."""

    def __init__(self, options):
        self.root = os.path.realpath((options.get("path") or "").removeprefix("file://"))
        if not options.get("path"):
            raise invalid("the tree sink needs a path")
        flag = lambda k, default: str(options.get(k, default)).lower() == "true"
        self.create_dirs, self.follow = flag("createDirs", "true"), flag("followSymlinks", "true")
        self.mode, self.manifest = options.get("writeMode", "atomic"), options.get("manifest")
        if self.mode not in ("atomic", "inPlace"):
            raise invalid(f"unknown write mode {self.mode!r}")
        self.staging = os.path.join(self.root, STAGING + uuid.uuid4().hex)

    def write(self, iterator: Iterator) -> Staged:
        files = []
        os.makedirs(self.staging, exist_ok=True)
        for row in iterator:
            if row["path"] is None or row["content"] is None:
                continue
            data = row["content"].encode() if isinstance(row["content"], str) else bytes(row["content"])
            fd, temp = tempfile.mkstemp(dir=self.staging)
            with os.fdopen(fd, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            files.append((row["path"], os.path.basename(temp), len(data)))
        return Staged(files)

    def _target(self, path: str) -> tuple[str, bool]:
        """(file to replace, whether a link led there); an error where nothing may be written."""
        full = os.path.normpath(os.path.join(self.root, path))
        if not full.startswith(self.root + os.sep):
            raise invalid("a path leads out of the folder", path=path)
        link = os.path.islink(full)
        target = os.path.realpath(full) if link and self.follow else full
        if os.path.isdir(target):
            raise CorpusError("isDirectory", "a folder is in the way", path=path)
        if not self.create_dirs and not os.path.isdir(os.path.dirname(target)):
            raise CorpusError("notFound", "no such folder", path=path)
        return target, link and self.follow

    def _move(self, temp: str, target: str) -> bool:
        """Put a staged file in its place; whether there was one before."""
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with locked(target):
            existed = os.path.lexists(target)
            if self.mode == "inPlace" and existed:
                with open(temp, "rb") as a, open(target, "r+b") as b:
                    shutil.copyfileobj(a, b)
                    b.truncate()
            else:
                os.chmod(temp, os.stat(target).st_mode & 0o7777 if existed and not os.path.islink(target) else 0o644)
                os.replace(temp, target)
        return existed

    def commit(self, messages: list) -> None:
        from concurrent.futures import ThreadPoolExecutor

        try:
            files = [f for m in messages if m is not None for f in m.files]
            places = [self._target(path) for path, *_ in files]
            if len({t for t, _ in places}) < len(places):
                raise invalid("a path is written twice")
            with ThreadPoolExecutor(16) as pool:
                existed = list(pool.map(lambda f, t: self._move(os.path.join(self.staging, f[1]), t[0]), files, places))
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)
        if self.manifest:
            self._tell([(p, n, e, link) for (p, _, n), (_, link), e in zip(files, places, existed, strict=True)])

    def _tell(self, rows: list[tuple]) -> None:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.manifest)
        system.create_dir(path, recursive=True)
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))]
        pq.write_table(pa.table(columns, names=[c.split()[0] for c in MANIFEST.split(", ")]), f"{path}/part-0.parquet", filesystem=system)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class TreeSink(DataSource):
    """``df.write.format("tree_sink").mode("append").save(root)`` for (path, content) rows. Options: writeMode (atomic, inPlace),
    createDirs, followSymlinks, manifest (a folder for the table of what was written). Rows with a null path or content are left out, a path
    that comes twice or leads out of the folder is an error, before anything is moved."""

    @classmethod
    def name(cls) -> str:
        return "tree_sink"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        if not {"path", "content"} <= set(schema.names):
            raise invalid("the tree sink needs the columns path and content")
        return TreeWriter(self.options)


def commit(edited: DataFrame, root: str, **options) -> DataFrame:
    """Write the (path, content) rows of a batch of edits below ``root``: all of them or none. Gives MANIFEST rows of what was written."""
    spark = edited.sparkSession
    spark.dataSource.register(TreeSink)
    os.makedirs(root.removeprefix("file://"), exist_ok=True)
    manifest = fresh_path(spark, "manifest")
    writer = edited.select("path", "content").write.format("tree_sink").mode("append").option("manifest", manifest)
    for k, v in options.items():
        writer = writer.option(k, str(v).lower() if isinstance(v, bool) else v)
    writer.save(root)
    return spark.read.schema(MANIFEST).parquet(manifest)
