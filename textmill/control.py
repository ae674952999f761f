"""Index snapshots of corpora on the driver: freshness reuse, invalidation, cancellation, figures.

A snapshot is a set of written tables (files, symbols, imports, edges) of one (root, options) key with a revision. Publishing
swaps the pointer; readers of an older snapshot keep theirs.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import extract
from .operators import resolve, sweep
from .storage import materialize

RING = 4096


@dataclass
class Snapshot:
    revision: int
    made: float
    tables: dict[str, DataFrame]


@dataclass
class Index:
    """Snapshots by key, a bounded log of changed paths, and one build at a time for each key."""

    spark: SparkSession
    snapshots: dict[tuple, Snapshot] = field(default_factory=dict)
    log: list[tuple[int, str | None]] = field(default_factory=list)
    revision: int = 0
    spans: list[tuple[str, int]] = field(default_factory=list)
    _locks: dict[tuple, threading.Lock] = field(default_factory=dict)

    def _record(self, path: str | None) -> None:
        self.revision += 1
        self.log = [*self.log, (self.revision, path)][-RING:]

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append((name, int((time.perf_counter() - began) * 1e6)))

    def get(self, key: tuple, scan: Callable[[], DataFrame], max_stale_ms: int = 0, aliases=()) -> Snapshot:
        """The snapshot of a key. A recent enough one is reused; else ``scan()`` (path, text, size, mtime_ns, hash) is compared
        with the last one, and only added and modified files are parsed."""
        lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            old = self.snapshots.get(key)
            if old and (time.monotonic() - old.made) * 1000 <= max_stale_ms:
                return old
            with self.span("sweep"):
                new = self._sweep(old, scan(), aliases)
            self.snapshots[key] = new
            return new

    def _sweep(self, old: Snapshot | None, scanned: DataFrame, aliases) -> Snapshot:
        scanned = materialize(scanned, "scan")
        files = scanned.drop("text")
        if old is None:
            parsed = materialize(extract.analyses(scanned), "analyses")
        else:
            change = materialize(sweep.changes(old.tables["files"], files), "changes")
            todo = scanned.join(change.where("change in ('added', 'modified')").select("path"), "path", "left_semi")
            parsed = materialize(sweep.apply(old.tables["analyses"], change, extract.analyses(todo)), "analyses")
        edges = materialize(resolve.resolve(extract.imports(parsed), files.select("path"), aliases), "edges")
        if old is None:
            self._record(None)
        else:
            changed = [r.path for r in change.where("change in ('added', 'modified', 'removed')").select("path").limit(RING + 1).collect()]
            for path in sorted(changed) if len(changed) <= RING else [None]:
                self._record(path)
        return Snapshot(self.revision, time.monotonic(), {"files": files, "analyses": parsed, "symbols": extract.symbols(parsed), "imports": extract.imports(parsed), "edges": edges})

    def since(self, revision: int) -> list[str] | None:
        """Paths changed after a revision; None if the log is too short or everything was discarded."""
        newer = [p for r, p in self.log if r > revision]
        gone = self.log and self.log[0][0] > revision + 1
        return None if gone or None in newer else newer

    def invalidate(self, path: str, recursive: bool = False) -> dict[str, int]:
        """Drop the snapshots that hold a path (or anything below it) and log it."""
        hit = F.col("path") == path if not recursive else (F.col("path") == path) | F.startswith("path", F.lit(path.rstrip("/") + "/"))
        drop = [k for k, s in self.snapshots.items() if s.tables["files"].where(hit).limit(1).count()]
        for k in drop:
            del self.snapshots[k]
        self._record(path)
        return {"snapshots": len(drop)}

    def clear(self) -> dict[str, int]:
        n = len(self.snapshots)
        self.snapshots.clear()
        self._record(None)
        self.spark.catalog.clearCache()
        return {"snapshots": n}

    def profile(self) -> DataFrame:
        from .streaming.chunks import profile

        return profile(self.spark.createDataFrame(self.spans or [("none", 0)], "name string, us long"))


@contextmanager
def cancellable(spark: SparkSession, label: str = "") -> Iterator[Callable[[], None]]:
    """Jobs started inside can be cancelled from another thread through the callable that this gives."""
    group = f"{label or 'textmill'}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.setJobGroup(group, label, interruptOnCancel=True)
    try:
        yield lambda: sc.cancelJobGroup(group)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
