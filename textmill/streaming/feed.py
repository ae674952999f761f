"""Structured Streaming: a folder of change files drives the index; every batch replaces the rows of its paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "revision long, path string, event string, text string"


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of change rows from JSON-lines files that appear in a folder."""
    return spark.readStream.schema(CHANGES).json(folder)


def follow(stream: DataFrame, base: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], compact_every: int = 20):
    """Keep a Parquet index below ``base`` in step with a change stream; returns the started query.

    A batch writes only what it changes: ``parse`` of the last text of each changed path, and the list of those paths, whose older
    rows no longer count. Every ``compact_every`` batches the index as it then is becomes one new folder, from which readers start.
    A batch that is run again overwrites its own folders, so delivery is exactly once for readers of `current`.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("path").agg(F.max(F.struct("revision", "event", "text")).alias("c")).select("path", "c.*")
        new = parse(newest.where("event <> 'remove'").select("path", "text"))
        newest.select("path").write.mode("overwrite").parquet(f"{base}/changed={batch_id}")
        new.write.mode("overwrite").parquet(f"{base}/rows={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            current(spark, base, batch_id).write.mode("overwrite").parquet(f"{base}/whole={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _finished(spark: SparkSession, base: str) -> dict[str, list[int]]:
    """Numbers of the batches whose folders are complete, by kind of folder."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"changed": [], "rows": [], "whole": []}
    for status in fs.listStatus(fs_path) if fs.exists(fs_path) else []:
        kind, _, n = str(status.getPath().getName()).partition("=")
        if kind in found and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(n))
    return found


def current(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame | None:
    """The index after its newest batch, or after batch ``upto``: the last whole folder and the batches after it, of each path the rows
    of the last batch that changed it."""
    found = {k: [n for n in v if upto is None or n <= upto] for k, v in _finished(spark, base).items()}
    start = max(found["whole"], default=-1)
    batches = sorted(n for n in set(found["changed"]) & set(found["rows"]) if n > start)
    if start < 0 and not batches:
        return None
    parts = [spark.read.parquet(f"{base}/whole={start}").withColumn("_batch", F.lit(start))] if start >= 0 else []
    parts += [spark.read.parquet(f"{base}/rows={n}").withColumn("_batch", F.lit(n)) for n in batches]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    if not batches:
        return rows.drop("_batch")
    changed = reduce(lambda a, b: a.unionByName(b), [spark.read.parquet(f"{base}/changed={n}").select("path", F.lit(n).alias("_last")) for n in batches])
    last = changed.groupBy("path").agg(F.max("_last").alias("_last"))
    return rows.join(last, "path", "left").where("_last is null or _last = _batch").select(*[c for c in rows.columns if c != "_batch"])


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and key, with a watermark for late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


STATE = "revision long, hash string, alive boolean"
SWEPT = "path string, change string, revision long, hash string"


def swept(stream: DataFrame) -> DataFrame:
    """Stream of SWEPT rows from change rows (revision, path, event, hash): what a batch makes of each path that it names, decided by a state
    for each path, the newest revision and its hash.

    Events come in any order and any number of times: those that are not newer than the state are late and change nothing. Of a
    batch only the newest counts: added, modified, touched (same hash) or removed; a removal of what is not there tells nothing. The newest
    row of each path is what a sweep over all events gives. A path's state is one row, however many events it has."""
    import pandas as pd

    def step(key: tuple, parts, state):
        had = state.get if state.exists else (-1, None, False)
        best = None
        for p in parts:
            for revision, event, hash_ in p[["revision", "event", "hash"]].itertuples(index=False):
                if revision > had[0] and (best is None or revision > best[0]):
                    best = (int(revision), event, hash_)
        if best is None:
            return
        revision, event, hash_ = best
        alive = event != "remove"
        state.update((revision, hash_ if alive else None, alive))
        change = ("added" if not had[2] else "touched" if had[1] == hash_ else "modified") if alive else "removed" if had[2] else None
        if change:
            yield pd.DataFrame({"path": [key[0]], "change": [change], "revision": [revision], "hash": [hash_ if alive else None]})

    return stream.where("path is not null and revision is not null").groupBy("path").applyInPandasWithState(step, SWEPT, STATE, "append", "NoTimeout")
