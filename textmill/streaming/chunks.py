"""Ordered chunk streams, idle gaps, change feeds and log-scale profiles, as batch operators that also run on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOG_RING = 4096


def reassemble(chunks: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Chunks of each key joined in order. A key's chunks meet in one row: bounded by the stream's own output cap."""
    return chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("c")).select(*keys, F.array_join(F.transform("c", lambda x: x[text]), "").alias("text"), F.size("c").cast("long").alias("chunks"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, end, events): a session ends when nothing comes for ``gap``. Works on batches and, with a watermark, on streams."""
    g = events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return g.select(key, "start", "end", "events")


def since(log: DataFrame, revision: int, ring: int = LOG_RING) -> DataFrame:
    """(revision, path) after ``revision`` of a bounded log that keeps its last ``ring`` entries. If entries after ``revision``
    are gone already, one row with a null path says: discard everything."""
    last = log.agg(F.max("revision").alias("last"))
    least = last.select((F.col("last") - ring + 1).alias("least"))
    kept = log.join(F.broadcast(least)).where((F.col("revision") > revision) & (F.col("revision") >= F.col("least")) & (F.col("least") <= revision + 1))
    wipe = last.join(least).where(F.col("least") > revision + 1).select(F.col("last").alias("revision"), F.lit(None).cast("string").alias("path"))
    return kept.select("revision", "path").unionByName(wipe)


#: What a file-system event does to (content cache, walk cache, record in the log).
EFFECTS = {"create": (True, True, True), "remove": (True, True, True), "rename": (True, True, True), "modify": (True, False, True), "metadata": (False, False, False), "access": (False, False, False)}


def effects(events: DataFrame, kind: str = "event") -> DataFrame:
    """Adds drops_content, drops_walk, recorded; an unknown kind drops everything."""
    out = events
    for k, name in enumerate(("drops_content", "drops_walk", "recorded")):
        c: Column = F.lit(True)
        for event, effect in EFFECTS.items():
            c = F.when(F.col(kind) == event, effect[k]).otherwise(c)
        out = out.withColumn(name, c)
    return out


def profile(spans: DataFrame, name: str = "name", us: str = "us") -> DataFrame:
    """(name, count, total_us, min_us, max_us, p50_us, p99_us): percentiles are upper bounds of 48 log2 buckets."""
    bucket = F.least(F.floor(F.log2(F.greatest(F.col(us), F.lit(1)).cast("double"))), F.lit(47)).cast("int")
    per = spans.groupBy(name, bucket.alias("b")).agg(F.count("*").alias("n"), F.sum(us).alias("t"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    w = Window.partitionBy(name).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(name)
    per = per.withColumn("c", F.sum("n").over(w)).withColumn("all", F.sum("n").over(whole))
    at = lambda q: F.min(F.when(F.col("c") >= F.ceil(F.col("all") * q), F.pow(F.lit(2.0), F.col("b") + 1)))
    return per.groupBy(name).agg(F.sum("n").alias("count"), F.sum("t").alias("total_us"), F.min("lo").alias("min_us"), F.max("hi").alias("max_us"), at(0.5).cast("long").alias("p50_us"), at(0.99).cast("long").alias("p99_us"))


def ticks(events: DataFrame, ts: str, width: str, hit: Column) -> DataFrame:
    """(start, n, hits) of tumbling windows."""
    return events.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).select(F.col("w.start").alias("start"), "n", "hits")
