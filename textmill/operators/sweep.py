"""Incremental refresh of an index: what changed between a snapshot and a scan, which files to parse, which to drop; and the
bounded warming of imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(snapshot: DataFrame, scan: DataFrame, force: bool = False, universe_complete: bool = True) -> DataFrame:
    """(path, change) from two tables (path, size, mtime_ns, hash): added, removed (only if the scan saw all), touched
    (other stat, same hash), modified, same. ``force`` parses touched files anew (modified)."""
    a = snapshot.select("path", F.struct("size", "mtime_ns", "hash").alias("a"))
    b = scan.select("path", F.struct("size", "mtime_ns", "hash").alias("b"))
    stat = (F.col("a.size") == F.col("b.size")) & (F.col("a.mtime_ns") == F.col("b.mtime_ns"))
    same = F.col("a.hash") == F.col("b.hash")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed" if universe_complete else "unseen").when(~same, "modified").when(stat, "same").otherwise("modified" if force else "touched")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def apply(index: DataFrame, change: DataFrame, parsed: DataFrame) -> DataFrame:
    """The index table after a sweep: rows of removed and modified files go, ``parsed`` rows (of added and modified files) come."""
    gone = change.where("change in ('removed', 'modified')").select("path")
    return index.join(gone, "path", "left_anti").unionByName(parsed)


def last_wins(files: DataFrame, order: str = "seq", most_bytes: int = 2 << 20) -> DataFrame:
    """One row per path, the last by ``order``; larger files than ``most_bytes`` are left out."""
    newest = files.groupBy("path").agg(F.max(F.struct(order, *[c for c in files.columns if c not in ("path", order)])).alias("r"))
    return newest.select("path", "r.*").where(F.octet_length("text") <= most_bytes)


def from_list(listed: DataFrame, files: DataFrame, extensions: list[str], most_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """(files to index, one row of counts) of a caller's list (path) against ``files`` (path, text): every occurrence is unsupported (no
    such ending), missing, oversize or scanned, in this order; a path that is scanned several times is indexed once."""
    names = listed.select("path", F.col("path").rlike(r"\.(" + "|".join(extensions) + ")$").alias("supported"))
    there = files.select("path", F.octet_length("text").alias("size"))
    state = F.when(~F.coalesce("supported", F.lit(False)), "unsupported").when(F.col("size").isNull(), "missing").when(F.col("size") > most_bytes, "oversize").otherwise("scanned")
    told = names.join(there, "path", "left").select("path", state.alias("state"))
    chosen = told.where("state = 'scanned'").select("path").distinct()
    of = lambda k: F.count_if(F.col("state") == k).alias(k)
    counts = told.agg(F.count("*").alias("listed"), *[of(k) for k in ("scanned", "unsupported", "missing", "oversize")], F.count_distinct(F.when(F.col("state") == "scanned", F.col("path"))).alias("indexed"))
    return files.join(chosen, "path", "left_semi"), counts


#: Bounds of the warming of imports.
SEEDS, PER_SEED, TARGETS, FILE_BYTES, TOTAL_BYTES = 32, 64, 256, 2 << 20, 16 << 20


def prefetch(seeds: DataFrame, imports: DataFrame, files: DataFrame, max_seeds: int = SEEDS, per_seed: int = PER_SEED, targets: int = TARGETS, file_bytes: int = FILE_BYTES, total_bytes: int = TOTAL_BYTES) -> DataFrame:
    """(seed, target, outcome) of a bounded depth-1 warming: fetched, or why not: seed limit, duplicate seed (no target), import limit,
    external, unresolved, outside the root, duplicate, missing, ignored, symlink, unsupported, not text, unreadable, too large, target
    limit, byte limit. seeds (path), imports (path, pos, target and, if known, to_kind), files (path, size and, where the scan knows
    it, booleans ignored, symlink, supported, valid_utf8, io_error)."""
    first = seeds.select(F.col("path").alias("seed")).distinct().orderBy("seed").limit(max_seeds)
    first = first.withColumn("sn", F.row_number().over(Window.orderBy("seed")))  # over max_seeds rows at most
    kind = F.col("to_kind") if "to_kind" in imports.columns else F.lit("path")
    rows = imports.select(F.col("path").alias("seed"), "pos", "target", kind.alias("to_kind")).join(seeds.select(F.col("path").alias("seed")).distinct(), "seed")
    rows = rows.join(F.broadcast(first), "seed", "left")
    late = rows.where("sn is null").select("seed", "target", F.lit("seed limit").alias("outcome"))
    rows = rows.where("sn is not null").withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("pos")))
    late = late.unionByName(rows.where(F.col("n") > per_seed).select("seed", "target", F.lit("import limit").alias("outcome")))
    rows = rows.where(F.col("n") <= per_seed)  # at most max_seeds * per_seed rows from here on
    out_of = F.col("target").rlike(r"^\.\.(/|$)")
    rows = rows.withColumn("outcome", F.when(F.col("to_kind") != "path", F.col("to_kind")).when(out_of, "outside the root"))
    late = late.unionByName(rows.where("outcome is not null").select("seed", "target", "outcome")).unionByName(seeds.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("seed"), F.lit(None).cast("string").alias("target"), F.lit("duplicate seed").alias("outcome"), F.explode(F.sequence(F.lit(2), F.col("n")))).drop("col"))
    rows = rows.where("outcome is null").drop("outcome")
    again = F.row_number().over(Window.partitionBy("target").orderBy("sn", "n")) > 1
    told = lambda c, default: F.col(c) if c in files.columns else F.lit(default)
    skip = F.when(told("ignored", False), "ignored").when(told("symlink", False), "symlink").when(~told("supported", True), "unsupported").when(~told("valid_utf8", True), "not text").when(told("io_error", False), "unreadable")
    rows = rows.withColumn("again", again).join(files.select(F.col("path").alias("target"), "size", skip.alias("skip")), "target", "left")
    rows = rows.withColumn("outcome", F.when(F.col("again"), "duplicate").when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("size").isNull(), "missing").when(F.col("size") > file_bytes, "too large"))
    left = rows.where("outcome is null").select("seed", "target", "sn", "n", "size")
    order = Window.orderBy("sn", "n")
    left = left.withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = left.select("seed", "target", F.when(F.col("k") > targets, "target limit").when(F.col("sum") > total_bytes, "byte limit").otherwise("fetched").alias("outcome"))
    return late.unionByName(rows.where("outcome is not null").select("seed", "target", "outcome")).unionByName(left)
