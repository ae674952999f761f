"""A module graph that follows its files: what a change means is found from what each import once tried.

Five tables are kept as signed logs (`Signed`): a batch adds rows with sign +1 and -1, a row is present while its signs add up.

* ``imports``: each import of an analysed file with its candidates, by source;
* ``tried``: the same turned round, `resolve.stem` of a candidate path -> import. A file that appears or vanishes makes exactly the imports that
  tried its path resolve again, whether they were resolved or not; all others keep their edges;
* ``edges``: what imports mean now, by source;
* ``refs``: for each target the number of edges that lead to it, kept by adding what a batch's edges add and take;
* ``files`` and ``nodes``: paths that exist, and those among them that were analysed.

A referenced path that is not analysed is a stub: analysing it promotes it, forgetting it makes it one again, and it
goes with the last edge to it. A batch reads its own rows of these tables by key (`lookup.Lookup`), and writes only what it changes; logs are
rewritten as one table every COMPACT batches. Defined cases: paths that appear twice, vanish without being there or are analysed
twice in a batch count once; a path in both lists vanished first; one that is analysed and
forgotten in a batch is analysed; null paths are left out; an analysed path need not exist.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .lookup import Lookup, few
from .resolve import IMPORT, Package, candidates, settled, stem, stems

COMPACT = 8
EDGE = ["src", "dst", "to_kind", "reason", "specifier", "kind", "line", "span_start", "span_end"]
_EDGE_OF = ["src", *IMPORT[1:]]


class Signed:
    """A table as the sum of signed batches, each stored by one key."""

    def __init__(self, spark: SparkSession, key: str, label: str, columns: str, compact: int = COMPACT):
        self.key, self.label, self.compact = key, label, compact
        self.none = spark.createDataFrame([], columns + ", sign long")
        self.parts: list[Lookup] = []

    def add(self, rows: DataFrame) -> None:
        """Append a batch with its column ``sign``; ``rows`` are a written table."""
        n = rows.count()
        if n:
            self.parts.append(Lookup.write(rows.select(*self.none.columns[:-1], F.col("sign").cast("long").alias("sign")), self.key, self.label, n))
        if len(self.parts) >= self.compact:
            self.parts = [Lookup.write(materialize(self.all(), self.label), self.key, self.label)]

    @staticmethod
    def sum(parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(*[c for c in rows.columns if c != "sign"]).agg(F.sum("sign").alias("sign")).where("sign <> 0")

    def all(self) -> DataFrame:
        """The rows that are present, with their number as ``sign``."""
        return self.sum([self.none, *[p.all() for p in self.parts]]) if self.parts else self.none

    def of(self, keys: DataFrame) -> DataFrame:
        """Those of the keys in the one column of ``keys``, which is a written table."""
        if not self.parts:
            return self.none
        keys = keys.select(F.col(keys.columns[0]).alias(self.key))
        some = few(keys)
        if some == []:
            return self.none
        return self.sum([self.none, *[p.of(some) if some is not None else p.of_frame(keys) for p in self.parts]])


class ModuleGraph:
    """The tables of one tree. `advance` takes a batch of changes in; what it returns and what the tables hold is that of a rebuild."""

    def __init__(self, spark: SparkSession, aliases: list[tuple[str, list[str]]] = (), known: list[Package] = (), conditions: tuple[str, ...] = (), compact: int = COMPACT):
        self.spark, self.how = spark, (aliases, known, conditions)
        head = "path string, specifier string, kind string, line long, span_start long, span_end long"
        signed = lambda key, label, columns: Signed(spark, key, label, columns, compact)
        self.imports = signed("path", "imports", head + ", candidates array<string>, external string")
        self.tried = signed("stem", "tried", "stem string, " + head)
        self.edges = signed("src", "edges", ", ".join(f"{c} {'long' if c in IMPORT[3:] else 'string'}" for c in EDGE))
        self.refs, self.nodes = (signed("path", name, "path string") for name in ("refs", "nodes"))
        self.files = signed("stem", "files", "stem string, path string")

    def _paths(self, given: dict[str, DataFrame | None]) -> list[DataFrame]:
        """The distinct paths of each list, written once."""
        rows = [df.where("path is not null").select("path", F.lit(k).alias("k")) for k, df in given.items() if df is not None]
        none = self.spark.createDataFrame([], "path string, k string")
        every = materialize(reduce(DataFrame.union, rows, none).distinct(), "paths")
        return [every.where(F.col("k") == k).select("path") for k in given]

    def _there(self, paths: DataFrame) -> DataFrame:
        """Those of some paths that exist."""
        return self.files.of(paths.select(stem("path").alias("stem"))).select("path").join(paths, "path", "left_semi")

    def advance(self, appeared: DataFrame | None = None, vanished: DataFrame | None = None, imports: DataFrame | None = None, analysed: DataFrame | None = None, forgotten: DataFrame | None = None) -> dict:
        """One batch. appeared, vanished: (path) of files; analysed: (path) of files whose ``imports`` (path, specifier, kind, line,
        span_start, span_end) are known now, in place of older ones; forgotten: (path) of files that are no longer part of the index,
        but exist. Returns what was done as a dictionary: counts, and ``transitions`` (path, was, now) of nodes."""
        appeared, vanished, analysed, forgotten = self._paths({"appeared": appeared, "vanished": vanished, "analysed": analysed, "forgotten": forgotten})
        gone = self._there(vanished).join(appeared, "path", "left_anti")
        come = appeared.join(self._there(appeared), "path", "left_anti")
        moved = come.select("path", F.lit(1).alias("sign")).unionByName(gone.select("path", F.lit(-1).alias("sign")))
        moved = materialize(moved.select(stem("path").alias("stem"), "path", "sign"), "moved")
        lost = forgotten.union(vanished.join(appeared, "path", "left_anti")).distinct().join(analysed, "path", "left_anti")
        drop = materialize(analysed.withColumn("kept", F.lit(True)).unionByName(lost.withColumn("kept", F.lit(False))), "dropped")

        # Exactly the imports that tried a path that moved, but for those that are replaced anyway: by stem, then by the candidates themselves.
        near = self.tried.of(moved).drop("sign").join(moved.select("stem", F.col("path").alias("at")).hint("merge"), "stem").groupBy(*IMPORT).agg(F.collect_set("at").alias("at")).join(drop, "path", "left_anti")
        near = materialize(near, "near")
        again = self.imports.of(near.select("path").distinct()).drop("sign").join(near, IMPORT).where(F.arrays_overlap("candidates", "at")).drop("at")
        again = materialize(again, "touched")
        keys = again.select(*IMPORT)
        none = self.spark.createDataFrame([], ", ".join(f"{c} {'long' if c in IMPORT[3:] else 'string'}" for c in IMPORT))
        fresh = none if imports is None else imports.select(*IMPORT).distinct().join(analysed, "path", "left_semi")
        fresh = fresh.select(*[F.col(c).cast("long" if c in IMPORT[3:] else "string") for c in IMPORT])
        fresh = materialize(candidates(fresh, *self.how), "fresh")
        old = materialize(self.imports.of(drop.select("path")).drop("sign"), "old-imports")

        todo = fresh.unionByName(again)
        asked = materialize(todo.select(F.explode(stems("candidates")).alias("stem")).distinct(), "asked")
        there = self.files.of(asked).select("path").join(moved.where("sign < 0"), "path", "left_anti").union(moved.where("sign > 0").select("path"))
        plus = settled(todo, there).select(*EDGE, F.lit(1).alias("sign"))
        before = self.edges.of(drop.select("path")).union(self.edges.of(keys.select("path").distinct()).join(keys.withColumnRenamed("path", "src"), _EDGE_OF, "left_semi").select(*EDGE, "sign"))
        minus = before.select(*EDGE, F.lit(-1).alias("sign"))
        edge_delta = materialize(Signed.sum([plus, minus]), "edge-delta")
        ref_delta = materialize(edge_delta.where("to_kind = 'path'").groupBy(F.col("dst").alias("path")).agg(F.sum("sign").alias("sign")).where("sign <> 0"), "ref-delta")
        had = self.nodes.of(drop.select("path")).select("path", F.lit(True).alias("had"))
        node_delta = drop.join(had, "path", "left").where("kept <> coalesce(had, false)").select("path", F.when(F.col("kept"), 1).otherwise(-1).alias("sign"))
        node_delta = materialize(node_delta, "node-delta")
        told = materialize(self._transitions(ref_delta, node_delta), "transitions")

        inverted = lambda rows, sign: rows.select(F.explode(stems("candidates")).alias("stem"), *IMPORT).distinct().withColumn("sign", F.lit(sign))
        imports_delta = Signed.sum([fresh.withColumn("sign", F.lit(1)), old.withColumn("sign", F.lit(-1))])
        tried_delta = Signed.sum([inverted(fresh, 1), inverted(old, -1)])
        tables = [(self.imports, imports_delta, "import-delta"), (self.tried, tried_delta, "tried-delta"), (self.edges, edge_delta, None), (self.refs, ref_delta, None), (self.nodes, node_delta, None), (self.files, moved, None)]
        with ThreadPoolExecutor(len(tables)) as pool:  # the tables do not depend on one another
            list(pool.map(lambda x: x[0].add(materialize(x[1], x[2]) if x[2] else x[1]), tables))
        kinds = {"touched": keys, "fresh": fresh, "moved": moved, "edges_added": edge_delta.where("sign > 0"), "edges_removed": edge_delta.where("sign < 0")}
        counts = reduce(DataFrame.union, [df.agg(F.lit(k).alias("k"), F.count("*").alias("n")) for k, df in kinds.items()])
        return {r.k: r.n for r in counts.collect()} | {"transitions": told}

    def _transitions(self, ref_delta: DataFrame, node_delta: DataFrame) -> DataFrame:
        """(path, was, now) of the nodes that this batch turns into another kind, from the paths that it changes alone."""
        paths = materialize(ref_delta.select("path").union(node_delta.select("path")).distinct(), "changed")
        refs = self.refs.of(paths).select("path", F.col("sign").alias("n"))
        nodes = self.nodes.of(paths).select("path", F.col("sign").alias("a"))
        rows = paths.join(refs, "path", "left").join(nodes, "path", "left").join(ref_delta.withColumnRenamed("sign", "dn"), "path", "left").join(node_delta.withColumnRenamed("sign", "da"), "path", "left").fillna(0)
        kind = lambda a, n: F.when(a > 0, "analyzed").when(n > 0, "stub").otherwise("none")
        out = rows.select("path", kind(F.col("a"), F.col("n")).alias("was"), kind(F.col("a") + F.col("da"), F.col("n") + F.col("dn")).alias("now"))
        return out.where("was <> now")

    def states(self) -> DataFrame:
        """(path, state, refs) of all nodes: analyzed, or stub while an edge leads to it."""
        refs, nodes = self.refs.all().select("path", F.col("sign").alias("refs")), self.nodes.all().select("path", F.lit("analyzed").alias("state"))
        rows = nodes.join(refs, "path", "full")
        return rows.select("path", F.coalesce("state", F.lit("stub")).alias("state"), F.coalesce("refs", F.lit(0)).alias("refs"))

    def all_edges(self) -> DataFrame:
        return self.edges.all().drop("sign")
