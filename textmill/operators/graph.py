"""Traversals and rollups of a module graph held as tables: edges (src, dst, ...), nodes (path, ...).

A traversal joins its frontier to the edges once per level; each frontier is written to the shared folder as one more part of what
has been seen, measured once, and broadcast only if it is small. Depth is bounded by MAX_DEPTH, a result by ``max_result`` rows (more is
an error, not a cut; None: no bound). Edges are a table, scanned once a level, or an `Adjacency`, of which a level reads what its frontier has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..storage import BROADCAST_BYTES, BROADCAST_ROWS, broadcast_if_small, materialize, measured, numbered
from .lookup import KEYS, Lookup, few

MAX_DEPTH, MAX_RESULT = 64, 100_000
MAX_ROUNDS = 60
#: Edges up to which components are found in one task.
ONE_TASK = 200_000


def _levels(step: DataFrame, starts: DataFrame, depth: int, view: DataFrame | None, done: int = 0) -> DataFrame:
    """(node, distance) of nodes within ``depth`` steps of the starts; step: (a, b). Nodes outside ``view`` are not entered. ``done``: starts
    are (node, distance) of all nodes up to that distance."""
    if not 0 <= depth <= MAX_DEPTH:
        raise invalid(f"depth must lie between 0 and {MAX_DEPTH}")
    inside = lambda df: df if view is None else df.join(view.select(F.col("path").alias("node")), "node", "left_semi")
    hinted = lambda df, rows, size: F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df.hint("merge")
    if "distance" not in starts.columns:
        starts = starts.select("node", F.lit(0).alias("distance"))
    seen = materialize(inside(starts.select("node", "distance").distinct()), "frontier")
    front = seen.where(F.col("distance") == done)
    rows, size = measured(front)
    all_rows, all_size = measured(seen)
    for d in range(done + 1, depth + 1):
        if not rows:
            break
        new = step.join(hinted(front.select(F.col("node").alias("a")), rows, size), "a").select(F.col("b").alias("node")).distinct()
        new = inside(new).join(hinted(seen.select("node"), all_rows, all_size), "node", "left_anti")
        front = materialize(new.select("node", F.lit(d).alias("distance")), "frontier")
        rows, size = measured(front)
        seen, all_rows, all_size = seen.unionByName(front), all_rows + rows, all_size + size
    return seen


def _bounded(df: DataFrame, max_result: int | None) -> DataFrame:
    if max_result is not None and df.limit(max_result + 1).count() > max_result:
        raise invalid(f"a traversal of more than {max_result} rows; narrow it or raise max_result")
    return df


class Adjacency:
    """Edges (src, dst, ...) stored twice, by source and by target: a level of a traversal reads what its frontier has, not the table.

    ``out`` and ``back`` are `lookup.Lookup` tables. A frontier of at most `lookup.KEYS` nodes is a pushed filter and stays with the
    driver; a larger one is a table in the shared folder and is joined."""

    def __init__(self, out: Lookup | None, back: Lookup | None, edges: DataFrame | None = None, most: int | None = None):
        """Sides that are not given are stored from ``edges``, of at most ``most`` rows, when they are first read."""
        self._sides, self._edges, self._most = {"src": out, "dst": back}, edges, most
        given = out or back
        self.sparkSession, self.columns = (given.spark, given.columns) if given else (edges.sparkSession, edges.columns)

    @classmethod
    def build(cls, edges: DataFrame) -> Adjacency:
        rows = materialize(edges, "edges")
        n = rows.count()
        return cls(Lookup.write(rows, "src", "edges-by-src", n), Lookup.write(rows, "dst", "edges-by-dst", n))

    @classmethod
    def of(cls, edges: DataFrame, most: int) -> Adjacency:
        """Of edges that are cheap to find again: a side that no traversal reads is not stored."""
        return cls(None, None, edges, most)

    def _side(self, key: str) -> Lookup:
        if self._sides[key] is None:
            other = self._sides["dst" if key == "src" else "src"]
            self._sides[key] = Lookup.write(self._edges if other is None else other.all(), key, f"edges-by-{key}", self._most)
        return self._sides[key]

    @property
    def out(self) -> Lookup:
        return self._side("src")

    @property
    def back(self) -> Lookup:
        return self._side("dst")

    def stored(self) -> list[Lookup]:
        return [side for side in self._sides.values() if side is not None]

    def all(self) -> DataFrame:
        return (self.stored() or [self.out])[0].all()

    def walk(self, sides: list[Lookup], starts: list[str], depth: int, view: DataFrame | None, along=lambda rows: rows) -> tuple[dict[str, int] | None, DataFrame | None]:
        """Distances of the nodes within ``depth`` steps: a dictionary while they are few, else a table (node, distance). ``along``
        picks the edges that are gone along."""
        if not 0 <= depth <= MAX_DEPTH:
            raise invalid(f"depth must lie between 0 and {MAX_DEPTH}")
        inside = lambda df: df if view is None else df.join(view.select(F.col("path").alias("node")), "node", "left_semi")
        first = list(dict.fromkeys(starts))
        if view is not None:
            first = few(view.select("path").where(F.col("path").isin(first)), len(first))
        near = dict.fromkeys(first, 0)
        front = first
        for d in range(1, depth + 1):
            if not front:
                break
            new = reduce(DataFrame.union, [along(side.of(front)).select(F.col("dst" if side.key == "src" else "src").alias("node")) for side in sides])
            got = few(inside(new), KEYS - len(near) if len(near) < KEYS else 0)
            if got is None:
                known = self.sparkSession.createDataFrame(list(near.items()), "node string, distance int")
                return None, _levels(self._steps(sides, along), known, depth, view, d - 1)
            front = [x for x in got if x not in near]
            near.update(dict.fromkeys(front, d))
            if len(near) > KEYS:  # too many for one look-up
                known = self.sparkSession.createDataFrame(list(near.items()), "node string, distance int")
                return None, _levels(self._steps(sides, along), known, depth, view, d)
        return near, None

    def _steps(self, sides: list[Lookup], along) -> DataFrame:
        rows = along(self.all())
        one = {"src": rows.select(F.col("src").alias("a"), F.col("dst").alias("b")), "dst": rows.select(F.col("dst").alias("a"), F.col("src").alias("b"))}
        return reduce(DataFrame.union, [one[side.key] for side in sides])

    def rows_of(self, side: Lookup, near: dict[str, int] | None, table: DataFrame | None) -> DataFrame:
        """Edges of the nodes at hand, with their distance."""
        if near is None:
            return side.all().join(broadcast_if_small(table.withColumnRenamed("node", side.key)), side.key)
        if not near:
            return side.all().where(F.lit(False)).withColumn("distance", F.lit(0))
        at = self.sparkSession.createDataFrame(list(near.items()), f"{side.key} string, distance int")
        return side.of(list(near)).join(F.broadcast(at), side.key)  # at most KEYS rows


def _paths(edges: DataFrame) -> DataFrame:
    return edges.where("to_kind = 'path'") if "to_kind" in edges.columns else edges


def _starts(edges: DataFrame, starts: list[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(s,) for s in starts], "node string")


def deps(edges: DataFrame | Adjacency, starts: list[str], depth: int = 1, view: DataFrame | None = None, max_result: int | None = MAX_RESULT) -> DataFrame:
    """Out-edges of all nodes at distance up to ``depth`` - 1, with that distance; depth 0 has none. Edges to nodes outside
    ``view`` are left out, edges that lead out of the graph (to_kind other than path) stay."""
    if depth == 0:
        return (edges.all() if isinstance(edges, Adjacency) else edges).where(F.lit(False)).withColumn("distance", F.lit(0))
    if isinstance(edges, Adjacency):
        found = edges.rows_of(edges.out, *edges.walk([edges.out], starts, depth - 1, view, _paths))
    else:
        near = _levels(_paths(edges).select(F.col("src").alias("a"), F.col("dst").alias("b")), _starts(edges, starts), depth - 1, view)
        found = edges.join(broadcast_if_small(near.withColumnRenamed("node", "src")), "src")
    if view is not None:
        inside = found.join(view.select(F.col("path").alias("dst")), "dst", "left_semi")
        found = inside.unionByName(found.where("to_kind <> 'path'")) if "to_kind" in edges.columns else inside
    return found if max_result is None else _bounded(materialize(found, "deps"), max_result)


def rdeps(edges: DataFrame | Adjacency, starts: list[str], depth: int = 1, view: DataFrame | None = None, max_result: int | None = MAX_RESULT) -> DataFrame:
    """In-edges of all nodes at distance up to ``depth`` - 1 against the edges' direction."""
    if depth == 0:
        return (edges.all() if isinstance(edges, Adjacency) else edges).where(F.lit(False)).withColumn("distance", F.lit(0))
    if isinstance(edges, Adjacency):
        found = edges.rows_of(edges.back, *edges.walk([edges.back], starts, depth - 1, view))
    else:
        near = _levels(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")), _starts(edges, starts), depth - 1, view)
        found = edges.join(broadcast_if_small(near.withColumnRenamed("node", "dst")), "dst")
    if view is not None:
        found = found.join(view.select(F.col("path").alias("src")), "src", "left_semi")
    return found if max_result is None else _bounded(materialize(found, "rdeps"), max_result)


def neighborhood(edges: DataFrame | Adjacency, starts: list[str], depth: int = 1, view: DataFrame | None = None, max_result: int | None = MAX_RESULT) -> tuple[DataFrame, DataFrame]:
    """(nodes within ``depth`` undirected steps, the edges among them)."""
    if isinstance(edges, Adjacency):
        near, nodes = edges.walk([edges.out, edges.back], starts, depth, view)
        if nodes is None:
            nodes = edges.sparkSession.createDataFrame(list(near.items()), "node string, distance int")
        rows = edges.all() if near is None else edges.out.of(list(near))
    else:
        one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        nodes, rows = _levels(one.union(one.select("b", "a")), _starts(edges, starts), depth, view), edges
    nodes = _bounded(nodes, max_result)
    if depth == 0:
        return nodes, rows.where(F.lit(False))
    near = nodes.select("node")
    inside = rows.join(broadcast_if_small(near.withColumnRenamed("node", "src")), "src", "left_semi")
    return nodes, inside.join(broadcast_if_small(near.withColumnRenamed("node", "dst")), "dst", "left_semi")


def in_order(edges: DataFrame) -> DataFrame:
    """Edges with their ``position`` in the canonical order: source, line, span, specifier."""
    return numbered(edges, "src", "line", "span_start", "span_end", "specifier")


def _in_one_task(batches):
    """Union-find over the edges of one partition: (node, label), label the least node of the component."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    if nodes:
        yield pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "label"])


def connected(edges: DataFrame, rounds: int = MAX_ROUNDS, one_task: int = ONE_TASK) -> DataFrame:
    """(node, label) of the nodes of undirected ``edges`` (a, b): label is the least node reachable. Up to ``one_task`` edges, which
    are counted first, by union-find in one task; beyond that by alternating large-star and small-star steps on written tables: minima
    with map-side partial aggregation, joined back from a table, so that a hot node's edges can be split; rounds in the logarithm
    of the longest chain. It has settled when every child has one parent, which has none."""
    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if e.limit(one_task + 1).count() <= one_task:
        kind = e.schema["a"].dataType.simpleString()
        return materialize(e.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, label {kind}"), "components")
    for _ in range(rounds):
        n = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(n.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        up = n.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        up = materialize(up, "large-star")
        both = up.join(materialize(up.groupBy("a").agg(F.min("b").alias("m")), "lowest"), "a")
        down = both.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = materialize(down.select("e.*").where("a <> b").distinct(), "small-star")
        roles = e.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)).distinct())
        open_ = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
        if not open_.limit(1).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(e.select(F.col("b"), F.col("b")).distinct())
    raise RuntimeError("the components did not settle")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) for all of ``nodes`` (node) and all ends of ``edges`` (src, dst); a node without an edge is its own."""
    found = materialize(connected(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "components")
    alone = nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("label")))


#: Languages whose imports are read and resolved; of PARTIAL ones the resolver never knows all.
IMPORTING, PARTIAL = ("javascript", "jsx", "typescript", "tsx", "vue", "python", "rust"), ("rust",)


def node_flags(analysed: DataFrame, max_imports: int | None = None) -> DataFrame:
    """(path, indexed, has_opaque, imports_supported, imports_complete, resolver_live, resolution_complete) of analysed files (path, language,
    has_opaque, imports): what `forward_exact` asks, as the analysis has it. ``max_imports``: how many imports of a file were resolved."""
    known = F.coalesce(F.col("language").isin(*IMPORTING), F.lit(False))
    whole = F.lit(True) if max_imports is None else F.coalesce(F.size("imports") <= max_imports, F.lit(False))
    flags = {"indexed": F.col("language").isNotNull(), "has_opaque": F.coalesce("has_opaque", F.lit(False)), "imports_supported": known, "imports_complete": whole, "resolver_live": known, "resolution_complete": known & ~F.coalesce(F.col("language").isin(*PARTIAL), F.lit(False))}
    return analysed.select("path", *[v.alias(k) for k, v in flags.items()])


def forward_exact() -> Column:
    """Whether a node's out-edges are complete and right."""
    return F.col("indexed") & ~F.col("has_opaque") & F.col("imports_supported") & F.col("imports_complete") & F.col("resolver_live") & F.col("resolution_complete")


def current(nodes: DataFrame, generation: int) -> DataFrame:
    """Nodes whose imports were resolved (``resolved_at``) under another configuration than that of ``generation`` lose their resolution."""
    return nodes.withColumn("resolution_complete", F.col("resolution_complete") & F.col("resolved_at").eqNullSafe(F.lit(generation)))


def reverse_guarantee(nodes: DataFrame, universe_complete: bool = True) -> DataFrame:
    """One row (guarantee, inexact_nodes): an answer about importers is Exact only over a whole universe in which every node is exact."""
    inexact = F.count_if(~F.coalesce(forward_exact(), F.lit(False)))
    return nodes.agg(F.when((inexact == 0) & universe_complete, "Exact").otherwise("Approximate").alias("guarantee"), inexact.alias("inexact_nodes"))


def deps_guarantee(edges: DataFrame, nodes: DataFrame, starts: list[str], depth: int = 1, view: DataFrame | None = None) -> DataFrame:
    """One row (guarantee, visited, escaped) of `deps` with the same arguments: Approximate where a node whose edges are read is not
    exact or not among ``nodes``, or where an edge leads to a file outside ``view`` (so many do: escaped)."""
    inner = edges.where("to_kind = 'path'") if "to_kind" in edges.columns else edges
    near = _levels(inner.select(F.col("src").alias("a"), F.col("dst").alias("b")), _starts(edges, starts), max(0, depth - 1), view).select("node")
    if depth == 0:
        near = near.where(F.lit(False))
    state = near.join(nodes.select(F.col("path").alias("node"), forward_exact().alias("exact")), "node", "left")
    told = state.agg(F.coalesce(F.bool_and(F.coalesce("exact", F.lit(False))), F.lit(True)).alias("exact"), F.count("*").alias("visited"))
    out = inner.join(near.select(F.col("node").alias("src")), "src", "left_semi")
    out = out.where(F.lit(False)) if view is None else out.join(view.select(F.col("path").alias("dst")), "dst", "left_anti")
    told = told.join(out.agg(F.count("*").alias("escaped")))  # one row each
    return told.select(F.when(F.col("exact") & (F.col("escaped") == 0), "Exact").otherwise("Approximate").alias("guarantee"), "visited", "escaped")


def guarantee(nodes: DataFrame, universe_complete: bool = True) -> DataFrame:
    """One row: exact nodes, all nodes, and the weakest label over all (Exact or Approximate)."""
    return nodes.agg(F.count_if(forward_exact()).alias("exact_nodes"), F.count("*").alias("nodes"), F.when(F.coalesce(F.bool_and(forward_exact()), F.lit(True)) & universe_complete, "Exact").otherwise("Approximate").alias("guarantee"))


def coverage(nodes: DataFrame) -> DataFrame:
    """One row: analyzed and stub nodes."""
    return nodes.agg(F.count_if(F.col("indexed")).alias("analyzed"), F.count_if(~F.col("indexed")).alias("stubs"))


def basis(nodes: DataFrame) -> DataFrame:
    """(path, content_hash) that an answer rests on; unknown hashes are 16 zeros."""
    return nodes.select("path", F.coalesce("content_hash", F.lit("0" * 16)).alias("content_hash"))


def status(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of a whole index: files by state, symbols, edges and components. files: (path, state, language)."""
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    states = ("indexed", "unsupported", "oversize", "pending", "stale", "failed")
    head = files.agg(F.count("*").alias("universe"), *[of(s) for s in states])
    comps = components(files.where("state = 'indexed'").select(F.col("path").alias("node")), edges).agg(F.count_distinct("label").alias("components"))
    return head.join(symbols.agg(F.count("*").alias("symbols"))).join(edges.agg(F.count("*").alias("edges"))).join(comps)


def language_status(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(language, files, symbols)."""
    n = symbols.groupBy("path").agg(F.count("*").alias("n"))
    return files.join(n, "path", "left").groupBy("language").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def stubs(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Targets of path edges that are no file of the index."""
    return edges.where("to_kind = 'path'").select(F.col("dst").alias("path")).distinct().join(files.select("path"), "path", "left_anti")


def replace_edges(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after some sources were parsed anew or removed: old rows of ``changed`` (path) go, ``new`` rows come."""
    return old.join(changed.select(F.col("path").alias("src")), "src", "left_anti").unionByName(new)
