"""A module graph that follows three batches of changes: files named after documents, which import one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.provenance import ModuleGraph
from ..operators.resolve import ENDINGS
from ..storage import exists, materialize
from .catalogue import query, table

#: Endings dealt to files by the language of their document.
BY_LANG = {"en": ".ts", "fr": ".js", "de": ".vue", "es": ".mjs"}
#: Conditions on the document's number d, per batch: modules (a) and folders with an index (b) that appear or vanish, analysed and forgotten modules.
BATCHES = [
    {"a+": "d % 5 <> 0", "b+": "d % 6 = 0", "parse": "d % 5 <> 0 and d % 4 <> 1"},
    {"a+": "d % 5 = 0", "b-": "d % 6 = 0", "parse": "d % 5 = 0"},
    {"a-": "d % 7 = 0", "b+": "d % 6 = 3", "parse": "d % 5 <> 0 and d % 4 = 1 and d % 7 <> 0 and d % 11 <> 0", "forget": "d % 11 = 0 and d % 7 <> 0"},
]

_graphs: dict[tuple, tuple] = {}


def modules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), F.concat("source", F.lit("/d"), F.col("doc_id").cast("string")).alias("stem"), "lang").distinct()
    end = F.coalesce(*[F.when(F.col("lang") == k, e) for k, e in BY_LANG.items()], F.lit(".tsx"))
    return d.select("d", F.concat("stem", end).alias("a"), F.concat("stem", F.lit("/index.ts")).alias("b"))


def imports(rows):
    """Three imports of each module: a neighbour, one of another folder, which may not exist, and a package."""
    specs = [F.concat(F.lit("./d"), (F.col("d") + 20).cast("string")), F.concat(F.lit("../src"), (F.col("d") * 7 % 23).cast("string"), F.lit("/d"), (F.col("d") * 13 % 500).cast("string")), F.concat(F.lit("pkg"), (F.col("d") % 10).cast("string"))]
    one = F.posexplode(F.array(*specs)).alias("k", "specifier")
    return rows.select(F.col("a").alias("path"), one).select("path", "specifier", F.lit("static").alias("kind"), (F.col("k") + 1).cast("long").alias("line"), (F.col("k") * 10).cast("long").alias("span_start"), (F.col("k") * 10 + 5).cast("long").alias("span_end"))


def _kept(graph: ModuleGraph, done: list[dict]) -> list[str]:
    """Where the graph's tables are."""
    tables = (graph.imports, graph.tried, graph.edges, graph.refs, graph.files, graph.nodes)
    return [p.path for t in tables for p in t.parts] + done[-1]["transitions"].inputFiles()[:1]


def followed(spark, sf_dir) -> tuple[ModuleGraph, list[dict]]:
    """The graph after all batches, and what each did; once for a session and a state of the table."""
    key = (spark.sparkContext.applicationId, *table(spark, sf_dir, "documents").inputFiles())
    if key not in _graphs or not all(exists(spark, p) for p in _kept(*_graphs[key])):
        rows, graph, done = materialize(modules(spark, sf_dir), "modules"), ModuleGraph(spark), []
        for b in BATCHES:
            paths = lambda *cs: reduce(lambda x, y: x.union(y), [rows.where(b[c]).select(F.col(c[0]).alias("path")) for c in cs if c in b]) if any(c in b for c in cs) else None  # noqa: B023, E731
            picked = rows.where(b["parse"])
            forgotten = rows.where(b["forget"]).select(F.col("a").alias("path")) if "forget" in b else None
            done.append(graph.advance(paths("a+", "b+"), paths("a-", "b-"), imports(picked), picked.select(F.col("a").alias("path")), forgotten))
        _graphs[key] = graph, done
    return _graphs[key]


_END = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, e in BY_LANG.items()) + " ELSE '.tsx' END"
_TAILS = ", ".join(f"({k}, '{t}')" for k, t in enumerate(["", *ENDINGS, *[f"/index{e}" for e in ENDINGS]]))
SQL = f"""WITH m AS (SELECT DISTINCT doc_id AS d, source || '/d' || doc_id || {_END} AS a, source || '/d' || doc_id || '/index.ts' AS b, source AS s FROM documents),
t AS (SELECT * FROM (VALUES {_TAILS}) v(rank, tail)),
i AS (SELECT d, a AS src, './d' || (d + 20) AS specifier, 1 AS line, s || '/d' || (d + 20) AS root, NULL AS package FROM m
UNION ALL SELECT d, a, '../src' || (d * 7 % 23) || '/d' || (d * 13 % 500), 2, 'src' || (d * 7 % 23) || '/d' || (d * 13 % 500), NULL FROM m UNION ALL SELECT d, a, 'pkg' || (d % 10), 3, NULL, 'pkg' || (d % 10) FROM m),
c AS (SELECT i.*, rank, root || tail AS path FROM i, t WHERE root IS NOT NULL),
f AS (SELECT a AS path FROM m WHERE d % 7 <> 0 UNION SELECT b FROM m WHERE d % 6 = 3),
r AS (SELECT src, line, arg_min(c.path, rank) AS dst FROM c SEMI JOIN f ON c.path = f.path GROUP BY src, line),
e AS (SELECT i.src, coalesce(dst, package, specifier) AS dst, CASE WHEN dst IS NOT NULL THEN 'path' WHEN package IS NOT NULL THEN 'external' ELSE 'unresolved' END AS to_kind, specifier, CAST(i.line AS BIGINT) AS line
FROM i LEFT JOIN r ON r.src = i.src AND r.line = i.line WHERE d % 7 <> 0 AND d % 11 <> 0)"""


@query("module_edges", SQL + " SELECT * FROM e")
def module_edges(spark, sf_dir):
    """Edges after three batches; imports of unchanged files follow the files that came and went."""
    return followed(spark, sf_dir)[0].all_edges().select("src", "dst", "to_kind", "specifier", "line")


@query("module_nodes", SQL + ", n AS (SELECT a AS path FROM m WHERE d % 7 <> 0 AND d % 11 <> 0), k AS (SELECT dst AS path, count(*) AS refs FROM e WHERE to_kind = 'path' GROUP BY dst) SELECT coalesce(n.path, k.path) AS path, CASE WHEN n.path IS NULL THEN 'stub' ELSE 'analyzed' END AS state, coalesce(refs, 0) AS refs FROM n FULL JOIN k ON n.path = k.path")
def module_nodes(spark, sf_dir):
    """Analysed files and stubs with the number of edges that lead to them, kept by signed deltas."""
    return followed(spark, sf_dir)[0].states()


def _touched(batch: int, held: str, moved_a: str, moved_b: str) -> str:
    return f"SELECT {batch} AS batch, count(*) AS touched FROM (SELECT DISTINCT src, line FROM c SEMI JOIN (SELECT a AS path FROM m WHERE {moved_a} UNION ALL SELECT b FROM m WHERE {moved_b}) v ON c.path = v.path WHERE {held})"


@query("module_touched", SQL + " SELECT CAST(0 AS INTEGER) AS batch, CAST(0 AS BIGINT) AS touched UNION ALL " + _touched(1, "d % 5 <> 0 AND d % 4 <> 1", "d % 5 = 0", "d % 6 = 0") + " UNION ALL " + _touched(2, "(d % 5 = 0 OR d % 4 <> 1) AND d % 7 <> 0 AND d % 11 <> 0", "d % 7 = 0", "d % 6 = 3"))
def module_touched(spark, sf_dir):
    """How many imports each batch resolved again: those that tried a path that moved, no others."""
    done = followed(spark, sf_dir)[1]
    return spark.createDataFrame([(k, d["touched"]) for k, d in enumerate(done)], "batch int, touched long")


@query("module_transitions", SQL + """, k AS (SELECT a AS path, d % 5 <> 0 AND d % 4 <> 1 OR d % 5 = 0 AS before, d % 7 <> 0 AND d % 11 <> 0 AS after FROM m), g AS (SELECT a AS path FROM m UNION SELECT b FROM m WHERE d % 6 = 0),
x AS (SELECT i.src, i.line, arg_min(c.path, rank) AS dst FROM i JOIN c ON c.src = i.src AND c.line = i.line SEMI JOIN (SELECT a AS path FROM m) q ON c.path = q.path WHERE i.d % 5 = 0 OR i.d % 4 <> 1 GROUP BY i.src, i.line),
o AS (SELECT dst AS path FROM x GROUP BY dst), p AS (SELECT dst AS path FROM e WHERE to_kind = 'path' GROUP BY dst), u AS (SELECT path FROM k UNION SELECT path FROM o UNION SELECT path FROM p),
w AS (SELECT u.path, CASE WHEN coalesce(before, false) THEN 'analyzed' WHEN o.path IS NOT NULL THEN 'stub' ELSE 'none' END AS was, CASE WHEN coalesce(after, false) THEN 'analyzed' WHEN p.path IS NOT NULL THEN 'stub' ELSE 'none' END AS now
FROM u LEFT JOIN k ON k.path = u.path LEFT JOIN o ON o.path = u.path LEFT JOIN p ON p.path = u.path) SELECT * FROM w WHERE was <> now""")
def module_transitions(spark, sf_dir):
    """Nodes that the last batch promoted, made stubs, brought or pruned."""
    return followed(spark, sf_dir)[1][-1]["transitions"]
