"""Symbol and graph operators over the standard tables: parts as symbols, foreign keys and page links as edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import symbols as sy
from ..storage import exists, materialize
from .catalogue import query, table

#: Kinds dealt to parts by size.
KINDS = ["function", "method", "class", "struct", "interface", "enum", "trait", "type", "module", "constant", "field"]


def part_symbols(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("p_size") % 11 + 1)
    return p.select(F.concat_ws("/", F.lit("part"), "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.lit(0).alias("idx"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_size").cast("long").alias("line"), (F.col("p_size") % 3).alias("depth"))


PARTS = "s AS (SELECT 'part/' || p_brand || '/' || p_partkey AS path, p_name AS name, [" + ",".join(f"'{k}'" for k in KINDS) + "][p_size % 11 + 1] AS kind, p_size % 11 AS pri, CAST(p_size AS BIGINT) AS line, p_size % 3 AS depth FROM part)"


@query("definitions", f"WITH {PARTS} SELECT path, name, kind, line, depth FROM s WHERE lower(name) = 'hot ring' ORDER BY pri, depth, path, line LIMIT 25")
def definitions(spark, sf_dir):
    return sy.definitions(part_symbols(spark, sf_dir), "Hot Ring", 25).select("path", "name", "kind", "line", "depth")


def score_sql(needle: str) -> str:
    at, first = "0", "strpos(n, '%s')" % needle[0]
    ok = []
    for c in needle:
        nxt = f"(CASE WHEN strpos(substr(n, {at} + 1), '{c}') > 0 THEN {at} + strpos(substr(n, {at} + 1), '{c}') ELSE 0 END)"
        ok.append(f"strpos(substr(n, {at} + 1), '{c}') > 0")
        at = nxt
    return f"""CASE WHEN n = '{needle}' THEN 10000 - len(n) WHEN starts_with(n, '{needle}') THEN 8000 - len(n)
WHEN contains(n, '{needle}') THEN CASE WHEN substr(n, strpos(n, '{needle}') - 1, 1) IN ('_', '-', '.', ':') AND strpos(n, '{needle}') > 1 THEN 6000 ELSE 4000 END - (strpos(n, '{needle}') - 1) - len(n)
WHEN {' AND '.join(ok)} THEN 2000 - least({at} - {first} - {len(needle) - 1}, 1000) - len(n) END"""


SEARCH = f"WITH {PARTS}, q AS (SELECT *, lower(name) AS n FROM s), r AS (SELECT *, CAST({{}} AS INTEGER) AS score FROM q) SELECT path, name, line, score FROM r WHERE score IS NOT NULL {{}} ORDER BY score DESC, strlen(name), path, line LIMIT {{}}"


@query("search_fuzzy", SEARCH.format(score_sql("rng"), "", 300))
def search_fuzzy(spark, sf_dir):
    return sy.search(part_symbols(spark, sf_dir), " RNG ", 300).select("path", "name", "line", "score")


@query("search_filtered", SEARCH.format(score_sql("red"), "AND path LIKE 'part/Brand#1%'", 200))
def search_filtered(spark, sf_dir):
    s = part_symbols(spark, sf_dir)
    return sy.search(s, "red", view=s.where(F.startswith("path", F.lit("part/Brand#1"))).select("path")).select("path", "name", "line", "score")


_indexes: dict[tuple, sy.SymbolIndex] = {}


def part_index(spark, sf_dir) -> sy.SymbolIndex:
    """The parts' symbols stored for look-up, once for a session and a state of the table."""
    key = (spark.sparkContext.applicationId, *table(spark, sf_dir, "part").inputFiles())
    if key not in _indexes or not all(exists(spark, p) for p in (_indexes[key].by_name.path, _indexes[key].grams.path, *_indexes[key].names.inputFiles()[:1])):
        _indexes[key] = sy.SymbolIndex.build(part_symbols(spark, sf_dir))
    return _indexes[key]


@query("index_definitions", f"WITH {PARTS} SELECT path, name, kind, line, depth FROM s WHERE lower(name) = 'hot ring' ORDER BY pri, depth, path, line LIMIT 25")
def index_definitions(spark, sf_dir):
    return part_index(spark, sf_dir).definitions("HOT ring", 25).select("path", "name", "kind", "line", "depth")


@query("index_search_substring", SEARCH.format(score_sql("ring"), "", 40))
def index_search_substring(spark, sf_dir):
    """More matches of the needle itself than asked for: the grams answer."""
    return part_index(spark, sf_dir).search("Ring", 40).select("path", "name", "line", "score")


@query("index_search_letters", SEARCH.format(score_sql("hrng"), "", 300))
def index_search_letters(spark, sf_dir):
    """No name holds the needle: the distinct names that hold its letters are scored."""
    return part_index(spark, sf_dir).search("hrng", 300).select("path", "name", "line", "score")


def fk_rows(spark, sf_dir, which=("order", "line", "customer", "supplier", "nation")):
    """Foreign keys as edges (src, dst)."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, a, x, b, y: df.select(F.concat(F.lit(a + "/"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b + "/"), F.col(y).cast("string")).alias("dst"))

    def lines():
        """The distinct parts and suppliers of each order, as numbers: an order's lines meet in one shuffle, which both read."""
        rows = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey").repartition("l_orderkey")
        return [e(rows.select("l_orderkey", key).distinct(), "order", "l_orderkey", name, key) for name, key in (("part", "l_partkey"), ("supplier", "l_suppkey"))]

    made = {
        "order": lambda: [e(t("orders"), "order", "o_orderkey", "customer", "o_custkey")],
        "line": lines,
        "customer": lambda: [e(t("customer"), "customer", "c_custkey", "nation", "c_nationkey")],
        "supplier": lambda: [e(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey")],
        "nation": lambda: [e(t("nation"), "nation", "n_nationkey", "region", "n_regionkey")],
    }
    return reduce(lambda a, b: a.unionByName(b), [x for w in which for x in made[w]()])


def fk_edges(spark, sf_dir, which=("order", "line", "customer", "supplier", "nation")):
    """`fk_rows`, written once."""
    return materialize(fk_rows(spark, sf_dir, which), "foreign-keys")


_stored: dict[tuple, gr.Adjacency] = {}


def adjacency(spark, sf_dir) -> gr.Adjacency:
    """The foreign keys as adjacency tables: each stored when it is first read, once for a session and a state of the tables."""
    names = ("orders", "lineitem", "customer", "supplier", "nation")
    key = (spark.sparkContext.applicationId, *sorted(f for n in names for f in table(spark, sf_dir, n).inputFiles()))
    if key not in _stored or not all(exists(spark, side.path) for side in _stored[key].stored()):
        most = sum(table(spark, sf_dir, n).count() * (2 if n == "lineitem" else 1) for n in names)
        _stored[key] = gr.Adjacency.of(fk_rows(spark, sf_dir), most)
    return _stored[key]


FK = """e AS MATERIALIZED (SELECT 'order/' || o_orderkey AS src, 'customer/' || o_custkey AS dst FROM orders UNION SELECT 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem
UNION SELECT 'order/' || l_orderkey, 'supplier/' || l_suppkey FROM lineitem UNION SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer
UNION SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation)"""
STARTS = ["order/1", "order/2", "order/3"]


def deps_sql(depth: int, starts: list[str], back: bool = False) -> str:
    a, b = ("dst", "src") if back else ("src", "dst")
    return f"""WITH RECURSIVE {FK}, r(node, distance) AS (SELECT unnest([{','.join(f"'{s}'" for s in starts)}]), 0 UNION SELECT e.{b}, distance + 1 FROM r JOIN e ON e.{a} = r.node WHERE distance < {depth - 1}),
m AS (SELECT node, min(distance) AS distance FROM r GROUP BY node) SELECT src, dst, CAST(distance AS INTEGER) AS distance FROM e JOIN m ON e.{a} = m.node"""


@query("adjacency_degrees", f"WITH {FK}, o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src), b AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY dst) SELECT coalesce(o.node, b.node) AS node, coalesce(o.n, 0) AS out_edges, coalesce(b.n, 0) AS in_edges FROM o FULL JOIN b ON o.node = b.node")
def adjacency_degrees(spark, sf_dir):
    """Builds both tables if they are not stored yet."""
    a = adjacency(spark, sf_dir)
    out, back = a.out.all().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out_edges")), a.back.all().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_edges"))
    return out.join(back, "node", "full").fillna(0)


for _d in (1, 2, 3):

    @query(f"deps_depth{_d}", deps_sql(_d, STARTS))
    def deps(spark, sf_dir, depth=_d):
        return gr.deps(adjacency(spark, sf_dir), STARTS, depth, max_result=None).select("src", "dst", "distance")


for _d in (1, 2):

    @query(f"rdeps_depth{_d}", deps_sql(_d, ["nation/3"], back=True))
    def rdeps(spark, sf_dir, depth=_d):
        return gr.rdeps(adjacency(spark, sf_dir), ["nation/3"], depth, max_result=None).select("src", "dst", "distance")


NEIGHBORHOOD = f"""WITH RECURSIVE {FK}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(node, distance) AS (SELECT 'supplier/1', 0 UNION SELECT u.b, distance + 1 FROM r JOIN u ON u.a = r.node WHERE distance < 1),
m AS (SELECT DISTINCT node FROM r) SELECT src, dst FROM e WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)"""


@query("neighborhood", NEIGHBORHOOD)
def neighborhood(spark, sf_dir):
    return gr.neighborhood(adjacency(spark, sf_dir), ["supplier/1"], 1, max_result=None)[1].select("src", "dst")


COMPONENTS = """WITH c AS (SELECT 'customer/' || c_custkey AS node, 'nation/' || c_nationkey AS n FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation),
k AS (SELECT DISTINCT node, n_regionkey AS r FROM c JOIN nation ON n = 'nation/' || n_nationkey), m AS (SELECT r, min(node) AS label FROM k GROUP BY r) SELECT node, label FROM k JOIN m USING (r)"""


@query("components", COMPONENTS)
def components(spark, sf_dir):
    e = fk_edges(spark, sf_dir, ("customer", "nation"))
    return gr.components(e.select(F.col("src").alias("node")), e).select("node", "label")


@query("components_stars", COMPONENTS)
def components_stars(spark, sf_dir):
    """The distributed way of components, whatever their size."""
    e = fk_edges(spark, sf_dir, ("customer", "nation"))
    return gr.connected(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), one_task=0).select("node", "label")


@query("graph_status", """WITH f AS (SELECT CASE WHEN c_acctbal < 0 THEN 'failed' WHEN c_mktsegment = 'BUILDING' THEN 'unsupported' ELSE 'indexed' END AS state, c_nationkey AS n FROM customer)
SELECT count(*) AS universe, count(*) FILTER (WHERE state = 'indexed') AS indexed, count(*) FILTER (WHERE state = 'unsupported') AS unsupported, CAST(0 AS BIGINT) AS oversize, CAST(0 AS BIGINT) AS pending, CAST(0 AS BIGINT) AS stale,
count(*) FILTER (WHERE state = 'failed') AS failed, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM f WHERE state = 'indexed') AS edges, (SELECT count(DISTINCT n) FROM f WHERE state = 'indexed') AS components FROM f""")
def graph_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    state = F.when(F.col("c_acctbal") < 0, "failed").when(F.col("c_mktsegment") == "BUILDING", "unsupported").otherwise("indexed")
    files = c.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"), state.alias("state"), F.concat(F.lit("nation/"), F.col("c_nationkey").cast("string")).alias("dst"))
    edges = files.where("state = 'indexed'").select(F.col("path").alias("src"), "dst")
    return gr.status(files, part_symbols(spark, sf_dir), edges)


@query("language_status", "SELECT lang AS language, count(*) AS files, CAST(sum(len(regexp_extract_all(text, '[A-Z][a-z]+tion'))) AS BIGINT) AS symbols FROM documents GROUP BY lang")
def language_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("lang").alias("language"), "text")
    return gr.language_status(d.select("path", "language"), d.select("path", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+tion"), F.lit(0))).alias("name")))


def label_nodes(spark, sf_dir):
    flags = {"has_opaque": F.col("toxic") == 1, "imports_supported": F.col("quality") == 1, "imports_complete": F.lit(True), "resolver_live": F.lit(True), "resolution_complete": F.col("doc_id") % 7 != 0}
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("path"), (F.col("doc_id") % 11 != 0).alias("indexed"), *[v.alias(k) for k, v in flags.items()])


EXACT = "(doc_id % 11 <> 0 AND toxic <> 1 AND quality = 1 AND doc_id % 7 <> 0)"


@query("guarantee_fold", f"SELECT count(*) FILTER (WHERE {EXACT}) AS exact_nodes, count(*) AS nodes, CASE WHEN bool_and({EXACT}) THEN 'Exact' ELSE 'Approximate' END AS guarantee FROM labels")
def guarantee_fold(spark, sf_dir):
    return gr.guarantee(label_nodes(spark, sf_dir))


@query("coverage", "SELECT count(*) FILTER (WHERE doc_id % 11 <> 0) AS analyzed, count(*) FILTER (WHERE doc_id % 11 = 0) AS stubs FROM labels")
def coverage(spark, sf_dir):
    return gr.coverage(label_nodes(spark, sf_dir))


@query("coverage_basis", "SELECT source || '/' || lang || '/' || doc_id AS path, substr(md5(text), 1, 16) AS content_hash FROM documents")
def coverage_basis(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return gr.basis(d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.substring(F.md5("text"), 1, 16).alias("content_hash")))
