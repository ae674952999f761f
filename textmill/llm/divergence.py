"""Source divergence audit: how the words of each source differ from those of the other sources and of its language as a whole.

Terms are counted by DuckDB inside the tasks: where texts are read, vectorized SQL counts terms by (lang, source) and their
documents, so that a term leaves a task once for each of its sources. The counts are hashed to shards by (lang, term); a shard's SQL
adds them up, keeps the terms of at least ``least_docs`` documents of their language and, once the totals of all shards are known,
gives partial sums for pairs of sources and its best terms. Spark merges sums and ranks.

With p = 1 + floor(1e9 (count + 1) / (N + V)), N the sum of counts of V kept terms, a pair's value is the sum over all kept terms of
f(p, q) = floor((p - q)^2 / q), exact in integers. Most terms are absent from most sources, so a shard only meets the pairs of
sources that share a term: for those it gives f(p, q) - f(p, q0) - f(p0, q), p0 and q0 being what an absent term has. The rest comes from
how many terms of a source have which p, a small table, and from the number of terms that both lack.

Defined cases: null text, lang and source are ''; a group without terms has N = 0; a language without kept terms gives
pairs of value 0; a language with one source gives no pair; repeated rows count each; an empty table gives no row; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, materialize, release

SCALE = 1_000_000_000
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts that a reading task holds before it passes them on, and what DuckDB may hold before it uses the task's own temporary folder.
HELD_ROWS, HELD_MEMORY = 1_500_000, "400MB"

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long, total long, first long"
PARTIAL = "part string, lang string, source string, item string, value long, both long"

_COUNT = f"""INSERT INTO held SELECT lang, source, term, sum(n), count(*) FROM (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM batch) GROUP BY ALL) GROUP BY ALL"""
_SUMMED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
_KEEP = f"""SELECT lang, source, term, n, total, first FROM (
  SELECT lang, source, term, n, (sum(n) OVER t)::BIGINT AS total, sum(docs) OVER t AS docs, (row_number() OVER (t ORDER BY source) = 1)::BIGINT AS first
  FROM ({_SUMMED}) WINDOW t AS (PARTITION BY lang, term)) WHERE docs >= ?"""
_F = "(({0} - {1}) * ({0} - {1})) // {1}"
_PAIRS = f"""SELECT 'pair', a.lang, a.source, b.source, sum({_F.format('a.p', 'b.p')} - {_F.format('a.p', 'b.p0')} - {_F.format('a.p0', 'b.p')})::BIGINT, count(*)
FROM held a JOIN held b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
_TERMS = f"""SELECT 'term', lang, source, term, value, NULL::BIGINT FROM (SELECT lang, source, term, {_F.format('p', 'q')} AS value FROM held WHERE p > q)
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) <= ?"""


class _Shard:
    """A DuckDB database of one task: one thread, bounded memory, a temporary folder that goes with it."""

    def __init__(self, columns: str):
        import tempfile

        import duckdb

        self.folder = tempfile.TemporaryDirectory(prefix="shard-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": HELD_MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        self.columns = columns.replace(" string", " VARCHAR").replace(" long", " BIGINT")
        self.clear()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.db.close()
        self.folder.cleanup()
        release()

    def clear(self) -> None:
        self.db.execute(f"CREATE OR REPLACE TABLE held ({self.columns})").fetchall()

    def add(self, batch, sql: str = "INSERT INTO held SELECT * FROM batch") -> None:
        import pyarrow as pa

        self.db.register("batch", pa.Table.from_batches([batch]))
        self.db.execute(sql).fetchall()
        self.db.unregister("batch")

    def rows(self) -> int:
        return self.db.execute("SELECT count(*) FROM held").fetchall()[0][0]

    def give(self, sql: str, schema, *args) -> Iterator:
        """The rows of a query as Arrow batches of ``schema``."""
        for b in self.db.execute(sql, list(args)).to_arrow_reader(50_000):
            if b.num_rows:
                yield type(b).from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def term_counts(docs: DataFrame, held_rows: int = HELD_ROWS) -> DataFrame:
    """Partial counts (lang, source, term, n, docs) of all texts, one task's or less each; to be added up."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    schema = _arrow(COUNTS)

    def count(batches: Iterator) -> Iterator:
        with _Shard(COUNTS) as shard:
            for b in batches:
                shard.add(b.append_column("r", pa.array(range(b.num_rows), pa.int32())), _COUNT)
                if shard.rows() > held_rows:
                    yield from shard.give(_SUMMED, schema)
                    shard.clear()
            yield from shard.give(_SUMMED, schema)

    return rows.mapInArrow(count, COUNTS)


def kept_terms(counts: DataFrame, least_docs: int = 3) -> DataFrame:
    """(lang, source, term, n, total, first) of the terms in at least ``least_docs`` documents of their language: n occurrences in the
    source, total in the language; first is 1 in one row of each term. A shard is a partition by (lang, term)."""
    schema = _arrow(KEPT)

    def keep(batches: Iterator) -> Iterator:
        with _Shard(COUNTS) as shard:
            for b in batches:
                shard.add(b)
            yield from shard.give(_KEEP, schema, least_docs)

    return counts.repartition("lang", "term").mapInArrow(keep, KEPT)


def _share(count: Column | int, n: Column, v: Column) -> Column:
    """p of a term with ``count`` occurrences among n of v kept terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    count = count if isinstance(count, Column) else F.lit(count).cast("long")
    exact = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(1).cast("decimal(1,0)")), wide(n + v))
    return F.when(n + v > 0, F.lit(1) + exact).otherwise(F.lit(1)).cast("long")


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shard_sums(kept: DataFrame, groups: DataFrame, most_terms: int) -> DataFrame:
    """PARTIAL rows of all shards: sums over the terms that two sources share, and each shard's best terms of each group."""
    schema = _arrow(PARTIAL)
    ddl = "lang string, source string, term string, p long, p0 long, q long"

    def add(batches: Iterator) -> Iterator:
        with _Shard(ddl) as shard:
            for b in batches:
                shard.add(b)
            yield from shard.give(_PAIRS, schema)
            yield from shard.give(_TERMS, schema, most_terms)

    rows = kept.join(broadcast_if_small(groups), ["lang", "source"])
    rows = rows.select("lang", "source", "term", _share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), "p0", _share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    return rows.repartition("lang", "term").mapInArrow(add, PARTIAL)


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, group_n, terms, lang_n, v, p0) of every group that occurs: occurrences and number of its kept terms, those of its
    language, and p of a kept term that it lacks."""
    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("terms"), F.sum("first").alias("firsts"))
    own = every.join(own, ["lang", "source"], "left").fillna(0)
    whole = Window.partitionBy("lang")  # over a row for each source
    own = own.withColumn("lang_n", F.sum("group_n").over(whole)).withColumn("v", F.sum("firsts").over(whole)).drop("firsts")
    return own.withColumn("p0", _share(0, F.col("group_n"), F.col("v")))


def _pairs(sums: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language."""
    totals = groups.select("lang", "source", "terms", "v", "p0")
    other = broadcast_if_small(totals.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), F.col("p0").alias("q0")))
    told = kept.join(broadcast_if_small(groups), ["lang", "source"]).select("lang", "source", _share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"))
    told = told.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).join(other, "lang").where("source <> item")
    sides = F.array(F.struct("source", "item", (F.col("k") * _f("p", "q0")).alias("s")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("k") * _f("q0", "p")).alias("s")))
    alone = told.select("lang", F.explode(sides).alias("x")).select("lang", "x.*", F.lit(0).cast("long").alias("both"))
    parts = alone.unionByName(sums.where("part = 'pair'").select("lang", "source", "item", F.col("value").alias("s"), "both"))
    parts = parts.groupBy("lang", "source", "item").agg(F.sum("s").alias("s"), F.sum("both").alias("both"))
    every = totals.join(other, "lang").where("source <> item").join(parts, ["lang", "source", "item"], "left").fillna(0, ["s", "both"])
    absent = F.col("v") - F.col("terms") - F.col("item_terms") + F.col("both")
    return every.select("lang", "source", "item", (F.col("s") + absent * _f("p0", "q0")).alias("value"))


def divergence(docs: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other sources of the language by how far the source is from them, part
    `term` the ``most_terms`` terms that it uses most above its language's use."""
    kept = materialize(kept_terms(term_counts(docs), least_docs), "terms")
    groups = materialize(group_totals(docs, kept), "groups")
    sums = materialize(shard_sums(kept, groups, most_terms), "sums")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(sums, kept, groups).withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = sums.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most_terms)
    return pairs.unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS gn, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (gn + v))::BIGINT AS p FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS MATERIALIZED (SELECT lang, term, (1 + (1000000000::HUGEINT * (sum(n) + 1)) // (any_value(total) + any_value(v)))::BIGINT AS q FROM c JOIN (SELECT lang, sum(gn) AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term) WHERE rank <= 200"""
