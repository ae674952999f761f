"""Sweeps, change logs, sessions, chunks and profiles over the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sweep as sw
from ..streaming import chunks as ch
from .catalogue import query, table

VERSIONS = """a AS (SELECT CAST(doc_id AS VARCHAR) AS path, n_chars AS size, CAST(0 AS BIGINT) AS mtime, md5(text) AS h FROM documents),
b AS (SELECT CASE WHEN doc_id % 10 = 1 THEN 'moved/' ELSE '' END || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CAST(doc_id % 5 AS BIGINT) AS mtime, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents)"""


def versions(spark, sf_dir):
    """Two versions of all documents: of ten one moves (removed and added), of seven one changes, most are touched."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("doc_id").cast("string").alias("path"), "text", F.col("n_chars").alias("size"))
    old = d.select("path", "size", F.lit(0).cast("long").alias("mtime_ns"), F.md5("text").alias("hash"), "text")
    text = F.when(F.col("i") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    size = F.when(F.col("i") % 7 == 0, F.col("size") + 1).otherwise(F.col("size"))
    path = F.when(F.col("i") % 10 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    new = d.select(path.alias("path"), size.alias("size"), (F.col("i") % 5).alias("mtime_ns"), F.md5(text).alias("hash"), text.alias("text"))
    return old, new


CHANGE = "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'modified' WHEN a.size = b.size AND a.mtime = b.mtime THEN 'same' ELSE 'touched' END AS change FROM a FULL JOIN b ON a.path = b.path"


@query("sweep_changes", f"WITH {VERSIONS} {CHANGE}")
def sweep_changes(spark, sf_dir):
    return sw.changes(*versions(spark, sf_dir))


@query("sweep_apply", f"WITH {VERSIONS} SELECT path, h AS hash FROM b")
def sweep_apply(spark, sf_dir):
    old, new = versions(spark, sf_dir)
    change = sw.changes(old, new)
    parsed = new.join(change.where("change in ('added', 'modified')").select("path"), "path", "left_semi")
    return sw.apply(old.select("path", "hash"), change, parsed.select("path", "hash"))


PREFETCH = """WITH i AS (SELECT 'page/' || page_id AS seed, unnest(range(0, len(f))) AS pos, unnest(f) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS f FROM pages)),
s AS (SELECT 'page/' || page_id AS seed, row_number() OVER (ORDER BY 'page/' || page_id) AS sn FROM pages), f AS (SELECT '/' || split_part(p_name, ' ', 1) AS target, max(p_size) AS size FROM part GROUP BY 1 UNION ALL SELECT '/the', 5 UNION ALL SELECT '/de', 99),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS n FROM i JOIN s USING (seed)), o AS (SELECT *, CASE WHEN sn > 32 THEN 'seed limit' WHEN n > 4 THEN 'import limit' END AS x FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY target, x IS NULL ORDER BY sn, n) AS k FROM o), e AS (SELECT seed, target, CASE WHEN x IS NOT NULL THEN x WHEN k > 1 THEN 'duplicate' WHEN f.size IS NULL THEN 'missing' WHEN f.size > 50 THEN 'too large' ELSE 'fetched' END AS outcome FROM d LEFT JOIN f USING (target))
SELECT outcome, count(*) AS n FROM e GROUP BY outcome"""


@query("prefetch_skips", PREFETCH)
def prefetch_skips(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path")
    imports = p.select(path, F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("pos", "target"))
    files = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("/"), F.substring_index("p_name", " ", 1)).alias("path")).agg(F.max("p_size").alias("size"))
    files = files.unionByName(spark.createDataFrame([("/the", 5), ("/de", 99)], "path string, size int"))
    return sw.prefetch(p.select(path), imports, files, per_seed=4, file_bytes=50).groupBy("outcome").agg(F.count("*").alias("n"))


@query("chunk_reassemble", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS chunks FROM conversations GROUP BY conv_id")
def chunk_reassemble(spark, sf_dir):
    return ch.reassemble(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")


SESSIONS = """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS events FROM g GROUP BY user_id, s"""


@query("idle_sessions", SESSIONS)
def idle_sessions(spark, sf_dir):
    return ch.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


LOG = "l AS (SELECT event_id AS revision, 'user/' || user_id AS path FROM events), m AS (SELECT max(revision) AS last FROM l)"


@query("invalidation_since", f"WITH {LOG} SELECT revision, path FROM l, m WHERE revision > 900 AND revision >= last - 20000000 + 1 UNION ALL SELECT last, NULL FROM m WHERE last - 4096 + 1 > 101")
def invalidation_since(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("revision"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"))
    return ch.since(log, 900, ring=20_000_000).unionByName(ch.since(log, 100).where("path is null"))


@query("event_effects", "SELECT event_id, event_type, event_type <> 'view' AS drops_content, event_type NOT IN ('view', 'click') AS drops_walk, event_type <> 'view' AS recorded FROM events")
def event_effects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "access").when(F.col("event_type") == "click", "modify").otherwise("create")
    return ch.effects(e.select("event_id", "event_type", kind.alias("event"))).drop("event")


PROFILE = """WITH e AS (SELECT event_type AS name, CAST(floor(abs(value) * 1000) AS BIGINT) AS us FROM events), b AS (SELECT name, CAST(least(floor(log2(greatest(us, 1))), 47) AS INTEGER) AS b, count(*) AS n, sum(us) AS t, min(us) AS lo, max(us) AS hi FROM e GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY name ORDER BY b) AS c, sum(n) OVER (PARTITION BY name) AS a FROM b)
SELECT name, CAST(sum(n) AS BIGINT) AS count, CAST(sum(t) AS BIGINT) AS total_us, min(lo) AS min_us, max(hi) AS max_us, CAST(min(CASE WHEN c >= ceil(a * 0.5) THEN pow(2, b + 1) END) AS BIGINT) AS p50_us, CAST(min(CASE WHEN c >= ceil(a * 0.99) THEN pow(2, b + 1) END) AS BIGINT) AS p99_us FROM c GROUP BY name"""


@query("profile_report", PROFILE)
def profile_report(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.floor(F.abs("value") * 1000).cast("long").alias("us"))
    return ch.profile(e)


@query("hitrate_ticks", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS hits FROM events GROUP BY 1")
def hitrate_ticks(spark, sf_dir):
    return ch.ticks(table(spark, sf_dir, "events"), "ts", "1 hour", F.col("event_type") == "view")
