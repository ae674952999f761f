import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.operators import graph as gr
from textmill.operators import lookup
from textmill.operators.lookup import Lookup, few


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def made(spark, n=120, edges=400, seed=4):
    r = random.Random(seed)
    rows = {(f"n{min(r.randrange(n), r.randrange(n))}", f"n{r.randrange(n)}", "path") for _ in range(edges)} | {("n0", f"n{k}", "path") for k in range(60)} | {("n1", "react", "external"), ("n2", "./x", "unresolved")}
    return spark.createDataFrame(sorted(rows), "src string, dst string, to_kind string")


@pytest.mark.parametrize("keys", [2000, 7])
def test_adjacency_gives_what_a_scan_gives(spark, keys, monkeypatch):
    """Also where a frontier outgrows the driver's share on its way."""
    monkeypatch.setattr(lookup, "KEYS", keys)
    monkeypatch.setattr(gr, "KEYS", keys)
    monkeypatch.setattr(lookup, "ROWS_PER_BUCKET", 50)
    edges = made(spark)
    a = gr.Adjacency.build(edges)
    view = edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct().where("hash(path) % 3 <> 0").cache()
    cols = ["src", "dst", "distance"]
    for starts, depth, v in ((["n40", "n90"], 1, None), (["n40"], 3, None), (["n0", "absent"], 2, view), (["n5"], 0, None)):
        assert pairs(gr.deps(edges, starts, depth, v).select(cols)) == pairs(gr.deps(a, starts, depth, v).select(cols)), (starts, depth)
    for starts, depth in ((["n7"], 1), (["n7"], 3), (["react"], 2)):
        assert pairs(gr.rdeps(edges, starts, depth).select(cols)) == pairs(gr.rdeps(a, starts, depth).select(cols)), (starts, depth)
    for depth in (0, 1, 2):
        (n1, e1), (n2, e2) = gr.neighborhood(edges, ["n99"], depth), gr.neighborhood(a, ["n99"], depth)
        assert pairs(n1.select("node", "distance")) == pairs(n2.select("node", "distance")) and pairs(e1) == pairs(e2.select(*e1.columns))


def test_look_ups_read_the_folders_and_row_groups_of_their_keys(spark, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_PER_BUCKET", 2000)
    rows = spark.range(40_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("body"))
    t = Lookup.write(rows, "key", "lookup")
    assert t.buckets == 20 and t.all().count() == 40_000
    found = t.of(["k7", "k39999", "none"])
    assert sorted(r.key for r in found.collect()) == ["k39999", "k7"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*_bucket.*IN ", plan) and re.search(r"PushedFilters: \[.*In\(key", plan), plan

    def read(df):
        """Bytes that a job's stages read."""
        store = spark.sparkContext._jsc.sc().statusStore()
        stages = lambda: {s.stageId(): s.inputBytes() for s in (lambda q: [q.apply(k) for k in range(q.size())])(store.stageList(None, False, False, spark._jvm.scala.Array.emptyDoubleArray(), None))}
        before = stages()
        df.write.format("noop").mode("overwrite").save()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return sum(v for k, v in stages().items() if k not in before)

    try:
        some, every = read(t.of(["k7"])), read(t.all())
    except Exception as e:  # the status store's signature is Spark's own
        pytest.skip(f"no stage figures: {e}")
    assert 0 < some < every / 10


def test_a_hot_key_is_spread_over_files(spark):
    rows = spark.range(8000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"), "id")
    t = Lookup.write(rows, "key", "hot")
    files = t.of(["hot"]).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and sum(r["count"] for r in files) == 4000


def test_few(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    assert sorted(few(df)) == ["a", "b"] and few(df, 1) is None and few(df.where("false"), 0) == []
    t = Lookup.write(spark.createDataFrame([("a", 1), ("c", 2)], "k string, n int"), "k", "frame")
    assert pairs(t.of_frame(df)) == [("a", 1)]
    with pytest.raises(ValueError, match="join"):
        t.of([str(k) for k in range(lookup.KEYS + 1)])
    assert Lookup.write(t.all().where("false"), "k", "none").all().count() == 0


def test_traversal_queries_have_no_bound(spark, sf, monkeypatch):
    """Their SQL has none: a result beyond the default bound is no error."""
    from textmill.plans import graph_queries  # noqa: F401
    from textmill.plans.catalogue import QUERIES

    bounded = gr._bounded
    monkeypatch.setattr(gr, "_bounded", lambda df, most: bounded(df, None if most is None else 5))
    for name in ("rdeps_depth2", "deps_depth2", "neighborhood"):
        assert QUERIES[name](spark, sf).count() > 5


def test_a_side_that_no_traversal_reads_is_not_stored(spark):
    edges = made(spark)
    a = gr.Adjacency.of(edges, edges.count())
    cols = ["src", "dst", "distance"]
    assert pairs(gr.deps(edges, ["n40"], 2).select(cols)) == pairs(gr.deps(a, ["n40"], 2).select(cols))
    assert [side.key for side in a.stored()] == ["src"]
    assert pairs(gr.rdeps(edges, ["n7"], 2).select(cols)) == pairs(gr.rdeps(a, ["n7"], 2).select(cols))
    assert [side.key for side in a.stored()] == ["src", "dst"] and pairs(a.back.all()) == pairs(edges)
