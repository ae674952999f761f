import random

from textmill.operators import spans as sp
from textmill.operators import symbols as sy


def test_innermost_equals_trial(spark):
    r = random.Random(3)
    spans = [(p, k, s, s + n) for p in "ab" for k in range(60) for s, n in [(r.randint(0, 500), r.choice([0, 1, 2, 3, 7, 8, 9, 64, 65, 300, 2**40]))]]
    spans += [("a", 100, 5, 9), ("a", 101, 5, 9), ("a", 102, None, 9), (None, 103, 0, 9), ("a", 104, 9, 5)]
    places = [(p, k, r.randint(0, 600)) for p in "abc" for k in range(80)] + [("a", 900, None), ("a", 901, 2**39), ("a", 902, 5)]
    s, q = spark.createDataFrame(spans, "path string, id int, start long, end long"), spark.createDataFrame(places, "path string, k int, at long")
    held = lambda p, at: [x for x in spans if x[0] == p and at is not None and x[2] is not None and x[2] <= at < x[3]]
    got = sorted((x.path, x.k, x.span.id) for x in sp.containing(q, s).collect())
    assert got == sorted((p, k, x[1]) for p, k, at in places for x in held(p, at))
    best = {(x.path, x.k): x.span and x.span.id for x in sp.innermost(q, s, ["path", "k"]).collect()}
    assert best == {(p, k): min(held(p, at), key=lambda x: (-x[2], x[3], x[1]))[1] if held(p, at) else None for p, k, at in places}
    assert sp.innermost(q, s.where("false"), ["path", "k"]).where("span is not null").count() == 0


def test_a_stored_index_gives_what_the_table_gives(spark):
    r = random.Random(5)
    parts = ["find", "diff", "cache", "Index", "ring", "x", "Ünï", "_", "9"]
    rows = [(f"f{k % 7}", k, "".join(r.choices(parts, k=r.randint(1, 4))), r.choice(sy.JUMP), k, k % 3) for k in range(300)] + [("f0", 999, None, "class", 1, 0), ("f1", 998, "", "class", 1, 0)]
    t = spark.createDataFrame(rows, "path string, idx int, name string, kind string, line int, depth int").cache()
    index = sy.SymbolIndex.build(t)
    rows_of = lambda df: [tuple(x) for x in df.collect()]
    for needle, limit in (("ring", 5), ("fndx", 50), ("INDEX", 400), ("x", 20), ("ünï", 30), ("  ", 5), ("nothing-here", 5), ("diff", 0), ("ff_c", 40)):
        assert rows_of(index.search(needle, limit)) == rows_of(sy.search(t, needle, limit)), needle
    for name in ("Ring", "finddiff", "none"):
        assert rows_of(index.definitions(name, 9)) == rows_of(sy.definitions(t, name, 9))
    view = t.where("path in ('f1', 'f2')").select("path").distinct()
    assert rows_of(index.search("ring", 5, view)) == rows_of(sy.search(t, "ring", 5, view))


def test_numbers_over_ranges(spark):
    from textmill.storage import numbered

    r = random.Random(1)
    rows = [(r.randint(0, 50), k) for k in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), "a", "b")
    assert sorted((x.position, x.a, x.b) for x in got.collect()) == [(k, *x) for k, x in enumerate(sorted(rows), 1)]
    assert numbered(spark.createDataFrame([], "a int"), "a").count() == 0


def test_containment_sends_nothing_through_the_driver(spark):
    """Spans and places grow with the texts: neither is broadcast, however small the planner takes them for."""
    s = spark.createDataFrame([("a", k, k, k + 5) for k in range(50)], "path string, id int, start long, end long")
    got = sp.innermost(s.select("path", "id", s.start.alias("at")), s, ["path", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan
    assert sorted(r.span.id for r in got.collect()) == list(range(50))
