import random

from textmill.operators import resolve as rs
from textmill.operators.provenance import ModuleGraph, Signed

IMPORTS = "path string, specifier string, kind string, line long, span_start long, span_end long"


def rebuilt(spark, imports, files):
    """Edges and states of a rebuild from everything there is."""
    rows = [(p, s, "static", k, 0, 1) for p, specs in imports.items() for k, s in enumerate(specs)]
    edges = [tuple(r) for r in rs.resolve(spark.createDataFrame(rows, IMPORTS), spark.createDataFrame([(f,) for f in files], "path string")).select("src", "dst", "to_kind", "line").collect()]
    refs = {}
    for _, dst, kind, _ in edges:
        if kind == "path":
            refs[dst] = refs.get(dst, 0) + 1
    states = {p: ("analyzed", refs.get(p, 0)) for p in imports} | {p: ("stub", n) for p, n in refs.items() if p not in imports}
    return sorted(edges), states


def test_batches_equal_a_rebuild(spark):
    """Files come, go, change, are forgotten; logs are rewritten on the way."""
    r = random.Random(6)
    graph = ModuleGraph(spark, compact=2)
    names = [f"{d}/{n}{e}" for d in "ab" for n in "xyz" for e in (".ts", ".js", "/index.ts")]
    files, imports, states = set(), {}, {}
    frame = lambda paths: spark.createDataFrame([(p,) for p in paths], "path string")
    for step in range(4):
        gone = r.sample(sorted(files), min(len(files), 3))
        come = [n for n in r.sample(names, 6) if n not in files]
        files = files - set(gone) | set(come)
        imports = {p: s for p, s in imports.items() if p not in gone}
        lost = r.sample(sorted(imports), min(len(imports), 1))
        parsed = {p: [r.choice(["./x", "../a/y", "../b/z", "./z.js", "react", "./none"]) for _ in range(r.randint(0, 3))] for p in r.sample(sorted(files), min(len(files), 4))}
        lost = [p for p in lost if p not in parsed]
        imports = {p: s for p, s in imports.items() if p not in lost} | parsed
        rows = [(p, s, "static", k, 0, 1) for p, specs in parsed.items() for k, s in enumerate(specs)]
        # Repeated paths, a null, and the import of a file that is not analysed change nothing.
        told = graph.advance(frame([*come, *come, None]), frame([*gone, "never/there.ts"]), spark.createDataFrame([*rows, *rows, ("stray.ts", "./x", "static", 0, 0, 1)], IMPORTS), frame(parsed), frame(lost))
        edges, now = rebuilt(spark, imports, files)
        assert sorted(tuple(x) for x in graph.all_edges().select("src", "dst", "to_kind", "line").collect()) == edges, step
        assert {x.path: (x.state, x.refs) for x in graph.states().collect()} == now
        was = {p: s for p, (s, _) in states.items()}
        assert {(x.path, x.was, x.now) for x in told["transitions"].collect()} == {(p, was.get(p, "none"), now.get(p, ("none",))[0]) for p in {*was, *now} if was.get(p, "none") != now.get(p, ("none",))[0]}
        states = now
    assert all(len(t.parts) < 2 for t in (graph.edges, graph.tried, graph.files))


def test_only_what_tried_a_path_is_resolved_again(spark):
    graph = ModuleGraph(spark)
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    rows = [("a/m.ts", "./late", "static", 1, 0, 1), ("a/m.ts", "./here", "static", 2, 0, 1), ("b/n.ts", "./late", "static", 1, 0, 1), ("a/o.ts", "react", "static", 1, 0, 1)]
    graph.advance(frame("a/m.ts", "b/n.ts", "a/o.ts", "a/here.ts"), None, spark.createDataFrame(rows, IMPORTS), frame("a/m.ts", "b/n.ts", "a/o.ts"))
    told = graph.advance(appeared=frame("a/late.js"))
    assert (told["touched"], told["fresh"], told["moved"], told["edges_added"], told["edges_removed"]) == (1, 0, 1, 1, 1)
    assert [tuple(r) for r in told["transitions"].collect()] == [("a/late.js", "none", "stub")]
    edge = graph.all_edges().where("src = 'a/m.ts' and line = 1").first()
    assert (edge.dst, edge.to_kind, edge.reason) == ("a/late.js", "path", None)
    # A better candidate takes over, and the worse one is pruned.
    told = graph.advance(appeared=frame("a/late.ts"))
    assert sorted(tuple(r) for r in told["transitions"].collect()) == [("a/late.js", "stub", "none"), ("a/late.ts", "none", "stub")]
    assert graph.advance(appeared=frame("a/late.ts"), vanished=frame("a/gone.ts"))["moved"] == 0


def test_signed_rows_add_up(spark):
    t = Signed(spark, "k", "signed", "k string, v long", compact=3)
    for rows in ([("a", 1, 1), ("a", 1, 1), ("b", 2, 1)], [("a", 1, -1)], [("b", 2, -1), ("c", 3, 1)], []):
        t.add(spark.createDataFrame(rows, "k string, v long, sign long"))
    assert sorted(tuple(r) for r in t.all().collect()) == [("a", 1, 1), ("c", 3, 1)] and len(t.parts) == 1
    assert [tuple(r) for r in t.of(spark.createDataFrame([("a",), ("b",)], "x string")).collect()] == [("a", 1, 1)]


def test_what_was_tried_is_one_row_a_module(spark):
    """Each import was stored under all 19 candidates; a file of the same stem that it did not try makes nothing resolve again."""
    graph = ModuleGraph(spark)
    frame = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    graph.advance(frame("a/m.ts"), None, spark.createDataFrame([("a/m.ts", "./x.js", "static", 1, 0, 1)], IMPORTS), frame("a/m.ts"))
    assert graph.tried.all().count() == 2
    assert graph.advance(appeared=frame("a/x/index.ts", "a/x.mjs"))["touched"] == 0
    assert graph.advance(appeared=frame("a/x.ts", "a/x.js.ts"))["touched"] == 1
    assert [r.dst for r in graph.all_edges().collect()] == ["a/x.ts"]
