import random
import os
import stat

import pytest

from textmill.errors import CorpusError
from textmill.functions import extract as ex
from textmill.functions import rewrite as rw
from textmill.operators import edit as ed
from textmill.operators import graph as gr
from textmill.operators import resolve as rs
from textmill.operators import sink, sweep
from textmill.operators import symbols as sy


def kind(f, *a, **k):
    with pytest.raises(CorpusError) as e:
        f(*a, **k)
    return e.value.kind, e.value.edit_index


def test_edits_match_the_original():
    assert rw.apply_edits("alpha\nbeta\n", [("alpha", "beta"), ("beta", "gamma")]).content == "beta\ngamma\n"
    assert rw.apply_edits("﻿a\r\nb\r\n", [("a\nb", "x\ny")]).content == "﻿x\r\ny\r\n"
    assert rw.apply_edits("a\nb\r\n", [("b", "c")]).content == "a\nc\n"
    assert kind(rw.apply_edits, "aa", [("a", "b")]) == ("multipleMatches", 0)
    assert kind(rw.apply_edits, "ab", [("a", "b"), ("x", "y")]) == ("noMatch", 1)
    assert kind(rw.apply_edits, "abc", [("ab", "x"), ("bc", "y")]) == ("overlap", 1)
    assert kind(rw.apply_edits, "abc", [("", "y")]) == ("empty", 0) and kind(rw.apply_edits, "a  b", [("  ", "y")]) == ("empty", 0)
    assert rw.apply_edits("a  b", [("  ", "y")], whitespace_exact=True).content == "ayb"
    assert kind(rw.apply_edits, "abc", [("b", "b")]) == ("noChange", None)


def test_normal_form_keeps_untouched_lines():
    text = "keep “this”   \nsay “hi” — now  \nkeep ﬁne\n"
    got = rw.apply_edits(text, [('say "hi" - now', "bye")])
    assert got.normalized and got.content == "keep “this”   \nbye\nkeep ﬁne\n"
    assert rw.normalize("ﬁ “x”\xa0y–z \t\n") == 'fi "x" y-z\n'


def test_hunks():
    old = "\n".join(map(str, range(30)))
    new = old.replace("\n5\n", "\nfive\n").replace("\n20\n", "\n")
    h = rw.hunks(old, new, 1)
    assert [[r[0] for r in g] for g in h] == [["equal", "delete", "insert", "equal"], ["equal", "delete", "equal"]]
    assert h[0][1] == ("delete", 6, None, "5") and rw.first_changed_line(old, new) == 6 and rw.first_changed_line("a", "a") is None


def test_edit_operators(spark):
    c = spark.createDataFrame([("a", "one two one"), ("b", "two"), ("c", "none")], "path string, text string")
    got = {r.path: (r.status, r.replacements, r.text) for r in ed.edit(c, "one", "1").collect()}
    assert got == {"a": ("multipleMatches", 0, "one two one"), "b": ("noMatch", 0, "two"), "c": ("ok", 1, "n1")} or got["c"][0] == "ok"
    assert {r.path: r.replacements for r in ed.edit(c, "one", "1", replace_all=True).collect()} == {"a": 2, "b": 0, "c": 1}
    assert kind(ed.edit, c, "", "x")[0] == kind(ed.edit, c, "x", "x")[0] == "invalidInput"
    edits = spark.createDataFrame([("a", 0, "two", "2"), ("a", 1, " one", "!"), ("b", 0, "two", "2"), ("b", 1, "x", "y")], "path string, edit_index int, old_text string, new_text string")
    rows = {r.path: r for r in ed.edit_batch(c, edits).collect()}
    assert rows["a"].content == "one 2!" and rows["a"].hunks[0][0].op == "delete" and (rows["b"].content, rows["b"].error_kind, rows["b"].edit_index) == (None, "noMatch", 1)


def test_writes(tmp_path):
    p = tmp_path / "d" / "f.txt"
    assert sink.write(str(p), "one")["existed"] is False and p.read_text() == "one"
    p.chmod(0o640)
    inode = p.stat().st_ino
    assert sink.write(str(p), "two")["existed"] and stat.S_IMODE(p.stat().st_mode) == 0o640 and p.stat().st_ino != inode
    inode = p.stat().st_ino
    sink.write(str(p), "3", mode="inPlace")
    assert p.read_text() == "3" and p.stat().st_ino == inode
    link = tmp_path / "link"
    link.symlink_to(p)
    assert sink.write(str(link), "via")["followed_symlink"] and link.is_symlink() and p.read_text() == "via"
    sink.write(str(link), "own", follow_symlinks=False)
    assert not link.is_symlink() and p.read_text() == "via"
    assert kind(sink.write, str(tmp_path / "d"), "x")[0] == "isDirectory"
    assert kind(sink.write, str(tmp_path / "no" / "x"), "x", create_dirs=False)[0] == "notFound"


def test_commit_of_edits(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "path string, content string").repartition(3)
    done = sink.commit(rows(("x/a", "A"), ("b", None), ("y", "é")), str(tmp_path))
    assert sorted(tuple(r) for r in done.collect()) == [("x/a", 1, False, False), ("y", 2, False, False)] and (tmp_path / "x" / "a").read_text() == "A"
    (tmp_path / "y").chmod(0o600)
    os.symlink("y", tmp_path / "link")
    inode = (tmp_path / "x" / "a").stat().st_ino
    done = sink.commit(rows(("x/a", "B"), ("link", "via")), str(tmp_path))
    assert sorted(tuple(r) for r in done.collect()) == [("link", 3, True, True), ("x/a", 1, True, False)]
    assert (tmp_path / "y").read_text() == "via" and stat.S_IMODE((tmp_path / "y").stat().st_mode) == 0o600 and (tmp_path / "x" / "a").stat().st_ino != inode
    inode = (tmp_path / "y").stat().st_ino
    sink.commit(rows(("y", "in")), str(tmp_path), writeMode="inPlace")
    assert (tmp_path / "y").read_text() == "in" and (tmp_path / "y").stat().st_ino == inode
    # All or nothing: a folder in the way, a path that comes twice or leads out moves no file.
    for bad in ([("new", "1"), ("x", "2")], [("new", "1"), ("new", "2")], [("new", "1"), ("../out", "2")]):
        with pytest.raises(Exception, match="in the way|twice|out of the folder"):
            sink.commit(rows(*bad), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["link", "x", "y"]


def test_a_retried_task_leaves_one_file(tmp_path):
    """Two attempts of a partition stage; one is committed."""
    w = sink.TreeWriter({"path": str(tmp_path)})
    row = {"path": "f", "content": b"data"}
    w.write(iter([row]))
    w.commit([w.write(iter([row])), None])
    assert [p.name for p in tmp_path.iterdir()] == ["f"] and (tmp_path / "f").read_bytes() == b"data"
    w = sink.TreeWriter({"path": str(tmp_path)})
    w.write(iter([row | {"path": "g"}]))
    w.abort([])
    assert [p.name for p in tmp_path.iterdir()] == ["f"]


def names(path, text):
    return [(s[1], s[2]) for s in ex.analyze(path, text)[1]]


def test_extraction():
    assert names("a.py", "class A:\n  def f(self): pass\n\nasync def g(): pass\nX = 1\n") == [("A", "class"), ("f", "method"), ("g", "function"), ("X", "constant")]
    assert names("bad.py", "def f(:\n  class B\n# def no\n")[0] == ("f", "function")
    ts = 'import {a} from "./first";\n// import "no"\nconst s = "import \'no\'";\nexport {b} from \'./second\'; import x = require("m"); const y = await import("./dyn"); require("r")\ninterface I {}\nenum E { A }\ntype T = string;\nfunction f() { function inner() {} }\n'
    got = ex.analyze("a.ts", ts)
    assert [(i[0], i[1]) for i in got[2]] == [("./first", "static"), ("./second", "reexport"), ("m", "ts-require"), ("./dyn", "dynamic"), ("r", "require")] and not got[3]
    depth = {s[1]: s[5] for s in got[1]}
    assert depth["inner"] == 1 and {"I", "E", "T", "f"} <= set(depth)
    assert ex.analyze("a.js", "import(name)")[3] and ex.analyze("a.js", "// require(x)")[3] is False
    rust = "use a::{b, c::{d, self}, e as f, g::*};\nmod m;\npub fn top() {}\nimpl S { fn go(&self) {} }\n/* fn no() /* nested */ fn no2() */\nconst LIM: u8 = 1;\n"
    got = ex.analyze("a.rs", rust)
    assert {i[0] for i in got[2]} == {"a::b", "a::c::d", "a::c", "a::e", "a::g::*", "m"}
    assert [(s[1], s[2]) for s in got[1]] == [("m", "module"), ("top", "function"), ("go", "method"), ("LIM", "constant")]
    assert names("a.md", "# One\n```\n# no\n```\n## Zwei ##\n# 三\n") == [("One", "module"), ("Zwei", "module"), ("三", "module")]
    assert [s[5] for s in ex.analyze("a.md", "# A\n## B\n### C\n## D\n")[1]] == [0, 1, 2, 1]
    assert names("a.go", "package x\nfunc F() {}\nfunc (r *T) M() {}\ntype T struct {}\n") == [("F", "function"), ("M", "method"), ("T", "struct")]
    assert names("a.hs", "f 0 = 1\nf n = n\ndata D = D\n") == [("f", "function"), ("D", "type")]
    assert names("a.sh", "# f() {\ngo() {\n  :\n}\n") == [("go", "function")]
    v = ex.analyze("a.vue", '<template/>\n<script lang="ts">\nimport A from "./A.vue";\nfunction f() {}\n</script>')
    assert v[2][0][0] == "./A.vue" and v[1][0][3] == 4
    assert ex.analyze("a.unknown", "x") is None and ex.language_of("x/.hidden") is None
    col = ex.analyze("a.py", "é = '日本'; \ndef 名前(): pass\n")[1]
    assert col[0][4] == 4


def test_registry_last_wins():
    ex.register("toy", ("toy",), lambda text: ([(text, "function", 0, 0, len(text))], [], False))
    assert names("a.toy", "x") == [("x", "function")]
    ex.register("toy2", ("toy",), None)
    assert ex.analyze("a.toy", "x") is None


def test_analyses_and_resolution(spark):
    files = {"src/app.ts": 'import "./first"; import "./lib"; import "react"; import "@s/pkg/x"; import "./gone"; import "@/first.js"', "src/first.ts": "", "src/lib/index.tsx": "", "r/src/lib.rs": "mod foo; use crate::foo::Bar; use serde::de;", "r/src/foo.rs": "use super::x;", "p/m.py": "from . import q\nimport os", "p/q.py": ""}
    c = spark.createDataFrame(list(files.items()), "path string, text string")
    a = ex.analyses(c).cache()
    e = rs.resolve(ex.imports(a), c.select("path"), rs.project_paths('{"compilerOptions": {"baseUrl": ".", /* c */ "paths": {"@/*": ["src/*"],}}}'))
    got = {(r.src, r.specifier): (r.dst, r.to_kind) for r in e.collect()}
    assert got["src/app.ts", "./first"] == ("src/first.ts", "path") and got["src/app.ts", "./lib"] == ("src/lib/index.tsx", "path")
    assert got["src/app.ts", "react"] == ("react", "external") and got["src/app.ts", "@s/pkg/x"] == ("@s/pkg", "external")
    assert got["src/app.ts", "./gone"] == ("./gone", "unresolved") and got["src/app.ts", "@/first.js"] == ("src/first.ts", "path")
    assert got["r/src/lib.rs", "foo"] == got["r/src/lib.rs", "crate::foo::Bar"] == ("r/src/foo.rs", "path") and got["r/src/lib.rs", "serde::de"] == ("serde", "external")
    assert got["p/m.py", "os"] == ("os", "external")
    left = rs.importers_to_verify(c, "src/first.ts", e.where("dst = 'src/first.ts'"))
    assert left.count() == 0


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_traversals(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")])
    pairs = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert pairs(gr.deps(e, ["a"], 1)) == [("a", "b")] and len(pairs(gr.deps(e, ["a"], 9))) == 4 and pairs(gr.deps(e, ["a"], 0)) == []
    assert pairs(gr.rdeps(e, ["a"], 1)) == [("c", "a"), ("x", "a")]
    nodes, inside = gr.neighborhood(e, ["d"], 1)
    assert {r.node for r in nodes.collect()} == {"c", "d"} and pairs(inside) == [("c", "d")]
    view = spark.createDataFrame([("a",), ("b",)], "path string")
    assert pairs(gr.deps(e, ["a"], 5, view)) == [("a", "b")]
    assert kind(gr.deps, e, ["a"], 65 + 1)[0] == "invalidInput"


def test_incremental_edges_equal_a_rebuild(spark):
    r = random.Random(0x12345678)
    now: dict[str, set] = {}
    table = edges_of(spark, [("q", "q")]).where("false")
    for _ in range(12):
        p = f"p{r.randrange(5)}"
        new = set() if r.random() < 0.25 else {f"p{r.randrange(5)}" for _ in range(3)}
        now[p] = new
        rows = edges_of(spark, [(p, d) for d in sorted(new)]) if new else table.where("false")
        table = gr.materialize(gr.replace_edges(table, spark.createDataFrame([(p,)], "path string"), rows), "t")
        assert {(x.src, x.dst) for x in table.collect()} == {(s, d) for s, ds in now.items() for d in ds}


def test_components_and_rollups(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("d", "e")])
    n = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r.node: r.label for r in gr.components(n, e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "z": "z"}
    files = spark.createDataFrame([("a", "indexed"), ("z", "indexed"), ("u", "unsupported"), ("o", "oversize")], "path string, state string")
    s = gr.status(files, n.selectExpr("node as path"), e).head()
    assert (s.universe, s.indexed, s.unsupported, s.oversize, s.edges, s.components) == (4, 2, 1, 1, 3, 3)


def test_fuzzy_tiers_and_definitions(spark):
    ns = ["parse", "parse_line", "do_parse", "reparsed", "please_advance_rest_of_set", "zzz"]
    s = spark.createDataFrame([(f"f{k}", 0, n, "function", 1, 0) for k, n in enumerate(ns)], "path string, idx int, name string, kind string, line long, depth int")
    got = [(r.name, r.score) for r in sy.search(s, "Parse").collect()]
    assert [n for n, _ in got] == ns[:5] and got[0][1] == 9995 and got[1][1] == 7990 and got[2][1] == 6000 - 3 - 8 and got[3][1] == 4000 - 2 - 8
    f = [r.score for r in sy.search(spark.createDataFrame([("p", 0, "find_diff_cache", "function", 1, 0)], s.schema), "fdc").collect()]
    assert f == [2000 - 8 - 15] and sy.search(s, "  ").count() == 0
    d = sy.definitions(s.unionByName(spark.createDataFrame([("a", 0, "PARSE", "field", 1, 0), ("b", 0, "Parse", "class", 9, 1)], s.schema)), "parse")
    assert [r.kind for r in d.collect()] == ["function", "class", "field"]


def test_nesting_and_merging(spark):
    rows = [("p", 0, "a", "class", 1, 0, 0, 100), ("p", 1, "b", "method", 2, 0, 10, 50), ("p", 2, "c", "function", 3, 0, 20, 30), ("p", 3, "d", "method", 4, 0, 60, 70), ("p", 4, "e", "class", 5, 0, 100, 120)]
    s = spark.createDataFrame(rows, "path string, idx int, name string, kind string, line long, depth int, def_start long, def_end long")
    assert {r.name: r.depth for r in sy.nesting(s).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0}
    twice = spark.createDataFrame([("p", k, n, "function", k, 0) for k, n in enumerate("ffgf")], "path string, idx int, name string, kind string, line long, depth int")
    assert [r.name for r in sy.merge_adjacent(twice).orderBy("idx").collect()] == ["f", "g", "f"]


def test_sweeps(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, size long, mtime_ns long, hash string")
    old, new = t([("a", 1, 1, "x"), ("b", 1, 1, "x"), ("c", 1, 1, "x"), ("d", 1, 1, "x")]), t([("a", 1, 1, "x"), ("b", 1, 2, "x"), ("c", 2, 2, "y"), ("e", 1, 1, "z")])
    got = {r.path: r.change for r in sweep.changes(old, new).collect()}
    assert got == {"a": "same", "b": "touched", "c": "modified", "d": "removed", "e": "added"}
    got = {r.path: r.change for r in sweep.changes(old, new, force=True, universe_complete=False).collect()}
    assert got["b"] == "modified" and got["d"] == "unseen"
    f = spark.createDataFrame([("a", 1, "x"), ("a", 2, "yy"), ("big", 1, "z" * 50)], "path string, seq int, text string")
    assert [(r.path, r.text) for r in sweep.last_wins(f, most_bytes=10).collect()] == [("a", "yy")]


def test_prefetch_outcomes(spark):
    seeds = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "path string")
    imports = spark.createDataFrame([("s1", 0, "a"), ("s1", 1, "b"), ("s1", 2, "c"), ("s2", 0, "a"), ("s2", 1, "gone"), ("s3", 0, "d")], "path string, pos int, target string")
    files = spark.createDataFrame([("a", 5), ("b", 500), ("c", 7)], "path string, size long")
    got = {(r.seed, r.target): r.outcome for r in sweep.prefetch(seeds, imports, files, max_seeds=2, per_seed=3, file_bytes=100, total_bytes=6).collect()}
    assert got == {("s1", "a"): "fetched", ("s1", "b"): "too large", ("s1", "c"): "byte limit", ("s2", "a"): "duplicate", ("s2", "gone"): "missing", ("s3", "d"): "seed limit"}


def test_components_in_one_task_and_by_stars(spark):
    r = random.Random(6)
    for shape in range(3):
        edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] if shape else [(k, k + 1) for k in range(50)] + [(99, k) for k in range(200, 260)]
        df = spark.createDataFrame(edges, "a long, b long")
        want: dict = {}
        for a, b in edges:
            if a != b:
                want[a], want[b] = want.get(a, {a}), want.get(b, {b})
                both = want[a] | want[b]
                for x in both:
                    want[x] = both
        want = {x: min(c) for x, c in want.items()}
        for one_task in (10**6, 0):
            assert {x.node: x.label for x in gr.connected(df, one_task=one_task).collect()} == want


def test_bounds_of_traversals(spark):
    edges = spark.createDataFrame([("r", f"n{k}") for k in range(30)], "src string, dst string")
    assert kind(gr.deps, edges, ["r"], 1, None, 29)[0] == "invalidInput"
    assert gr.deps(edges, ["r"], 1, max_result=30).count() == gr.deps(edges, ["r"], 1, max_result=None).count() == 30


def test_requires_and_verified_importers(spark):
    js = 'const a = require("./a"), b = require("./b"); import c = require("./c"); x.require("./no"); // require("./no")\n'
    assert sorted(i[:2] for i in ex.analyze("m.ts", js)[2]) == [("./a", "require"), ("./b", "require"), ("./c", "ts-require")]
    files = spark.createDataFrame([("a.ts", 'import "./t";'), ("b.ts", "// ./t"), ("t.ts", ""), ("c.ts", 'import "./x/t";')], "path string, text string")
    assert [r.src for r in rs.verified_importers(files, "t.ts", spark.createDataFrame([], "src string, dst string")).collect()] == ["a.ts"]


def test_bounds_and_outputs_of_edits(spark, monkeypatch):
    monkeypatch.setattr(rw, "MOST_INPUT", 8)
    assert kind(rw.apply_edits, "abc", [("a", "x" * 8)]) == ("invalidInput", None)
    assert kind(rw.apply_edits, "ä" * 5, [("ä", "x")]) == ("invalidInput", None)
    assert rw.apply_edits("a" + "b" * 9, [("a", "x")]).content == "x" + "b" * 9
    monkeypatch.setattr(rw, "MOST_WORK", 5)
    assert kind(rw.apply_edits, "abc", [("a", "x"), ("b", "y")]) == ("invalidInput", None)
    monkeypatch.setattr(rw, "MOST_LINES", 2)
    assert kind(rw.check_result, "a\nb\nc", "a", 0, 0, True)[0] == "invalidInput"
    rw.check_result("a\nb\nc", "a", 0, 0, False)
    rw.check_result("aaaa", "bbbb", 0, 0, False, 8)
    assert kind(rw.check_result, "aaaa", "bbbb", 1, 0, False, 8)[0] == "invalidInput"
    c = spark.createDataFrame([("f", "one two"), ("g", "one " * 1)], "path string, text string")
    e = spark.createDataFrame([(p, 0, "one", "1") for p in "fg"], "path string, edit_index int, old_text string, new_text string")
    got = {r.path: r for r in ed.edit_batch(c, e, content=False, original=True, most_bytes=12).collect()}
    assert got["f"].error_kind == "invalidInput" and got["f"].original is None
    assert got["g"].content is None and got["g"].original == "one " and got["g"].hunks


def test_project_files_that_extend_others():
    files = {
        "app/tsconfig.json": '{"extends": ["../a", "../b.json", "@pkg/base", "../gone"], "compilerOptions": {"baseUrl": "src"}}',
        "a.json": '{"compilerOptions": {"paths": {"x/*": ["a/*"]}}}',
        "b.json": '{"extends": "./app/tsconfig.json", "compilerOptions": {"paths": {"y": ["b"], "long/*": ["c/*"]}}}',
    }
    paths, notes = rs.inherited_paths(files, "app/tsconfig.json")
    assert paths == [("long/*", ["app/src/c/*"]), ("y", ["app/src/b"])]
    assert notes == ["b.json extends ./app/tsconfig.json, which extends it", "app/tsconfig.json extends the package @pkg/base", "app/tsconfig.json extends ../gone, which is missing"]
    assert rs.inherited_paths({"d/t.json": '{"extends": "./base"}', "d/base.json": '{"compilerOptions": {"paths": {"q": ["r"]}}}'}, "d/t.json")[0] == [("q", ["d/r"])]


def test_exports_of_packages():
    known = rs.packages({"p/package.json": '{"name": "p", "exports": {"import": "./m.mjs", "default": ["./d.js", "./e.js"]}}', "q/package.json": '{"name": "q", "exports": {"./a/*": {"custom": "./c/*.js", "default": "./a/*.js"}, "./a/b/*": "./deep/*", "./a/none/*": null}}', "node_modules/z/package.json": '{"name": "z"}', "p/in/package.json": '{"name": "p2"}'})
    assert [k[0] for k in known] == ["p2", "p", "q"]
    js = lambda s, kind="static", c=(): rs._js("x.ts", s, [], kind, known, c)
    assert js("p")[0][0] == "p/m.mjs" and js("p", "require")[0][0] == "p/d.js" and "p/e.js" in js("p", "require")[0]
    assert js("p/other") == ([], None) and js("z") == ([], "z") and js("@s/k/l") == ([], "@s/k")
    assert js("q/a/n")[0][0] == "q/a/n.js" and js("q/a/n", c=("custom",))[0][0] == "q/c/n.js"
    assert js("q/a/b/n.js")[0][0] == "q/deep/n.js" and js("q/a/none/n") == ([], None) and js("#a") == ([], None)
    assert "p/in/x.ts" in js("p2/x")[0] and "p/in/index.js" in js("p2")[0]


def test_guarantees(spark):
    edges = spark.createDataFrame([("a", "b", "path"), ("b", "c", "path"), ("a", "x", "external")], "src string, dst string, to_kind string")
    nodes = spark.createDataFrame([(p, True, False, True, True, True, True, g) for p, g in (("a", 2), ("b", 2), ("c", 1))], "path string, indexed boolean, has_opaque boolean, imports_supported boolean, imports_complete boolean, resolver_live boolean, resolution_complete boolean, resolved_at int")
    view = spark.createDataFrame([("a",), ("b",)], "path string")
    one = lambda df: tuple(df.collect()[0])
    assert one(gr.deps_guarantee(edges, nodes, ["a"], 2)) == ("Exact", 2, 0)
    assert one(gr.deps_guarantee(edges, nodes, ["a"], 2, view)) == ("Approximate", 2, 1)
    assert one(gr.deps_guarantee(edges, nodes, ["a"], 1, view)) == ("Exact", 1, 0)
    assert one(gr.deps_guarantee(edges, gr.current(nodes, 2), ["a"], 3)) == ("Approximate", 3, 0)
    assert one(gr.deps_guarantee(edges, nodes.where("path <> 'b'"), ["a"], 2)) == ("Approximate", 2, 0)
    assert one(gr.deps_guarantee(edges, nodes, ["a"], 0)) == ("Exact", 0, 0)
    assert one(gr.reverse_guarantee(nodes)) == ("Exact", 0) and one(gr.reverse_guarantee(nodes, False)) == ("Approximate", 0)
    assert one(gr.reverse_guarantee(gr.current(nodes, 2))) == ("Approximate", 1)


def test_all_reasons_of_prefetch(spark):
    seeds = spark.createDataFrame([("s",), ("s",), ("s",)], "path string")
    names = ["ok", "ext", "un", "../up", "ig", "ln", "bin", "utf", "io", "gone"]
    kinds = {"ext": "external", "un": "unresolved"}
    imports = spark.createDataFrame([("s", k, n, kinds.get(n, "path")) for k, n in enumerate(names)], "path string, pos int, target string, to_kind string")
    files = spark.createDataFrame([(n, 1, n == "ig", n == "ln", n != "bin", n != "utf", n == "io") for n in names[:-1]], "path string, size long, ignored boolean, symlink boolean, supported boolean, valid_utf8 boolean, io_error boolean")
    got = sorted((r.target or "", r.outcome) for r in sweep.prefetch(seeds, imports, files).collect())
    assert got == sorted([("", "duplicate seed")] * 2 + [("ok", "fetched"), ("ext", "external"), ("un", "unresolved"), ("../up", "outside the root"), ("ig", "ignored"), ("ln", "symlink"), ("bin", "unsupported"), ("utf", "not text"), ("io", "unreadable"), ("gone", "missing")])


def test_importers_are_exact_or_approximate(spark):
    text = {"t/x.ts": "export const a = 1", "a.ts": 'import "./t/x"', "b.ts": "// x", "c.ts": 'import("./" + "x")', "d.ts": 'import "./t/x"', "e.txt": "x", "f.ts": 'import "./t/x"'}
    files = spark.createDataFrame(list(text.items()), "path string, text string")
    known = spark.createDataFrame([("f.ts", "t/x.ts", "./t/x", 1)], "src string, dst string, specifier string, line long")
    told = lambda *bounds: sorted((r.path, r.specifier, r.line, r.guarantee) for r in rs.importers(files, "t/x.ts", known, (), *bounds)[0].collect())
    own = ("f.ts", "./t/x", 1, "Exact")
    maybe = lambda p: (p, None, None, "Approximate")
    assert told() == [("a.ts", "./t/x", 1, "Exact"), maybe("c.ts"), ("d.ts", "./t/x", 1, "Exact"), maybe("e.txt"), own]
    assert told(4, 1) == [("a.ts", "./t/x", 1, "Exact"), maybe("b.ts"), maybe("c.ts"), maybe("d.ts"), own]
    assert rs.importers(files, "t/x.ts", known, (), 4, 1)[1] and not rs.importers(files, "t/x.ts", known)[1]


def test_a_list_is_counted_by_occurrence(spark):
    files = spark.createDataFrame([("a.ts", "x"), ("b.ts", "y" * 50), ("c.bin", "z"), ("d.py", "")], "path string, text string")
    listed = spark.createDataFrame([("a.ts",), ("a.ts",), ("b.ts",), ("c.bin",), ("no.ts",), ("d.py",), (None,)], "path string")
    chosen, counts = sweep.from_list(listed, files, ["ts", "py"], 10)
    assert sorted(r.path for r in chosen.collect()) == ["a.ts", "d.py"]
    r = counts.head()
    assert (r.listed, r.scanned, r.indexed, r.unsupported, r.missing, r.oversize) == (7, 3, 2, 2, 1, 1)


def test_resolution_sends_no_table_through_the_driver_and_its_lists_once(spark):
    """Files and lists grow with the input, so neither is broadcast; what is joined back is a digest, one row for a list of one import."""
    rows = spark.createDataFrame([(f"f{k}.ts", "./t" if k % 2 else f"./f{k + 2}", "static", 1, 0, 5) for k in range(40)], "path string, specifier string, kind string, line long, span_start long, span_end long")
    files = spark.createDataFrame([(f"f{k}.ts",) for k in range(40)] + [("t.ts",)], "path string")
    edges = rs.resolve(rows, files)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "array(0, 1, 2" not in plan, plan
    assert {(r.src, r.dst, r.to_kind) for r in edges.collect()} == {(f"f{k}.ts", "t.ts" if k % 2 else f"f{k + 2}.ts" if k < 38 else "./f40", "path" if k != 38 else "unresolved") for k in range(40)}


def test_workers_take_batches_by_pieces(spark):
    """A whole batch of files was turned into Python objects at once: symbols, candidates or new texts of 10,000 rows."""
    import pyarrow as pa

    from textmill.batches import PIECE_ROWS, pieces
    from textmill.functions import extract
    from textmill.operators import edit, resolve

    class Rows:
        """Stands for a frame; gives the function that runs in a worker."""

        columns, dtypes = ["path", "specifier", "kind"], [(c, "string") for c in ("path", "specifier", "kind")]
        select = join = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    n = 2 * PIECE_ROWS + 1
    text = lambda *values: [pa.array([v] * n) for v in values]
    files = pa.record_batch(text("a.ts", "import './b';\nfunction f() {}\n"), names=["path", "text"])
    found = list(extract.analyses(Rows())(iter([files])))
    assert [b.num_rows for b in found] == [PIECE_ROWS, PIECE_ROWS, 1] and found[0].column("symbols")[0].as_py()[0]["name"] == "f" and found[2].column("imports")[0].as_py()[0]["specifier"] == "./b"
    imports = pa.record_batch(text("a.ts", "./b", "static"), names=Rows.columns)
    assert [b.num_rows for b in resolve.candidates(Rows())(iter([imports]))] == [PIECE_ROWS, PIECE_ROWS, 1]
    edits = spark.createDataFrame([("a", 0, "x", "y")], "path string, edit_index int, old_text string, new_text string")
    todo = pa.record_batch([*text("a", "x"), pa.array([[{"edit_index": 0, "old_text": "x", "new_text": "y"}]] * n)], names=["path", "text", "edits"])
    out = list(edit.edit_batch(Rows(), edits, skip_diff=True)(iter([todo])))
    assert [b.num_rows for b in out] == [PIECE_ROWS, PIECE_ROWS, 1] and out[2].column("content").to_pylist() == ["y"]
    big = pa.record_batch([pa.array(["x" * 1000] * 9)], names=["t"])
    assert [b.num_rows for b in pieces([big, big.slice(0, 0)], size=3000)] == [2, 2, 2, 1, 2, 0] and sum(b.num_rows for b in pieces([big], size=1)) == 9


def test_nesting_parses_texts_once(spark):
    from textmill.functions import extract
    from textmill.operators import symbols as sy

    files = spark.createDataFrame([("a.py", "class A:\n    def f(self):\n        def g(): pass\ndef h(): pass\n"), ("b.md", "# x\n")], "path string, text string")
    found = extract.symbols(extract.analyses(files))
    rows = sy.nesting(found)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert rows.columns == ["path", "idx", *[c for c in found.columns if c not in ("path", "idx", "depth")], "depth"]
    assert sorted((r.path, r.name, r.kind, r.line, r.depth) for r in rows.collect()) == [("a.py", "A", "class", 1, 0), ("a.py", "f", "method", 2, 1), ("a.py", "g", "function", 3, 2), ("a.py", "h", "function", 4, 0), ("b.md", "x", "module", 1, 0)]
    assert [tuple(r) for r in sy.nesting(found).orderBy("path", "idx").select("path", "idx", "depth").collect()] == [tuple(r) for r in found.orderBy("path", "idx").select("path", "idx", "depth").collect()]


def test_lists_meet_the_files_by_one_row_a_module(spark):
    """Each candidate was a row: 19 for an import of a module, of which the same file may come first whatever its ending."""
    from pyspark.sql import functions as F

    from textmill.operators import resolve as rs

    names = ["a/x.tsx", "a/x/index.js", "a/y.ts", "a/y.ts", "a/z.js", "a/z.vue", "x", "a/w.js.ts"]
    specs = ["./x", "./y.js", "./z", "./z.vue", "./w.js", "/x", "./none", "./x/index", "pkg"]
    imports = spark.createDataFrame([("a/m.ts", s, "static", k, 0, 1) for k, s in enumerate(specs)], "path string, specifier string, kind string, line long, span_start long, span_end long")
    listed = rs.candidates(imports)
    assert listed.select(F.max(F.size(rs.stems("candidates")))).head()[0] == 2 and listed.select(F.max(F.size("candidates"))).head()[0] > 18
    edges = rs.resolve(imports, spark.createDataFrame([(n,) for n in names], "path string"))
    assert [r.dst for r in edges.orderBy("line").collect()] == ["a/x.tsx", "a/y.ts", "a/z.js", "a/z.vue", "a/w.js.ts", "x", "./none", "a/x/index.js", "pkg"]
