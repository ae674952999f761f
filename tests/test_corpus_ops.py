import os
import random

import pytest
from pyspark.sql import functions as F

from textmill.corpus import explicit
from textmill.dialect import find_regex, glob_regex, ignore_rules, ignored, java_regex
from textmill.errors import CorpusError
from textmill.operators import find as fd
from textmill.operators import read as rd
from textmill.operators.grep import Search, grep


def corpus(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


#: Pump k has raised k + 1 alarms, each after a quiet hour.
PUMPS = {f"pump/{k}.log": "".join(f"hour {j} quiet\nALARM level {j} of pump {k}\n" for j in range(k + 1)) for k in range(7)}


def rows(df):
    return [tuple(r) for r in df.orderBy("path", "line_number").collect()]


def test_a_limit_takes_the_first_alarms_in_path_order(spark):
    got = rows(Search(corpus(spark, PUMPS), "ALARM", max_total_count=8).content())
    assert [r[0][5] for r in got] == list("01122233") and got[-1][1:] == (4, "ALARM level 1 of pump 3", True)
    r = grep(corpus(spark, PUMPS), "ALARM", "rollup", max_total_count=29).head()
    assert (r.files_searched, r.total_matches, r.limit_reached) == (7, 28, False)
    assert grep(corpus(spark, PUMPS), "ALARM", "rollup", max_total_count=28).head().limit_reached
    assert grep(corpus(spark, PUMPS), "ALARM", "content", max_total_count=0).count() == 0


def test_limits_of_a_file_and_of_all(spark):
    got = rows(Search(corpus(spark, PUMPS), "ALARM", max_count=3, max_total_count=10).content())
    assert [r[0][5] for r in got] == list("0112223334")
    assert len(rows(Search(corpus(spark, PUMPS), "ALARM", max_count=0).content())) == 7


def test_lines_around_the_last_kept_match(spark):
    c = corpus(spark, {"tide": "ebb\nstorm at six\ncalm\ncalm\nstorm at nine\nflood"})
    got = rows(Search(c, "storm", before=1, after=2, max_total_count=1).content())
    assert [(r[2], r[3]) for r in got] == [("ebb", False), ("storm at six", True), ("calm", False), ("calm", False)]


def naive(files, hit, before, after, k, total):
    out, left = [], total
    for path in sorted(files):
        ls = files[path].split("\n")
        ls = ls[:-1] if ls[-1] == "" else ls
        at = [j for j, x in enumerate(ls) if hit(x)]
        kept = at[: min(len(at) if k is None else max(1, k), left)]
        if not kept:
            continue
        left -= len(kept)
        end = at[len(kept)] if len(kept) < len(at) else len(ls)
        out += [(path, j + 1, x, j in kept) for j, x in enumerate(ls) if j < end and j <= kept[-1] + after and any(j - after <= m <= j + before for m in at)]
    return out


@pytest.mark.parametrize(("before", "after", "k", "total"), [(0, 0, None, 100), (2, 1, None, 7), (1, 3, 2, 9), (0, 2, 1, 4), (3, 0, None, 1)])
def test_content_equals_naive(spark, before, after, k, total):
    import random

    r = random.Random(before * 7 + after)
    files = {f"p{j}": "\n".join(r.choice(["x", "yx", "z", ""]) for _ in range(r.randint(0, 15))) for j in range(8)}
    got = rows(Search(corpus(spark, files), "x", before=before, after=after, max_count=k, max_total_count=total).content())
    assert got == naive(files, lambda s: "x" in s, before, after, k, total)


def test_dialect(spark):
    c = corpus(spark, {"a.rs": "var Rate = 7;\nvar speed = 8;", "b.txt": "var Rate = 9;"})
    n = lambda p, **o: sum(r.match_count for r in grep(c, p, "count", **o).collect())
    assert n(r"var \w+ =") == 3 and n(r"var \w+ =", fixed_strings=True) == 0
    assert n("rate") == 0 and n("rate", case_insensitive=True) == 2 and n("rate", smart_case=True) == 2 and n("Rate", smart_case=True) == 2
    assert n("Rate", globs=("*.rs",)) == 1
    assert n("É|é") == 0
    for bad in ("(?=x)", r"(a)\1", "(", "a*+"):
        with pytest.raises(CorpusError) as e:
            Search(c, bad)
        assert e.value.kind == "invalidInput"
    assert java_regex("Éa", case_insensitive=True).startswith("(?dUiu)")


def test_line_ends(spark):
    c = corpus(spark, {"a": "one\r\ntwo\n\n", "b": "", "c": "x"})
    assert [r[2] for r in rows(Search(c, "^.*$").content())] == ["one", "two", "", "x"]
    assert {r.path for r in grep(c, "^$", "files").collect()} == {"a"}


def test_multiline_blocks(spark):
    c = corpus(spark, {"a": "x\nfoo\nbar\ny\nfoo\nbar"})
    assert [tuple(r) for r in grep(c, "foo\nbar", "blocks", multiline=True).collect()] == [("a", 2, 2, "foo\nbar"), ("a", 5, 2, "foo\nbar")]


def test_read_windows(spark):
    c = corpus(spark, {"a": "1\n2\n3\n", "b": "1\n2\n3", "e": ""})
    get = lambda **o: {r.path: r for r in rd.read(c, **o).collect()}
    r = get()
    assert (r["a"].content, r["a"].total_lines, r["a"].truncated) == ("1\n2\n3\n", 3, False) and (r["e"].total_lines, r["e"].content) == (1, "")
    r = get(offset=2, limit=1)
    assert r["a"].content == r["b"].content == "2\n" and r["e"].content is None and r["e"].past_end
    assert get(offset=3)["b"].content == "3" and get(offset=3, limit=0)["a"].content == "3\n"
    r = get(line_mode="splitLines")
    assert (r["a"].total_lines, r["a"].content) == (4, "1\n2\n3\n") and get(offset=1, limit=3, line_mode="splitLines")["a"].content == "1\n2\n3"
    assert get(line_numbers=True)["b"].content == "     1\t1\n     2\t2\n     3\t3"
    with pytest.raises(Exception, match="past the end"):
        rd.read(c, offset=9, strict=True).collect()
    with pytest.raises(CorpusError):
        rd.read(c, line_mode="x")


def entries(spark, files, dirs=()):
    return spark.createDataFrame([(f, "file") for f in files] + [(d, "dir") for d in dirs], "rel_path string, kind string")


def shown(df):
    return [r.shown for r in df.orderBy("position").collect()]


def test_find(spark):
    e = entries(spark, ["a.txt", "src/b.txt", ".hidden"], ["src", "empty"])
    assert shown(fd.find(e, "*")) == [".hidden", "a.txt", "empty/", "src/", "src/b.txt"]
    assert shown(fd.find(e, show_hidden=False)) == ["a.txt", "empty/", "src/", "src/b.txt"]
    e = entries(spark, ["root.rs", "src/a.rs", "src/nested/b.rs", "README.md"], ["src", "src/nested"])
    n = lambda p, **o: len(shown(fd.find(e, p, **o)))
    assert [n("src/*.rs"), n("src/**/*.rs"), n("**/*.rs"), n("readme.md"), n("READme.md"), n(""), n("src/")] == [1, 2, 3, 1, 0, 6, 0]
    e = entries(spark, ["a.rs", "nested/b.rs"], ["nested"])
    assert len(shown(fd.find(e, "src/**/*.rs", root="/x/src"))) == 2
    e = entries(spark, [".git/config", "node_modules/pkg/index.js", "src/a.js", "src/b.js"])
    assert shown(fd.find(e, "*.js", limit=2, exclude=("node_modules/**", ".git/**"))) == ["src/a.js", "src/b.js"]
    s = fd.find_summary(e, "*.js", 0).head()
    assert (s.total_matches, s.limit_reached) == (3, True)
    many = entries(spark, [f"{k:03}" + "x" * 300 for k in range(240)])
    kept = shown(fd.find(many))
    assert sum(len(x) + 1 for x in kept[:-1]) <= fd.BUDGET < sum(len(x) + 1 for x in kept) and fd.find_summary(many).head().output_limit_reached
    assert shown(fd.find(entries(spark, ["a-b", "a/b", "a"]))) == ["a", "a/b", "a-b"]
    with pytest.raises(CorpusError):
        fd.find(e, "x" * 5000)


def test_globs_and_ignore_rules():
    import re

    m = lambda g, s, sep=True: bool(re.match(glob_regex(g, sep), s))
    assert m("*.rs", "a.rs") and not m("*.rs", "d/a.rs") and m("*.rs", "d/a.rs", False)
    assert m("**/x", "x") and m("**/x", "a/b/x") and m("a/**", "a/b/c") and m("a/**/b", "a/b") and not m("a/**/b", "ab")
    assert m("{a,b{c,d}}.t", "bd.t") and m("[!a]x", "bx") and not m("[!a]x", "ax") and m(r"\*", "*")
    assert find_regex("") is None and find_regex("Abc")[0].startswith("(?d)") and find_regex("abc")[0].startswith("(?diu)")
    with pytest.raises(CorpusError):
        glob_regex("[a", True)
    rules = ignore_rules("# note\n*.log\n!keep.log\n/top\nbuild/\ndocs/*.md\n")
    assert ignored(rules, "a/x.log", False) and not ignored(rules, "keep.log", False)
    assert ignored(rules, "top", False) and not ignored(rules, "a/top", False)
    assert ignored(rules, "build/x", False) and not ignored(rules, "build", False) and ignored(rules, "docs/a.md", False) and not ignored(rules, "docs/b/a.md", False)


def test_tree_source(spark, tmp_path):
    from textmill.sources.tree import files, tree

    for name, data in {"shown.md": b"oyster", ".secret.md": b"oyster", "_under.txt": b"x", "dropped.md": b"oyster", ".ignore": b"dropped.md\n", "d/bin": b"a\x00b", "d/bad": b"\xff\xfea", "d/e/deep.txt": b"q"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.symlink("shown.md", tmp_path / "link")
    os.symlink("nowhere", tmp_path / "dangling")
    got = {r.rel_path: r for r in tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"shown.md", ".secret.md", "_under.txt", ".ignore", "d", "d/bin", "d/bad", "d/e", "d/e/deep.txt", "link", "dangling"}
    assert got["link"].kind == "symlink" and got["d"].kind == "dir" and got["shown.md"].size == 6
    assert "dropped.md" in {r.rel_path for r in tree(spark, str(tmp_path), respectIgnore=False).collect()}
    assert ".secret.md" not in {r.rel_path for r in tree(spark, str(tmp_path), hidden=False).collect()}
    assert {r.rel_path: r.kind for r in tree(spark, str(tmp_path), followSymlinks=True).collect()}["link"] == "file"
    f = {r.path: r for r in files(spark, str(tmp_path)).collect()}
    import xxhash

    assert f["d/bin"].is_binary and not f["d/bad"].valid_utf8 and f["shown.md"].hash_hex == xxhash.xxh3_64_hexdigest(b"oyster")
    s = Search(files(spark, str(tmp_path)), "oyster")
    assert {r.path for r in s.files().collect()} == {"shown.md", ".secret.md"} and s.rollup().head().incomplete


def test_node_ids(spark):
    from textmill.corpus import node_id

    got = spark.createDataFrame([("a@b.rs", "0f" * 8), ("c", None)], "path string, hash_hex string").select(node_id().alias("i"))
    assert [r.i for r in got.collect()] == ["a@b.rs@" + "0f" * 8, "c@" + "0" * 16]


def test_plans_do_not_shuffle(spark, sf):
    from textmill.corpus import from_documents

    c = from_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    for df in (Search(c, "the").counts(), Search(c, "the").files(), Search(c, "the", before=2, after=2, max_count=3).content(limited=False)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "n_chars" not in plan
    assert Search(c, "the").counts().agg(F.sum("match_count")).head()[0] > 0


def test_limits_count_files_or_matches(spark):
    c = corpus(spark, {f"f{k}": "x\nx\ny\n" for k in range(5)})
    assert sorted(r.path for r in Search(c, "x", max_total_count=3).files().collect()) == ["f0", "f1", "f2"]
    assert sorted(tuple(r) for r in Search(c, "x", max_total_count=3).counts().collect()) == [("f0", 2), ("f1", 1)]
    for mode, n, total in (("count", 2, 3), ("files", 3, 3)):
        r = Search(c, "x", max_total_count=3).rollup(mode).head()
        assert (r.files_searched, r.files_with_matches, r.total_matches, r.limit_reached) == (5, n, total, True)
    assert Search(c, "x", max_total_count=10).rollup().head().limit_reached and not Search(c, "x", max_total_count=11).rollup().head().limit_reached
    assert Search(c, "x", max_total_count=0).counts().count() == Search(c, "x", max_total_count=0).rollup().head().files_with_matches == 0


def test_limit_across_many_ranges(spark):
    r = random.Random(3)
    files = {f"d{r.randint(0, 9)}/f{k}": "x\n" * r.randint(0, 4) for k in range(300)}
    counts = sorted((p, t.count("x")) for p, t in files.items() if t)
    for limit in (1, 7, 100, sum(n for _, n in counts) - 1):
        want, left = [], limit
        for p, n in counts:
            if left > 0:
                want.append((p, min(n, left)))
                left -= n
        assert sorted(tuple(x) for x in Search(corpus(spark, files), "x", max_total_count=limit).counts().collect()) == want


def test_roots_and_bounds(spark):
    c = corpus(spark, {"a/b.txt": "x", "a/c/d.txt": "x", "ab.txt": "x"})
    found = lambda root: sorted(r.path for r in Search(c, "x", root=root).files().collect())
    assert found("") == found("./") == found("a/..") == ["a/b.txt", "a/c/d.txt", "ab.txt"] and found("a") == ["a/b.txt", "a/c/d.txt"] and found("a//c/../b.txt") == ["a/b.txt"]
    r = Search(c, "x", root="ab.txt").rollup().head()
    assert (r.files_searched, r.root, r.root_is_dir) == (1, "ab.txt", False)
    for bad in (lambda: Search(c, "x", root="nowhere"), lambda: Search(c, "x", root="../a"), lambda: Search(c, "x", before=10_001), lambda: Search(c, "x" * (1 << 20) + "x"), lambda: Search(c, "x", globs=("*",) * 257), lambda: Search(c, "x", max_count=1_000_001), lambda: Search(c, "x", max_output_bytes=5).content()):
        with pytest.raises(CorpusError):
            bad()
    assert [r.path for r in explicit(spark, ["b", "./a/../b", "a//c"]).collect()] == ["a/c", "b"]


def test_a_file_s_output_ends_at_its_cap(spark):
    """The line that would exceed the cap and all after it go, with their matches; context counts too; the roll-up is incomplete."""
    c = spark.createDataFrame([("a", "hit one\nmid\nhit two\nhit three\n"), ("b", "hit\n"), ("c", "none\n")], "path string, text string")
    cap = 3 * 24 + len("hit onemidhit two")
    rows = lambda **k: sorted((r.path, r.line_number, r.is_match) for r in Search(c, "hit", **k).content().collect())
    assert rows(after=1, max_file_bytes=cap) == [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True)]
    assert rows(after=1, max_file_bytes=cap - 1) == [("a", 1, True), ("a", 2, False), ("b", 1, True)]
    assert rows(max_file_bytes=10) == [] and len(rows(max_file_bytes=10_000)) == 4
    # The limit counts what the cap lets through.
    assert rows(max_file_bytes=24 + 7, max_total_count=2) == [("a", 1, True), ("b", 1, True)]
    r = Search(c, "hit", max_file_bytes=24 + 7).rollup("content").head()
    assert (r.files_searched, r.files_with_matches, r.total_matches, r.incomplete) == (3, 2, 2, True)
    assert not Search(c, "hit", max_file_bytes=10_000).rollup("content").head().incomplete


def test_a_limited_view_scans_the_corpus_once(spark, tmp_path):
    spark.createDataFrame([(f"f{k:03}", "x\ny") for k in range(50)], "path string, text string").write.parquet(str(tmp_path / "c"))
    seen = spark.sparkContext.accumulator(0)
    from pyspark.sql.functions import udf

    @udf("string")
    def read(t):
        seen.add(1)
        return t

    c = spark.read.parquet(str(tmp_path / "c")).withColumn("text", read.asNondeterministic()("text"))
    for view, n in (("files", 50), ("counts", 50)):
        for limit in (10, 100):
            before = seen.value
            rows = getattr(Search(c, "x", max_total_count=limit), view)().collect()
            assert len(rows) == min(n, limit) and seen.value - before == 50


def test_what_every_match_holds():
    from textmill.dialect import backtracks, linear_regex, required_literal

    want = {"th[a-z]*there": "there", "a|b": None, "(?i)needle": None, "x(needle)+y?": "needle", "^foo\\b": "foo", "(?:ab)?cd": "cd", "foo|far": "f", "[x]yz": "xyz", "\\w+tion": "tion", "a{0,3}": None, "\\p{L}ing": "ing", "(?i:ab)c": "c", "((a))bc": "abc"}
    assert {p: required_literal(p) for p in want} == want
    assert [backtracks(p) for p in ("(a+)+$", "(a|a)*", "(a|b)+", "[a-z]+tion", "(\\w+\\s?)*x", "(ab)+", "a{2,5}b*")] == [True, True, False, False, True, False, False]
    assert linear_regex("\\bx") is None and linear_regex("[\\W]") is None and linear_regex("[a&&b]") is None and linear_regex("(?<n>[^]a]\\d)+") is not None


def test_nested_quantifiers_take_linear_time(spark):
    import time

    texts = [("a", "a" * 5000 + "!\nno\naaa"), ("b", "Ünï cödé ünï\n\nx"), ("c", ""), ("d", "é é!\naa")]
    c = spark.createDataFrame(texts, "path string, text string")
    began = time.time()
    assert [tuple(r) for r in Search(c, "^(a+)+$").content().orderBy("path").collect()] == [("a", 3, "aaa", True), ("d", 2, "aa", True)]
    assert time.time() - began < 60
    s = Search(c, "^(\\w+ ?)+$", before=1, max_total_count=2)
    assert s.linear and [tuple(r) for r in s.content().orderBy("path", "line_number").collect()] == [("a", 1, "a" * 5000 + "!", False), ("a", 2, "no", True), ("a", 3, "aaa", True)]
    assert {r.path: r.match_count for r in Search(c, "^(\\w+ ?)+$").counts().collect()} == {"a": 2, "b": 2, "d": 1}
    assert {r.path for r in Search(c, "^(É ?)+!$", case_insensitive=True).files().collect()} == {"d"}
    assert Search(c, "^(\\w+ ?)+$").rollup().head().total_matches == 5


def test_the_literal_filter_changes_nothing(spark):
    c = spark.createDataFrame([("a", "one two\nthree"), ("b", "tw\no"), ("c", "TWO"), ("d", "")], "path string, text string")
    for p, n in (("t[w]o", 1), ("two|three", 2), ("o$", 2), ("x*two", 1), ("(two)?", 5)):
        s = Search(c, p)
        assert sum(r.match_count for r in s.counts().collect()) == n == s.rollup().head().total_matches and s.rollup().head().files_searched == 4, p


@pytest.mark.parametrize("name", ["grep_file_cap_rollup", "grep_nested_quantifier", "grep_ordered", "grep_root_folder"])
def test_queries_without_a_limit_keep_all_matches(spark, tmp_path, monkeypatch, name):
    """More matches than the least bounds of a search, which these queries' SQL does not have."""
    from textmill.operators import grep as gp
    from textmill.plans import corpus_queries as cq

    text = "the action thanthe\nnotion.\n" * 3
    spark.createDataFrame([(k, text, "en", f"src{k % 2}") for k in range(4)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    limited = lambda c, p, **k: gp.Search(c, p, **k | {"max_total_count": 2})
    monkeypatch.setattr(cq, "Search", limited)
    rows = getattr(cq, name)(spark, str(tmp_path)).collect()
    if name == "grep_ordered":
        assert [r.position for r in sorted(rows)] == list(range(1, 13))
    elif name == "grep_nested_quantifier":
        assert sorted(r.match_count for r in rows) == [3] * 4
    else:
        r = rows[0]
        assert (r.files_with_matches, r.total_matches, r.limit_reached) == ((4, 12, True) if name == "grep_file_cap_rollup" else (2, 6, False))


@pytest.mark.parametrize("options", [{}, {"before": 1, "after": 2}, {"max_file_bytes": 100}, {"max_count": 2, "max_file_bytes": 100}])
def test_each_line_is_matched_once(spark, options):
    """The optimizer put the matches of all lines in place of their name, inside a lambda over the lines: each line was matched as often
    as the file has lines."""
    s = Search(spark.createDataFrame([("a", "x\nthe\ny\nthe\nTHE\nz")], "path string, text string"), "t[h]e", **options)
    rows = s._lines(s.source, None)
    assert rows.where(F.size("out") > 0)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    ran = [(x.n, x.m) for x in rows.head().out]
    assert ran == ([(k, k in (2, 4)) for k in range(1, 7)] if "before" in options else [(2, True), (4, True)])
