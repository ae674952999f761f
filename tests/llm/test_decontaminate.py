import random
import re

from textmill.llm import decontaminate as dc

from .fixtures import DOC_SCHEMA, empty_docs

FOLD = {c: c + 32 for c in range(65, 91)}


def words(t):
    return re.findall(dc.WORD, (t or "").translate(FOLD))


def brute(docs, items, size=dc.WINDOW):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, t in items:
            v = words(t)
            for a in range(max(len(v) - size, 0) + 1 if v else 0):
                x = v[a : a + size]
                for s in range(len(w) - len(x) + 1):
                    if w[s : s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        if item_id is not None:
                            ids.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(ids), sorted(ids), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items, size=dc.WINDOW):
    d = spark.createDataFrame([(*r, None, None, 9, 9, 0, 0.5, "w", 3) for r in docs], DOC_SCHEMA)
    b = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, words string, k1 int")
    got = dc.contamination(d, b, size).select("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, items, size)
    kept = sorted((r.doc_id, r.text) for r in dc.clean_documents(d, b, size).select("doc_id", "text").collect() if r.doc_id is not None)
    bad = {(x[0]) for x in brute(docs, items, size) if x[5]}
    if len({x[0] for x in docs}) == len(docs):
        assert kept == sorted((i, t) for i, t in docs if i not in bad and i is not None)


def test_random_small_vocabulary(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["the", "The", "a", "of", "Été", "été", "x1", "b-c", "q"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)]
    items = [(k, text(rng.randint(1, 6))) for k in range(12)]
    docs += [(100 + k, f"zz {items[k][1]} yy") for k in range(12)]
    run(spark, docs, items, 4)


def test_edge_cases(spark):
    ten = "one two three four five six seven eight nine ten"
    docs = [(1, ten + " eleven"), (1, ten + " eleven"), (2, None), (3, ""), (None, "x " + ten.upper()), (4, "One, TWO! three-four five\nsix seven eight nine tenx"), (5, f"{ten} {ten}"), (6, "short item"), (7, "a short item here"), (8, "w " * 30000 + ten), (9, "\x00 ... ")]
    items = [(1, ten), (1, ten), (None, "short item"), (10, "Short Item"), (2, ten + " eleven"), (3, None), (4, ""), (5, "never " + ten[:-3] + "x")]
    run(spark, docs, items)
    run(spark, docs, [])
    none = spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(empty_docs(spark), none).count() == 0


def brute_near(text, win, slop):
    """Starts at which the window's every word stands within ``slop`` of its place, by any of its words that stands exactly."""
    w = words(text)
    fits = lambda s, k: any(w[p] == win[k] for p in range(max(0, s + k - slop), min(len(w), s + k + slop + 1)))
    return {(s, k) for s in range(-slop, len(w)) for k in range(len(win)) if 0 <= s + k < len(w) and w[s + k] == win[k] and all(fits(s, j) for j in range(len(win)))}


def test_proximity(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of"]) for _ in range(n))
    rows = [(1, "alpha beta gamma delta"), (2, "alpha so beta gamma delta"), (3, "alpha beta so very much gamma delta"), (4, "delta gamma beta alpha"), (4, "delta gamma beta alpha"), (5, None)]
    rows += [(10 + k, text(rng.randint(0, 30))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, "alpha beta gamma delta"), (2, text(7)), (3, "alpha"), (4, "beta absentword gamma")]
    win, owners = dc.windows_of(spark.createDataFrame(items, "item_id long, text string"))
    vocab = dc.vocabulary_of(win)
    index = dc.build_index(docs, vocab)
    by_window = {r.wid: r.words for r in win.collect()}
    rare = {r.wid: r.off for r in dc.ranked_terms(win, vocab, index).where("rank = 0").collect()}
    for slop in (0, 1, 3):
        got = sorted((r.k1, r.wid, r.s) for r in dc.proximity_matches(win, vocab, index, slop).collect())
        want = sorted({(i, w, s) for i, t in rows for w, off in rare.items() for s, k in brute_near(t, by_window[w], slop) if k == off})
        assert got == want and want
    near = dc.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), slop=2).collect()
    want = {i: len({w for w, off in rare.items() if any(k == off for _, k in brute_near(t, by_window[w], 2))}) for i, t in rows}
    assert all(r.n_near == want[r.doc_id] for r in near) and len(near) == len(rows)


def test_vocabulary_beyond_a_broadcast(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(tuple(r) for r in dc.digest(dc.contamination(docs, items)).collect())
    monkeypatch.setattr(dc, "fits_broadcast", lambda df: False)
    monkeypatch.setattr(dc, "broadcast_if_small", lambda df: df.hint("merge"))
    assert sorted(tuple(r) for r in dc.digest(dc.contamination(docs, items)).collect()) == want


def test_main_path_is_native(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = dc.contamination(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_own_columns_of_any_name_stay(spark):
    words = " ".join(f"w{k}" for k in range(12))
    rows = [(1, words + " more", 1, 2, 3), (2, "clean text", 4, 5, 6), (2, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k1 int, _k2 int, _row int")
    items = spark.createDataFrame([("i", words)], "item_id string, text string")
    kept = dc.clean_documents(docs, items)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:], key=str)
