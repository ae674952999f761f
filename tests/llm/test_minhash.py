import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from textmill.llm import minhash as mh
from textmill.operators.graph import connected as components

from .fixtures import DOC_SCHEMA, edge_docs, empty_docs


def union(nodes, links):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def word_text(r, n):
    return [r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice(["an", "er", "in", "th", "on"]) + str(r.randint(0, 99)) for _ in range(n)]


def planted(seed=4):
    """Groups of near copies of several closenesses, exact copies, a large group, a common passage, unrelated texts."""
    r = random.Random(seed)
    common = word_text(r, 12)
    out = []
    for g in range(25):
        base = word_text(r, r.randint(60, 200))
        for _ in range(40 if g == 0 else 5):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = "edit" + str(r.randint(0, 9999))
            out.append(" ".join(t))
        out += [" ".join(base)] * (30 if g == 1 else 2)
    out += [" ".join(word_text(r, 80) + common) for _ in range(60)]
    out += ["Three Words only", "three words only", "one", "", None, None]
    return [(k, t) for k, t in enumerate(out)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 9, 9, 0, 0.5, "w", 3) for i, t in rows], DOC_SCHEMA)


def brute(docs, rows, least):
    w = mh.Weights(*mh.document_frequencies(docs))
    sets = {i: w(t or "") for i, t in rows}
    return {(a, b): s for (a, b) in combinations(sets, 2) if len(sets[a][0]) and len(sets[b][0]) and (s := mh.weighted_jaccard(*sets[a], *sets[b])) >= least}


def test_against_brute_force(spark):
    rows = planted()
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in mh.near_classes(docs).collect()}
    assert set(got) == {i for i, _ in rows}
    links = brute(docs, rows, mh.THRESHOLD)
    want = union([i for i, _ in rows], links)
    missed = [p for p in links if got[p[0]].class_id != got[p[1]].class_id]
    assert len(missed) <= 0.005 * len(links)
    for i in got:  # nothing is merged that links do not connect
        assert want[got[i].class_id] == want[i]
    if not missed:
        assert {i: r.class_id for i, r in got.items()} == want
    sizes = defaultdict(int)
    for r in got.values():
        sizes[r.class_id] += 1
        assert r.kept == (r.doc_id == r.class_id)
    assert all(r.n_class == sizes[r.class_id] for r in got.values())


def test_samples_estimate_weighted_jaccard():
    r = np.random.default_rng(5)
    s = mh.Sampler(4000)
    h = np.unique(r.integers(0, 1 << 63, 80, dtype=np.uint64))
    wa, wb = r.gamma(2, 1, len(h)), r.gamma(2, 1, len(h))
    wb[:40] = wa[:40]
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    got = np.mean(s.samples(h, wa) == s.samples(h, wb))
    assert abs(got - want) < 0.04
    assert abs(mh.weighted_jaccard(h, wa, h, wb) - want) < 1e-9
    assert mh.weighted_jaccard(h[:3], wa[:3], h[5:9], wa[5:9]) == 0


def test_pairs_just_above_the_threshold_share_a_band():
    """6000 pairs of similarity 0.8 to 0.81: at most one in a thousand shares no band."""
    r = np.random.default_rng(7)
    s = mh.Sampler(mh.BANDS * mh.ROWS)
    bands = lambda h, w: s.samples(h, w).reshape(mh.BANDS, mh.ROWS)
    missed = 0
    for _ in range(6000):
        n = int(r.integers(100, 200))
        h, w = r.permutation(np.unique(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64))), r.gamma(4, 1, 2 * n)
        own = w[:n].sum() * (1 / r.uniform(0.8, 0.81) - 1)  # weight outside of what both have
        m = n + int(np.searchsorted(np.cumsum(w[n:]), own))
        side = r.random(m) < 0.5
        side[:n] = True
        other = ~side
        other[:n] = True
        a, b = ((h[:m][k], w[:m][k]) for k in (side, other))
        missed += not (bands(*a) == bands(*b)).all(1).any()
    assert missed <= 6, missed


def test_blocks_give_the_same(spark, monkeypatch):
    rows = planted(6)
    docs = docs_of(spark, rows)
    key = lambda: sorted((r.doc_id, r.class_id, r.n_class) for r in mh.near_classes(docs).collect())
    a = key()
    monkeypatch.setattr(mh, "ROUNDS", 0)
    monkeypatch.setattr(mh, "BLOCK", 4)
    assert key() == a


def test_similarities_equal_pairs():
    r = random.Random(8)
    w = mh.Weights(100, np.arange(mh.DF_BUCKETS) % 50 + 1.0)
    sets = []
    for _ in range(12):
        s, tf = mh.shingles(" ".join(r.choice(["a", "b"]) for _ in range(r.randint(3, 60))), w.memory)
        sets.append((s, w.weigh(s, tf), tf))
    m = mh.similarities(sets)
    for i in range(12):
        for j in range(12):
            assert abs(m[i, j] - mh.weighted_jaccard(*sets[i][:2], *sets[j][:2])) < 1e-9


def test_word_hashes():
    memory = mh.Powers()
    words = ["a", "b", "ab", "ba", "aa", "été", "ete", "x_1", "日本", "w" * 3000, "1"]
    apart = [mh.word_hashes(w, memory) for w in words]
    assert all(len(h) == 1 for h in apart) and len({int(h[0]) for h in apart}) == len(words)
    text = " ... " + "  ".join(words[:5]) + "!? " + ", ".join(words[5:]) + "\n"
    assert mh.word_hashes(text, memory).tolist() == [int(h[0]) for h in apart]
    assert mh.word_hashes(" .,\n", memory).size == mh.word_hashes("", memory).size == 0
    assert mh.word_hashes("AB ab Ab", memory).tolist() == [int(apart[2][0])] * 3
    assert len(mh.shingles("a b c d e f", memory)[0]) == 2 and mh.shingles("a b a b a b a b a b a b", memory)[1].sum() == 8


def test_frequencies_count_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, df = mh.document_frequencies(docs)
    want, memory = np.zeros(mh.DF_BUCKETS), mh.Powers()
    for r in docs.collect():
        np.add.at(want, (mh.shingles(r.text, memory)[0] % np.uint64(mh.DF_BUCKETS)).astype(int), 1)
    assert n == docs.count() and np.array_equal(df, want)


def test_defined_cases(spark):
    docs = edge_docs(spark)
    rows = mh.near_classes(docs).collect()
    assert len(rows) == docs.count()
    assert {r.kept for r in rows if r.doc_id in (2, 3)} == {True}
    assert [r.n_class for r in rows if r.doc_id == 1] == [2, 2]
    assert mh.near_classes(empty_docs(spark)).count() == 0
    kept = mh.one_of_each(docs)
    assert kept.schema == docs.schema and kept.count() == docs.count() - 1
    assert mh.one_of_each(empty_docs(spark)).count() == 0


def test_one_of_each_group(spark):
    rows = planted(9)
    docs = docs_of(spark, rows)
    ids = sorted(r.doc_id for r in mh.near_classes(docs).where("kept").collect())
    assert sorted(r.doc_id for r in mh.one_of_each(docs).collect()) == ids


def test_components(spark):
    r = random.Random(7)
    for n, m in ((40, 20), (200, 150), (60, 200)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5001 + k) for k in range(50)]
        got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        edges = [e for e in edges if e[0] != e[1]]
        assert got == union({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).head()[0] == 0
