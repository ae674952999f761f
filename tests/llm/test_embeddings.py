import random

import numpy as np
import pytest

from textmill.llm import embeddings as em

from .test_minhash import union

SCHEMA = "vec_id long, embedding array<float>, label int, v int, cid long, n int"


def planted(seed=3, dim=12, groups=30):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = r.normal(size=dim)
        for _ in range(80 if g == 0 else 4):
            out.append(base * r.uniform(0.5, 2) + r.normal(size=dim) * r.choice([0.02, 0.1, 0.25]))
        out += [base] * (60 if g == 1 else 1)
    out += list(r.normal(size=(150, dim)))
    rows = [(k, [float(np.float32(a)) for a in x], k % 3) for k, x in enumerate(out)]
    odd = [(9001, None), (9002, []), (9003, [0.0] * dim), (9004, [float("nan")] + [1.0] * (dim - 1)), (9005, [float("inf")] * dim), (9006, [None] + [1.0] * (dim - 1)), (9007, [1.0] * (dim + 1)), (9008, [2.0] * (dim + 1)), (9009, [1.0, 0.0]), (9010, [1.0, 0.1]), (9011, [0.0, 1.0]), (None, rows[0][1]), (5, rows[5][1])]
    return rows + [(i, x, None) for i, x in odd]


def brute(rows):
    ok = [bool(x) and all(v is not None and np.isfinite(v) for v in x) and any(x) for _, x, _ in rows]
    links = []
    for dim in {len(rows[k][1]) for k, o in enumerate(ok) if o}:
        at = [k for k, o in enumerate(ok) if o and len(rows[k][1]) == dim]
        x = em.unit(np.array([rows[k][1] for k in at], np.float64))
        links += [(at[i], at[j]) for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True) if i < j]
    comp = union(range(len(rows)), links)
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = {}
    for k, c in comp.items():
        least.setdefault(c, []).append(rows[k][0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in least.items()}
    return [(rows[k][0], n[k], least[comp[k]], rows[k][0] == least[comp[k]]) for k in range(len(rows))]


def run(spark, rows):
    return [tuple(r) for r in em.near_vectors(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("per_cell", [em.PER_CELL, 2])
def test_against_brute_force(spark, per_cell, monkeypatch):
    monkeypatch.setattr(em, "PER_CELL", per_cell)
    rows = planted()
    got, want = sorted(run(spark, rows), key=key), sorted(brute(rows), key=key)
    assert [g[0] for g in got] == [w[0] for w in want]
    total = sum(w[1] for w in want)
    assert sum(g[1] for g in got) >= 0.97 * total and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(want)


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = planted(8)
    a = sorted(run(spark, rows), key=key)
    monkeypatch.setattr(em, "BLOCK", 16)
    assert sorted(run(spark, rows), key=key) == a


def test_defined_cases(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [0.0], 1)]) and all(r[1] == 0 and r[3] for r in run(spark, [(1, None, 1), (2, [0.0], 1)]))
    assert sorted(run(spark, [(2, [1.0], 1), (1, [3.0], 1), (7, [-1.0], 1)])) == [(1, 1, 1, True), (2, 1, 1, False), (7, 0, 7, True)]


def test_multi_sequence_is_in_order():
    r = np.random.default_rng(1)
    for _ in range(20):
        a, b = r.random(9), r.random(7)
        got = list(em.multi_sequence(a, b, 0.9))
        d = [a[i] + b[j] for i, j in got]
        assert d == sorted(d) and set(got) == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9}


def test_forest_connects_what_links_connect():
    r = random.Random(2)
    for _ in range(40):
        na, nb = r.randint(1, 12), r.randint(1, 12)
        m = np.array([[r.random() < 0.2 for _ in range(nb)] for _ in range(na)])
        qa, qb = np.arange(na), np.arange(nb) + r.choice([0, 5, 100])
        m[qa[:, None] == qb[None, :]] = False
        links = [(int(qa[i]), int(qb[j])) for i, j in zip(*np.nonzero(m), strict=True)]
        nodes = {x for e in links for x in e}
        edges = [(int(x), int(y)) for x, y in zip(*em.forest(m, qa, qb), strict=True)] if links else []
        assert union(nodes, edges) == union(nodes, links) and len(edges) < max(1, len(nodes))


@pytest.mark.parametrize(("per_cell", "least"), [(em.PER_CELL, 0.97), (8, 0.95)])
def test_recall_against_brute_force(spark, sf, monkeypatch, per_cell, least):
    """All links of a whole table, each vector beside a copy with noise; the index is in use and skips cells, as shipped too."""
    monkeypatch.setattr(em, "PER_CELL", per_cell)
    fitted = []
    original = em._fitted
    monkeypatch.setattr(em, "_fitted", lambda *a: fitted.append(original(*a)) or fitted[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/embeddings.parquet").collect()]
    r = np.random.default_rng(6)
    x = em.unit(np.array([v for _, v in rows], np.float64))
    noise = em.unit(r.normal(size=x.shape)) * r.uniform(0, 0.5, len(x))[:, None]
    rows += [(i + 1_000_000, [float(np.float32(a)) for a in v]) for (i, _), v in zip(rows, x + noise, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = em.near_vectors(table).cache()
    got = {k.vec_id: k.n_links for k in found.collect()}
    x = em.unit(np.array([v for _, v in rows], np.float64))
    want = {i: int(n) - 1 for (i, _), n in zip(rows, (x @ x.T >= 0.9).sum(1), strict=True)}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= least * sum(want.values()) > 1000
    [(grid, bound)] = fitted
    d1, d2 = grid.distances(x)
    seen = sum(sum(1 for _ in em.multi_sequence(p, q, p.min() + q.min() + bound)) for p, q in zip(d1, d2, strict=True))
    assert seen < 0.5 * len(x) * len(grid.c1) * len(grid.c2)
    asked = {i for i in want if i % 100 == 0}
    assert tuple(em.recall(table, found).first()) == (len(asked), sum(want[i] for i in asked), sum(got[i] for i in asked))


def test_the_index_is_fitted_on_the_standard_tables(spark, sf):
    for name, n in (("sf0.01", 500), ("sf0.1", 2000)):
        assert spark.read.parquet(sf.replace("sf0.001", name) + "/embeddings.parquet").count() == n and em._codes(n) > 1
