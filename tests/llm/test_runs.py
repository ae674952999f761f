import hashlib
import random
import zlib

import numpy as np
import pytest

from textmill.llm import runs

from .fixtures import edge_docs, empty_docs


def brute(words):
    """All runs by their definition: every stretch between two places that break a period, its smallest period by trial."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, length = i, j + q - i
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + d] for k in range(s, s + length - d)) for d in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    """Words with nested and neighbouring repeats."""
    out = [rng.choice("abc") for _ in range(rng.randint(0, 8))]
    for _ in range(rng.randint(0, 5)):
        block = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 30))]
        block = (block * rng.randint(1, 12))[: rng.randint(1, 300)]
        out += block * rng.randint(1, 6) if rng.random() < 0.5 else block
        out += [rng.choice("abcxyz") for _ in range(rng.randint(0, 5))]
    return out[:700]


@pytest.mark.parametrize("probed", [runs.PROBED_LAG, 6])
def test_runs_equal_the_definition(probed, monkeypatch):
    monkeypatch.setattr(runs, "PROBED_LAG", probed)
    rng = random.Random(3)
    for _ in range(150):
        words = made(rng)
        assert runs.find_runs(runs._number(words)) == brute(words), words


def test_all_short_words_of_two_letters():
    for n in range(14):
        for k in range(2**n):
            ids = np.array([k >> b & 1 for b in range(n)], np.int64)
            assert runs.find_runs(ids) == brute(list(ids)), ids


def test_lag_counts_are_exact_for_heavy_and_light_words(monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 500, 3000):
        ids = rng.choice(40, n, p=np.array([40, 20, *[1] * 38]) / 98)
        got = runs.lag_counts(ids, n // 2)
        assert got.tolist() == [0, *[int((ids[:-q] == ids[q:]).sum()) for q in range(1, n // 2 + 1)]]


def test_long_texts_of_few_words_are_done_in_time():
    same = np.zeros(1_000_000, np.int64)
    assert runs.find_runs(same) == [(0, 1_000_000, 1)]
    two = np.random.default_rng(2).integers(0, 2, 200_000)
    two[50_000:90_000] = np.tile(two[50_000:59_000], 5)[:40_000]
    found = runs.find_runs(two)
    assert any(q == 9000 and s <= 50_000 and length >= 40_000 for s, length, q in found)


def expected(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(found), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def key(r):
    return tuple(map(str, r))


def test_report_of_edge_cases(spark):
    docs = edge_docs(spark, [(10 + k, "a\x0bb\xa0c \x1f  d\r\ne " * 3, None, None) for k in range(20)])
    docs = docs.where("doc_id is null or doc_id <> 4")
    got = sorted((tuple(r) for r in runs.run_report(docs).collect()), key=key)
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert not runs.run_report(empty_docs(spark)).count()
    long = runs.run_report(edge_docs(spark).where("doc_id = 4")).first()
    assert (long.start, long.period, long.length) == (0, 5, 20_000)


def test_report_of_documents_equals_the_definition(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 6000")
    got = sorted((tuple(r) for r in runs.run_report(docs).collect()), key=key)
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert sum(r[1] > 0 for r in got) > 3


def test_collapsed_texts_and_run_table(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y"), (2, "a a"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, runs.collapsed(docs).collect())) == [(1, "x a b y"), (2, "a a"), (3, "")]
    assert [tuple(r) for r in runs.periodic_runs(docs).collect()] == [(1, 1, 8, 2)]
