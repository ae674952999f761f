import random
import zlib
from collections import defaultdict

import numpy as np

from textmill.llm import packing, registry

from .fixtures import edge_docs, empty_docs

VOCAB = registry.vocabulary("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def check(docs, capacity):
    tok = library()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), capacity)):
            want.append((r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    rows = packing.packed(docs, VOCAB, capacity=capacity).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs), -(-sum(x[3] for x in want) // capacity)


def test_pieces_and_places(spark, sf):
    check(edge_docs(spark), 64)
    check(edge_docs(spark), 2048)
    made, least = check(spark.read.parquet(f"{sf}/documents.parquet"), 2048)
    assert made <= least * 1.01 + 1
    assert packing.packed(empty_docs(spark), VOCAB).count() == 0


def test_ids_are_carried(spark):
    rows = packing.packed(edge_docs(spark), VOCAB, capacity=32, with_ids=True).collect()
    parts = sorted((r.piece, r.ids) for r in rows if r.doc_id == 4)
    assert sum((p for _, p in parts), []) == [*library().encode("lorem ipsum dolor sit amet " * 4000, add_special_tokens=False).ids, 0]


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(16, 8) == [(0, 8), (8, 8)] and packing.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_bounded_best_fit_against_plain_search():
    rng = random.Random(3)
    for limit in (1, 3, 50):
        bins, plain, made = packing.OpenBins(100, limit), [], 0
        for _ in range(600):
            n = rng.randint(1, 100)
            fit = [f for f, _ in plain if f >= n]
            want_free = min(fit) if fit else 100
            b, offset = bins.place(n)
            assert 100 - offset == want_free
            if fit:
                plain.remove(next(x for x in plain if x[1] == b))
            else:
                if len(plain) >= limit:
                    plain.remove(next(x for x in plain if x[0] == min(f for f, _ in plain) and x[1] not in bins.bins[x[0]]))
                made += 1
            if want_free > n:
                plain.append((want_free - n, b))
            assert sorted(plain) == sorted((f, x) for f, xs in enumerate(bins.bins) for x in xs) and len(plain) <= limit
        assert bins.made == made


def test_few_sequences_on_long_streams():
    rng = random.Random(9)
    for draw in (lambda: rng.randint(1, 2048), lambda: min(2048, int(rng.lognormvariate(6.5, 1))) or 1, lambda: rng.choice([700, 1300, 2048, 30])):
        lengths, bins, online = [draw() for _ in range(60_000)], packing.OpenBins(), packing.OpenBins()
        for k in range(0, len(lengths), packing.BLOCK):
            packing.place_all(lengths[k : k + packing.BLOCK], bins)
        unbounded = packing.OpenBins(limit=10**9)
        packing.place_all(lengths, unbounded)
        for n in lengths:
            online.place(n)
        assert bins.open <= packing.OPEN_BINS and online.closed > 0 and bins.closed > 0  # the bound binds
        assert bins.made <= 1.004 * unbounded.made + 2 and online.made <= 1.01 * unbounded.made + 2
