import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import records, registry
from textmill.llm.common import fresh_path
from textmill.llm.tokens import PieceEncoder, encoder

from .fixtures import edge_docs, empty_docs

VOCAB = registry.vocabulary("word_bpe_49k.json")
ODD = ["", " ", "  a", "a  b", "a \n b\n\n  c ", "a   ", "don't 's it's  ok foo', bar.'s", "É́ á b̀ e´", "a\xa0b  c", "x\x1cy \x1d z", "<|endoftext|> hi", "a <|endoftext|><|startoftext|>b <|ENDOFTEXT|> <|endoftext|>", "<|endoftext|>", "don'<|endoftext|>t  \n<|endoftext|>  x", "<|endof<|endoftext|>text|>", "日本語 テキスト", "a\t\tb \t c", "I'M 'S ΑΣ ΑΣ β", "a\x85 b", "\n a", "\x00 a \x00", "a.b,c !!! ???", "w" * 500, "²½ a² 12 345x", "x foo.\nBar, z", "x foo'\ns y", "x a\n\nB", "x École,\nÉté! y", "x a\n's y", "x 12\nab", "y it's.\nThe x"]


def fresh(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary(name))


def library_ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_piecewise_ids_equal_library(name, kind, spark, sf):
    e, tok = encoder(registry.vocabulary(name), kind), fresh(name)
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", " ", "\n", "'s", "a", "The ", "É", "\u0301", "<|", "12", ".", "<|END", "oftext|>"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts + texts[:30]:
        assert list(np.frombuffer(e.encode(t), e.dtype)) == library_ids(tok, t), t[:80]
    own = PieceEncoder(registry.vocabulary(name), kind, special_as_text=True)
    tok.encode_special_tokens = True
    for t in texts[:2000]:
        assert list(np.frombuffer(own.encode(t), e.dtype)) == library_ids(tok, t), t[:80]


def brute(rows):
    """Per document in (id, hash) order: start, n, crc."""
    tok = fresh("word_bpe_49k.json")
    at, out = 0, []
    for doc_id, text in rows:
        ids = np.array([*library_ids(tok, text or ""), 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def ordered(docs):
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id", F.xxhash64("text"))
    return [(r.doc_id, r.text) for r in d.collect()]


def check(spark, docs):
    got = records.token_records(spark, docs, VOCAB, "word", 2)
    rows = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got.collect())
    assert [(d, s, n, c) for s, d, n, c in rows] == brute(ordered(docs))


def test_round_trip_edge_cases(spark):
    check(spark, edge_docs(spark))
    assert records.token_records(spark, empty_docs(spark), VOCAB).count() == 0


def test_whole_table(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))


def test_shuffled_reads_and_many_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    root = fresh_path(spark, "records")
    index = records.write_records(docs, root, VOCAB, "word", 2, docs_per_shard=30)
    assert index.select("shard").distinct().count() > 3
    some = index.where("doc_id % 7 = 3").orderBy(F.xxhash64("doc_id"))
    got = {r.doc_id: r.n_tokens for r in records.read_records(some, root).collect()}
    assert got == {r.doc_id: r.n_tokens for r in some.collect()}


def test_damage_is_found():
    data = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(data)) == (b"payload", len(data))
    for k in range(len(data)):
        bad = bytes(data[:k]) + bytes([data[k] ^ 1]) + bytes(data[k + 1 :])
        with pytest.raises(ValueError):
            records.unframe(bad)
