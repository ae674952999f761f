import random

import numpy as np
import pytest

from textmill.llm import prefixes as px
from textmill.llm import registry
from textmill.llm.tokens import encoder

from .fixtures import edge_docs, empty_docs
from .test_records import ODD, fresh

VOCAB = registry.vocabulary("word_bpe_49k.json")
TOK = fresh("word_bpe_49k.json")


def library(text):
    return len(TOK.encode(text, add_special_tokens=False).ids)


def counts(text):
    return np.cumsum(px.counter(VOCAB).steps(text), dtype=np.int64).tolist()


def check(text):
    assert counts(text) == [library(text[:k]) for k in range(1, len(text) + 1)], repr(text)


@pytest.mark.parametrize("text", ODD)
def test_every_prefix_of_odd_texts(text):
    check(text)


def test_every_prefix_of_random_texts():
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endo", "ftext|>", " ", "\n", "'", "'s", "'l", "l", "'r", "'ve", "don't", "a", "The ", "É", "́", "̣", "̸", "<", "12", "²", ".", "!?", "각", "ᅡ", "ᆨ", "ᄀ", "日本", "İ", "Σ", "ß", "Ɓ", "Ⱥ", "ȾE", "é", "😀", "‍", " ", "\u0085", "͸", "internationalization", "_", "कि", "ো", "ে", "া"]
    for _ in range(1500):
        check("".join(rng.choices(parts, k=rng.randint(1, 9))))


def test_every_prefix_of_long_words_and_documents(spark, sf):
    rng = random.Random(9)
    check("".join(rng.choice("etaoin") for _ in range(400)))
    check("日本語テキスト" * 30)
    check("x" * 300 + "!" * 200)
    check("e" + "̣́" * 12)
    for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(25).collect():
        check(text[:400])


def test_memories_may_be_emptied_at_any_time(monkeypatch):
    monkeypatch.setattr(px, "CACHE_WORDS", 2)
    monkeypatch.setattr(px, "CACHE_PAIRS", 3)
    monkeypatch.setattr(px, "CACHE_PIECES", 2)
    own = px.WordPrefixes(VOCAB)
    for text in ["the there then internationalization inter national", "naïve Żółć don't it's"] * 2:
        assert np.cumsum(own.steps(text)).tolist() == [library(text[:k]) for k in range(1, len(text) + 1)]


def test_large_differences_are_kept(monkeypatch):
    own = px.counter(VOCAB)
    got = own.piece("ﷺ" * 3)
    assert np.cumsum(np.frombuffer(got, np.int8) if isinstance(got, bytes) else got).tolist() == [library("ﷺ" * k) for k in (1, 2, 3)]
    monkeypatch.setitem(own.pieces, "wide", [300, -299, 0, 0])
    assert own.steps("a wide a").tolist() == [1, 0, 300, -299, 0, 0, 0, 1]


def test_lower_cases_beyond_the_short_range_have_the_library_s_ids():
    e = encoder(VOCAB, "word")
    for text in ("Ɓa", "xȺy", "Ⱦ", "ɓ Ɔ", "ƁƁ."):
        assert list(np.frombuffer(e.encode(text), e.dtype)) == TOK.encode(text, add_special_tokens=False).ids


def test_table_answers(spark):
    docs = edge_docs(spark).where("doc_id is null or doc_id <> 4")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    got = sorted((tuple(r) for r in px.token_counts(docs, VOCAB, 4).collect()), key=key)
    fits = lambda t: max(k for k in range(len(t) + 1) if library(t[:k]) <= 4)
    assert got == sorted(((d, len(t.encode()), library(t), library(t) > 4, fits(t)) for d, t in rows), key=key)
    cut = sorted((tuple(r) for r in px.truncated(docs, VOCAB, 4).collect()), key=key)
    assert cut == sorted(((d, t[: fits(t)], library(t[: fits(t)])) for d, t in rows), key=key)
    asked = px.prefix_table(docs, VOCAB).selectExpr("*", "array(0, 3, 1000000, null) as places")
    assert sorted(str(r.tokens) for r in px.tokens_upto(asked).collect()) == sorted(str([0, library(t[:3]), library(t), None]) for _, t in rows)
    assert not px.token_counts(empty_docs(spark), VOCAB).count()


def test_query_equals_the_library(spark, sf):
    from textmill.llm.common import table

    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in registry.op11_token_prefixes(spark, sf).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), library(r.text or ""), library(r.text or "") > 2048) for r in table(spark, sf, "documents").collect()}
