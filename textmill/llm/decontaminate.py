"""Benchmark decontamination with a distributed positional inverted index. DataFrame functions only.

Index: one posting (document key, term, position) for each document word that is a word of any test item, kept by
document as the scan finds them, so that building it moves nothing. A term is the number of a distinct word, found by the word
itself. A posting of an end marker holds the number of words. Search, for each distinct window of test words: its terms are
ordered by their counts in the whole corpus; the postings of the rarest term, shifted by its offset, are candidate starts; they are
intersected with the shifted postings of the next rarest term, then, list after list in steps of doubling size, with those of
all others. The index alone settles a match; no text is read again.

`phrase_matches` gives exact occurrences, `proximity_matches` occurrences whose terms may each stand up to ``slop``
words off their place. Both intersect from the rarest term on, and both look only at postings of documents that
still have candidates.

A vocabulary too large to broadcast is joined in SALTS copies, so that a very common word is no hot key.

Words: A-Z are lowered, then runs of characters that are neither ASCII symbols nor ASCII controls nor blanks. A null
or empty text has no words. Repeated rows each get their row; null ids stay null; items without words or with a null
text match nothing; items with a null id hit words, but are in no list and not counted; repeated items count
once; an empty table on either side gives no match. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import fits_broadcast
from .common import broadcast_if_small, doc_key, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Markers after a document's last word: its position is the number of words. No word holds a NUL.
END, END_NULL_ID = "\x00", "\x00\x00"
#: Their numbers, and the copies of a vocabulary that is joined by a shuffle.
MARKS = {END: -1, END_NULL_ID: -2}
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | Column) -> Column:
    """The words of a text; a null text has none."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = F.octet_length(t) == F.char_length(t)
    return F.regexp_extract_all(F.when(plain, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER)), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, their items): distinct windows (wid, words, n), and (wid, item) with ids as strings, null ids left out."""
    w = items.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    each = w.select("item", F.explode(F.transform(starts, lambda s: F.slice(F.col("w"), s + 1, size))).alias("words"))
    each = materialize(each.distinct(), "windows-of-items")
    windows = each.select("words").distinct().select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("n"))
    windows = materialize(windows, "windows")
    return windows, materialize(each.where("item is not null").join(broadcast_if_small(windows), "words").select("wid", "item"), "items-of-windows")


def vocabulary_of(windows: DataFrame) -> DataFrame:
    """(word, term): a number for each distinct word of the windows, and for the end markers."""
    marks = windows.sparkSession.createDataFrame(list(MARKS.items()), "word string, term long")
    words = windows.select(F.explode("words").alias("word")).distinct().select("word", F.monotonically_increasing_id().alias("term"))
    return materialize(words.unionByName(marks), "vocabulary")


def build_index(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (k1, k2, term, pos) of all words in ``vocab``, and one end marker for each document row."""
    marked = F.array_append(words_of(text_col), F.when(F.col(id_col).isNull(), END_NULL_ID).otherwise(END))
    every = docs.select(*doc_key(id_col, text_col), marked.alias("w")).select("k1", "k2", F.posexplode("w").alias("pos", "word"))
    if fits_broadcast(vocab):
        found = every.join(F.broadcast(vocab), "word")
    else:
        copies = vocab.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = every.withColumn("salt", F.pmod(F.xxhash64("k1", "k2", "pos"), F.lit(SALTS)).cast("int")).join(copies.hint("merge"), ["word", "salt"])
    return materialize(found.select("k1", "k2", "term", "pos"), "postings")


def ranked_terms(windows: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """(wid, n, off, term, rank): a window's terms, rarest in the corpus first; windows with an absent term are left out."""
    terms = windows.select("wid", "n", F.posexplode("words").alias("off", "word")).join(broadcast_if_small(vocab), "word")
    counts = broadcast_if_small(materialize(index.groupBy("term").agg(F.count("*").alias("cf")), "term-counts"))
    order = Window.partitionBy("wid").orderBy("cf", "term", "off")
    ranked = terms.join(counts, "term").withColumn("rank", F.row_number().over(order) - 1)
    whole = F.count("*").over(Window.partitionBy("wid"))
    return materialize(ranked.withColumn("_found", whole).where("_found = n").select("wid", "n", "off", "term", "rank"), "ranked")


def _starts(ranked: DataFrame, index: DataFrame) -> DataFrame:
    """Candidate starts (k1, k2, wid, n, s): places of each window's rarest term, shifted by its offset."""
    first = ranked.where("rank = 0").select("wid", "n", "term", F.col("off").alias("o0"))
    return index.join(broadcast_if_small(first), "term").select("k1", "k2", "wid", "n", (F.col("pos") - F.col("o0")).alias("s"))


def _lists(index: DataFrame, ranked: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Postings of the terms of ``ranked``, in the documents of ``keys``."""
    terms = ranked.select("term").distinct()
    found = index.join(broadcast_if_small(materialize(terms, "terms")), "term", "left_semi")
    return found if keys is None else found.join(broadcast_if_small(keys), ["k1", "k2"], "left_semi")


def phrase_matches(windows: DataFrame, vocab: DataFrame, index: DataFrame) -> DataFrame:
    """Exact occurrences: (k1, k2, wid, n, s), s the position of the first word. Rows of equal documents give theirs once."""
    ranked = ranked_terms(windows, vocab, index)
    second = ranked.where("rank = 1").select("wid", F.col("term").alias("t1"), F.col("off").alias("o1"))
    starts = _starts(ranked, index).where("s >= 0")
    next_list = _lists(index, ranked.where("rank = 1")).select("k1", "k2", F.col("term").alias("t1"), F.col("pos").alias("p1"))
    left = starts.join(broadcast_if_small(second), "wid", "left")
    both = left.where("n > 1").withColumn("p1", F.col("s") + F.col("o1")).join(next_list, ["k1", "k2", "t1", "p1"], "left_semi")
    names = ["k1", "k2", "wid", "n", "s"]
    found = materialize(both.select(*names).unionByName(left.where("n = 1").select(*names)).distinct(), "candidates")
    keys = materialize(found.where("n > 2").select("k1", "k2").distinct(), "candidate-documents")
    rest = materialize(_lists(index, ranked.where("rank > 1"), keys).distinct(), "rest-of-postings")
    longest = ranked.agg(F.max("n")).head()[0] or 0
    low = 2
    while low < longest:
        high = min(longest, 2 * low)
        step = broadcast_if_small(ranked.where(F.col("rank").between(low, high - 1)).select("wid", "off", "term"))
        asked = found.where(F.col("n") > low).join(step, "wid").withColumn("pos", F.col("s") + F.col("off"))
        hit = asked.join(rest, ["k1", "k2", "term", "pos"]).groupBy(*names).agg(F.count("*").alias("m"))
        kept = hit.where(F.col("m") == F.least(F.col("n"), F.lit(high)) - low).select(*names)
        found = materialize(kept.unionByName(found.where(F.col("n") <= low)), "candidates")
        low = high
    return found


def proximity_matches(windows: DataFrame, vocab: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """Places (k1, k2, wid, n, s) where every term of the window stands within ``slop`` words of its place, the rarest
    term exactly at its own (so s may lie up to ``slop`` before the text). Lists are intersected from the rarest to the commonest
    term in steps of doubling size. Rows of equal documents give their places once."""
    ranked = ranked_terms(windows, vocab, index)
    names, width = ["k1", "k2", "wid", "n", "s"], slop + 1
    block = lambda c: F.floor(c / F.lit(width)).cast("long")
    found = materialize(_starts(ranked, index).where(F.col("s") >= -slop).distinct(), "candidates")
    longest = ranked.agg(F.max("n")).head()[0] or 0
    low = 1
    while low < longest:
        high = min(longest, 2 * low)
        step = ranked.where(F.col("rank").between(low, high - 1)).select("wid", "off", "term")
        want = found.where(F.col("n") > low).join(broadcast_if_small(step), "wid").withColumn("p", F.col("s") + F.col("off"))
        want = want.withColumn("b", F.explode(F.array(block(F.col("p")) - 1, block(F.col("p")), block(F.col("p")) + 1)))
        lists = _lists(index, step).select("k1", "k2", "term", "pos", block(F.col("pos")).alias("b"))
        near = want.join(lists, ["k1", "k2", "term", "b"]).where(F.abs(F.col("pos") - F.col("p")) <= slop)
        near = near.groupBy(*names).agg(F.count_distinct("off").alias("m"))
        kept = near.where(F.col("m") == F.least(F.col("n"), F.lit(high)) - low).select(*names)
        found = materialize(kept.unionByName(found.where(F.col("n") <= low)), "candidates")
        low = high
    return found


def _covered(spans: Column) -> Column:
    """Number of positions that an ascending array of (s, e), e exclusive, covers."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("sum"))
    return F.aggregate(spans, start, step, lambda a: a["sum"])


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", slop: int | None = None) -> DataFrame:
    """One row per document row: n_words, n_hit, n_items, item_ids (sorted as strings), contaminated. ``slop`` adds n_near: the
    distinct windows of which the document has a proximity match."""
    windows, owners = windows_of(items, size)
    vocab = vocabulary_of(windows)
    index = build_index(docs, vocab, id_col, text_col)
    hits = phrase_matches(windows, vocab, index)
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).alias("spans"))
    of_doc = hits.select("k1", "k2", "wid").distinct().join(broadcast_if_small(owners), "wid").select("k1", "k2", "item").distinct()
    listed = of_doc.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("item")).alias("item_ids"))
    by_doc = spans.join(listed, ["k1", "k2"], "left")
    if slop is not None:
        near = proximity_matches(windows, vocab, index, slop).select("k1", "k2", "wid").distinct().groupBy("k1", "k2").agg(F.count("*").alias("near"))
        by_doc = by_doc.join(near, ["k1", "k2"], "full")
    rows = index.where(F.col("term").isin(*MARKS.values()))
    rows = rows.select(F.when(F.col("term") == MARKS[END], F.col("k1")).alias(id_col), "k1", "k2", F.col("pos").cast("long").alias("n_words"))
    n_hit = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    more = [F.coalesce("near", F.lit(0)).cast("long").alias("n_near")] if slop is not None else []
    by_doc = materialize(by_doc, "hits-of-documents")
    found = rows.join(broadcast_if_small(by_doc), ["k1", "k2"], "left")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), *more, "k1", "k2")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with their own columns."""
    bad = contamination(docs, items, size).where("contaminated").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    bad = materialize(bad, "contaminated")
    k1, k2 = doc_key()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), k1.alias("_own1"), k2.alias("_own2"))
    return rows.join(broadcast_if_small(bad), (F.col("_own1") == F.col("_k1")) & (F.col("_own2") == F.col("_k2")), "left_anti").select("_row.*")


def digest(found: DataFrame) -> DataFrame:
    """Contract columns of `contamination`."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, s, s + 9), ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
p AS (SELECT r, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT p.r, p.s, p.n, g.item_id FROM p JOIN g ON p.k = g.k AND p.n = g.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
