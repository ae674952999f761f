"""Language identification as inference of a multilingual mixture.

Each language has a character-trigram model (hashed to BUCKETS, additive smoothing), learned from labelled texts. A
document is a bag of words drawn from a mixture of languages; expectation-maximisation finds its proportions from
the words' likelihoods. The set of languages is chosen by penalised likelihood: languages enter in the order of their
proportions, and a set of k pays PENALTY * (k - 1) * ln(words + 1). The prediction is the set's largest language, its
score that language's proportion.

The models may be learned from a bounded sample: about ``docs_per_language`` different whole texts of each language, chosen by a
hash of text (copies of a text count once, so a hot copy neither fills the sample nor empties it). Each language costs the driver
a row of BUCKETS numbers. Prediction reads the text only.

Defined cases: a null text, or one without any letter (Unicode L), is `und` with score 0 and no proportions; ties go to
the language that sorts first; rows with a null language teach nothing; repeated rows each get a row; without any labelled
text all predictions are `und`; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE = 1500
SMOOTHING = 0.3
ROUNDS = 8
PENALTY = 2.0
CACHE_WORDS = 120_000
UND = "und"
#: Documents that go through one vectorised run of the rounds.
BLOCK = 400

_WORD = re.compile(r"[^\W\d_]+")


def trigrams(word: str) -> list[str]:
    w = f"\x02{word}\x03"
    return [w[k : k + 3] for k in range(len(w) - 2)] or [w]


class Buckets(dict):
    """trigram -> bucket"""

    def __missing__(self, gram: str) -> int:
        b = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) < 300_000:
            self[gram] = b
        return b


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> tuple[list[str], object]:
    """(languages, log-probabilities [bucket, language]) from labelled rows."""
    import numpy as np
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_language / max(1, counts[k])))])
    unit = (F.col("h") % (1 << 31) / float(1 << 31) + 1) / 2
    sample = rows.where(unit < share[F.col("lang")]).groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    sample = sample.repartition(max(1, min(8, sum(min(n, docs_per_language) for n in counts.values()) // 500)))

    def count(batches: Iterator) -> Iterator:
        got: dict[str, object] = {}
        bucket = Buckets()
        for b in batches:
            for text, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                words = Counter(w for w in _WORD.findall(text.lower()) if not w.isnumeric())
                own = got.setdefault(lang, np.zeros(BUCKETS, np.float32))
                for w, n in words.items():
                    for g in trigrams(w):
                        own[bucket[g]] += n
        yield pa.record_batch([pa.array(list(got), pa.string()), pa.array([v.tobytes() for v in got.values()], pa.binary())], names=["lang", "counts"])

    total = np.zeros((BUCKETS, len(langs)))
    for r in sample.mapInArrow(count, "lang string, counts binary").collect():
        total[:, langs.index(r.lang)] += np.frombuffer(r["counts"], np.float32)
    used = np.count_nonzero(total.sum(1)) + 1
    return langs, np.log((total + SMOOTHING) / (total.sum(0) + SMOOTHING * used)).astype(np.float32)


class Inference:
    """Proportions of batches of texts. Remembers words between batches of a worker."""

    def __init__(self, langs: list[str], logp):
        import numpy as np

        self.langs, self.logp, self.bucket = langs, logp, Buckets()
        self.place: dict[str, int] = {}
        self.table = np.zeros((CACHE_WORDS, len(langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        """Relative likelihoods of new words; a word without a letter has none (all zero)."""
        import numpy as np

        grams = [[self.bucket[g] for g in trigrams(w)] for w in words]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        flat = np.fromiter((b for g in grams for b in g), np.int64, int(sizes.sum()))
        ll = np.add.reduceat(self.logp[flat].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        p = np.exp(np.maximum(ll - ll.max(1, keepdims=True), -60.0))
        p[[not any(map(str.isalpha, w)) for w in words]] = 0
        at = len(self.place)
        self.table[at : at + len(words)] = p
        self.place.update(zip(words, range(at, at + len(words)), strict=True))

    def proportions(self, texts: list[str | None]):
        """(proportions [text, language] of the selected sets, has a letter [text])."""
        import numpy as np

        if not self.langs:
            return np.zeros((len(texts), 0)), np.zeros(len(texts), bool)
        bags = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
        new = list(dict.fromkeys(w for bag in bags for w in bag if w not in self.place))
        if len(self.place) + len(new) > len(self.table):
            self.place = {}
            new = list(dict.fromkeys(w for bag in bags for w in bag))
            if len(new) > len(self.table):
                self.table = np.zeros((len(new) + CACHE_WORDS, len(self.langs)), np.float32)
        if new:
            self._learn(new)
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        place = self.place
        at = np.fromiter((place[w] for bag in bags for w in bag), np.int64, int(sizes.sum()))
        n = np.fromiter((c for bag in bags for c in bag.values()), np.float64, int(sizes.sum()))
        p = self.table[at].astype(np.float64)
        doc = np.repeat(np.arange(len(bags)), sizes)
        good = p.sum(1) > 0
        p, n, doc = p[good], n[good], doc[good]
        words = np.bincount(doc, n, len(bags))
        theta = np.zeros((len(bags), len(self.langs)))
        if len(doc):
            begin = np.flatnonzero(np.r_[True, np.diff(doc) > 0])
            theta[doc[begin]] = self._select(p, n, np.cumsum(np.r_[False, np.diff(doc) > 0]), begin, words[doc[begin]])
        return theta, words > 0

    @staticmethod
    def _em(p, n, doc, begin, total, theta, rounds):
        import numpy as np

        like = None
        for _ in range(rounds):
            q = p * theta[doc]
            s = np.maximum(q.sum(1), 1e-300)
            theta = np.add.reduceat(q * (n / s)[:, None], begin, axis=0) / total[:, None]
            like = s
        return theta, np.add.reduceat(n * np.log(like), begin)

    def _select(self, p, n, doc, begin, total):
        import numpy as np

        k = p.shape[1]
        full, _ = self._em(p, n, doc, begin, total, np.full((len(begin), k), 1.0 / k), ROUNDS)
        order = np.argsort(-full, axis=1, kind="stable")
        best, out = np.full(len(begin), -np.inf), np.zeros_like(full)
        for size in range(1, k + 1):
            mask = np.zeros_like(full)
            np.put_along_axis(mask, order[:, :size], 1.0, axis=1)
            start = np.maximum(full, 1e-6) * mask
            theta, like = self._em(p, n, doc, begin, total, start / start.sum(1, keepdims=True), 1 if size == 1 else 4)
            score = like - PENALTY * (size - 1) * np.log(total + 1)
            take = score > best + 1e-9
            best[take], out[take] = score[take], theta[take]
        return out


RESULT = "lang_pred string, score double, langs string"


def predicted(docs: DataFrame, langs: list[str], logp, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the predicted language, its proportion, and the selected set as `lang:proportion,...`."""
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((langs, logp))
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes if n != "_text") + ", " + RESULT

    def run(batches: Iterator) -> Iterator:
        langs, logp = shared.value
        model = Inference(langs, logp)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                theta, letters = model.proportions(b["_text"].to_pylist())
                out = []
                for t, some in zip(theta.tolist(), letters.tolist(), strict=True):
                    k = max(range(len(langs)), key=lambda j: (t[j], -j)) if some and langs else -1
                    out.append((UND, 0.0, "") if k < 0 else (langs[k], min(1.0, t[k]), ",".join(f"{langs[j]}:{t[j]:.4f}" for j in sorted(range(len(langs)), key=lambda j: -t[j]) if t[j] > 0)))
                cols = list(zip(*out, strict=True))
                new = [pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.float64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], *new], names=[*keep, "lang_pred", "score", "langs"])
        del model
        release()

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    langs, logp = learn(docs.where(~held_out()))
    return predicted(docs.select("doc_id", held_out().alias("held_out"), "text"), langs, logp, keep=("doc_id", "held_out"))
