"""Quality classifier: ordinal regression with a cumulative logit link on graded ratings.

P(grade > k) = sigmoid(x.w - t_k): one vector of weights over hashed text features, and ordered thresholds t_0 < t_1 <
... It yields an expected grade and the probability of the upper tail, on which selection rests.

Features (presence, hashed to BUCKETS): words stripped of symbols, in lower case; the symbols a token ends with; shapes
(capitals, repeated neighbours); and quantised shares over the whole text (capitals, symbol tails, distinct tokens, bars,
repeated lines, mean word length, length). Shares that say nothing of short texts are levels of their own there: distinct tokens and the
commonest token up to SHORT tokens; only lines longer than LINE characters count as repeated. All of a text is read. Ratings for fitting are a sample of at most ``max_train``
rated documents, chosen by a hash of the id.

Defined cases: a null text is the empty text; a null id or grade rates nothing; of several grades of one document the lowest
holds; without any rating nothing speaks against a document: grade 0, tail probability 1, all selected; one
single grade among all ratings is predicted for all; repeated rows each get a row; an empty table gives no rows; other columns
are ignored or kept as they are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

BUCKETS = 1 << 18
MAX_TRAIN = 16_000
MIN_DOCS = 4
SHORT, LINE = 30, 20
ROUNDS = 500
PENALTY = 0.1
#: Least chance of the highest grade with which a document is selected.
LEAST_P = 0.7

_TAIL = re.compile(r"[^\w\s]+$")
_HEAD = re.compile(r"^[^\w\s]+")


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % BUCKETS


class Hashes(dict):
    """token -> (bucket of its word, bucket of its tail or -1, is in capitals, has a symbol tail beyond , . ; :)"""

    def __missing__(self, token: str) -> tuple[int, int, bool, bool]:
        tail = _TAIL.search(token)
        tail = tail[0] if tail else ""
        core = _HEAD.sub("", token[: len(token) - len(tail)])
        word = _hash("w " + core.lower()) if core else -1
        odd = tail.strip(".,;:") if tail else ""
        got = (word, _hash("t " + tail) if tail else -1, len(core) > 1 and core.isupper(), bool(odd))
        if len(token) <= 60:
            if len(self) > 80_000:
                self.clear()
            self[token] = got
        return got


def _level(x: float) -> int:
    """A share in 0..1, quantised finer near 0."""
    return 0 if x <= 0 else 1 + int(min(0.999, x) ** 0.5 * 12)


def buckets_of(text: str, memory: Hashes):
    """Sorted distinct feature buckets of a text, as int32."""
    import numpy as np

    tokens = text.split()
    n = len(tokens)
    counts = Counter(tokens)
    got = [(memory[t], c) for t, c in counts.items()]
    found = {b for (w, t, _, _), _ in got for b in (w, t)}
    found.discard(-1)
    m = max(1, n)
    caps, odd = sum(c for (_, _, u, _), c in got if u) / m, sum(c for (_, _, _, o), c in got if o) / m
    lines = [x for x in text.split("\n") if len(x) > LINE]
    twice = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / m
    stats = {
        "caps": _level(caps), "odd": _level(odd), "distinct": int(len(counts) / m * 8) if n > SHORT else 9, "bars": _level(counts["|"] / m),
        "lines": _level(1 - len(set(lines)) / len(lines)) if lines else 0, "twice": _level(twice), "top": _level(max(counts.values(), default=0) / m) if n > SHORT else -1,
        "chars": min(12, int(len(text) / m)), "size": n.bit_length(),
    }
    found.update(_hash(f"s {k} {v}") for k, v in stats.items())
    return np.array(sorted(found), np.int32)


@dataclass
class Ordinal:
    """Fitted model; ``grades`` are the rating values in ascending order."""

    grades: list[int]
    weights: object
    thresholds: object

    def tails(self, rows: list):
        """P(grade > k) for each k, one row per list of buckets."""
        import numpy as np

        z = np.array([float(self.weights[r].sum()) for r in rows])
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -60, 60)))


def fit(rows: list, grade: list[int], rounds: int = ROUNDS) -> Ordinal:
    """Maximum likelihood with an L1 penalty on standardised features, by accelerated proximal gradient steps over
    the whole sample. ``rows``: arrays of buckets. The penalty is PENALTY / sqrt(rows), in step with the noise of a gradient."""
    import numpy as np

    grades = sorted(set(grade))
    k, n = len(grades), len(rows)
    weights = np.zeros(BUCKETS, np.float32)
    if k < 2:
        return Ordinal(grades, weights, np.zeros(0))
    y = np.searchsorted(grades, grade)
    df = np.bincount(np.concatenate(rows), minlength=BUCKETS)
    used = np.flatnonzero((df >= MIN_DOCS) & (df < n))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    rows = [place[r][place[r] >= 0].astype(np.int32) for r in rows]
    parts = []  # (first document, its documents' numbers from there, features) in pieces, to bound what a step needs
    for a in range(0, n, 2000):
        part = rows[a : a + 2000]
        parts.append((a, len(part), np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part]), np.concatenate(part)))
    del rows
    nw, mean = len(used), df[used] / n
    scale = 1 / np.sqrt(mean * (1 - mean))
    share = np.array([(y > j).mean() for j in range(k - 1)])
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))

    def forward(v):
        w = v * scale
        return np.concatenate([np.bincount(doc, w[idx], k) for _, k, doc, idx in parts]) - w @ mean

    def back(gz):
        total = np.zeros(nw)
        for a, k, doc, idx in parts:
            total += np.bincount(idx, gz[a : a + k][doc], nw)
        return scale * (total - mean * gz.sum())

    def gradient(v, t):
        z = forward(v)
        tail = np.concatenate([np.ones((n, 1)), sigmoid(z[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        up, low = tail[np.arange(n), y], tail[np.arange(n), y + 1]
        prob = np.maximum(up - low, 1e-9)
        dup, dlow = up * (1 - up) / prob / n, low * (1 - low) / prob / n
        gt = np.zeros(k - 1)
        np.add.at(gt, (y - 1)[y > 0], dup[y > 0])
        np.add.at(gt, y[y < k - 1], -dlow[y < k - 1])
        return back(dlow - dup), gt

    top = np.ones(nw) / max(1, nw) ** 0.5
    size = 1.0
    for _ in range(12):
        top = back(forward(top) / n)
        size = max(float(np.linalg.norm(top)), 1e-9)
        top /= size
    step, penalty = 1 / (0.5 * size + 2), PENALTY / n**0.5
    v, t = np.zeros(nw), -np.log(share / (1 - share))
    av, at, mom = v, t, 1.0
    for _ in range(rounds):
        gv, gt = gradient(av, at)
        nv = av - step * gv
        nv = np.sign(nv) * np.maximum(np.abs(nv) - step * penalty, 0)
        nt = np.sort(at - 4 * step * gt)
        if gv @ (nv - v) + gt @ (nt - t) > 0:  # momentum points uphill: start it anew
            mom = 1.0
        more = (1 + (1 + 4 * mom * mom) ** 0.5) / 2
        av, at = nv + (mom - 1) / more * (nv - v), np.sort(nt + (mom - 1) / more * (nt - t))
        v, t, mom = nv, nt, more
    w = v * scale
    weights[used] = w
    return Ordinal(grades, weights, t + w @ mean)


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_train: int = MAX_TRAIN) -> Ordinal:
    """Fit on a hash sample of at most ``max_train`` rated documents. What reaches the driver are their feature buckets."""
    import numpy as np
    import pyarrow as pa

    bounded_batches(docs.sparkSession)
    rated = ratings.select(F.col(id_col).cast("long").alias("_id"), F.col(grade_col).cast("int").alias("_grade")).dropna()
    rated = rated.groupBy("_id").agg(F.min("_grade").alias("_grade"))
    picked = rated.orderBy(F.xxhash64("_id"), "_id").limit(max_train).collect()
    if not picked:
        return Ordinal([], np.zeros(BUCKETS, np.float32), np.zeros(0))
    spark = docs.sparkSession
    few = spark.createDataFrame([tuple(r) for r in picked], "_id long, _grade int")  # at most max_train rows
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(few), "_id")
    texts = texts.select("_id", "_grade", "_text", F.xxhash64("_text").alias("_h"))

    def run(batches: Iterator) -> Iterator:
        memory = Hashes()
        for b in batches:
            data = [buckets_of(t, memory).tobytes() for t in b["_text"].to_pylist()]
            yield pa.record_batch([b["_id"], b["_h"], b["_grade"], pa.array(data, pa.binary())], names=["_id", "_h", "_grade", "_x"])
        release()

    rows = texts.select("_id", "_h", "_grade", "_text").mapInArrow(run, "_id long, _h long, _grade int, _x binary")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_h").limit(max_train).collect()
    if not rows:
        return Ordinal([], np.zeros(BUCKETS, np.float32), np.zeros(0))
    return fit([np.frombuffer(r["_x"], np.int32) for r in rows], [r["_grade"] for r in rows])


RESULT = "grade integer, expected_grade double, p_tail double, selected boolean"


def graded(docs: DataFrame, model: Ordinal, least_grade: int | None = None, least_p: float = LEAST_P, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all), most likely grade, expected grade, p_tail = P(grade >= least_grade) (default:
    the highest grade), selected = p_tail >= least_p. A kept column named like one of these gives way to it."""
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in [x.split()[0] for x in RESULT.split(", ")]]
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text_for_grade"))
    schema = docs.select(*keep).schema
    for x in RESULT.split(", "):
        schema = schema.add(*x.split())

    def run(batches: Iterator) -> Iterator:
        model, memory = shared.value, Hashes()
        values = np.array(model.grades or [0], float)
        cut = len(values) - 1 if least_grade is None else int(np.searchsorted(values, least_grade))
        for b in batches:
            tails = model.tails([buckets_of(t, memory) for t in b["_text_for_grade"].to_pylist()])
            n = b.num_rows
            full = np.concatenate([np.ones((n, 1)), tails, np.zeros((n, 1))], axis=1)
            prob = full[:, :-1] - full[:, 1:]
            p_tail = full[:, cut] if model.grades else np.ones(n)
            new = [pa.array(values[prob.argmax(1)].astype(np.int32)), pa.array(prob @ values), pa.array(p_tail), pa.array(p_tail >= least_p)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], names=[*keep, "grade", "expected_grade", "p_tail", "selected"])
        release()

    return rows.mapInArrow(run, schema)


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """Grade 0..3 from `quality` and `toxic`: low and toxic, low, toxic, good. Rows with a null are no rating."""
    return labels.select("doc_id", (2 * F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def selected_documents(docs: DataFrame, ratings: DataFrame, least_p: float = LEAST_P) -> DataFrame:
    """The rows of ``docs`` whose chance of the highest grade is at least ``least_p``, with their own columns."""
    model = train(docs, ratings)
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text"))
    kept = graded(tagged, model, least_p=least_p, keep=["_row"]).where("selected")
    return kept.select("_row.*")
