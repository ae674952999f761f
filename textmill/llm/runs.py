"""Periodic runs of words: stretches that repeat a block of words at least four times, found by heavy/light lag counting.

A run is a stretch of words with smallest period q and length >= max(6, 4 q) that no neighbouring word extends. At lag q it is an
island of equal pairs (word i, word i + q), at least ``_need(q)`` long. Which lags can hold one is told by the number of equal
pairs at every lag up to n / 4, which is exact:

* heavy words (frequent ones) by FFT: the spectra of their indicators are squared and added, one inverse transform gives the sum;
* light words by their pair differences, counted in pieces of bounded size.

The bound between both balances their cost, so a text of n words takes about n ** 1.5 steps at worst. Only lags with enough pairs
are scanned for islands. Pairs that a known run of a shorter period explains are taken off the counts of that period's multiples
first: a run of smallest period q shares fewer than d pairs with a run of period d, and at most two such long runs reach into it, so
what is left must still be 2 q. At long lags islands are searched by probes (an island covers sixteen of them) and read whole
only around streaks of hits.

All is local to a row: no shuffle, no state, whole texts. A task holds one batch of texts and a few arrays of its longest text.

Defined cases: a null or blank text has no words (n = 0), no run and an empty collapsed text; a null id has no checksum, so its
text is taken as it is; repeated rows and ids give a row each; an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release

#: Pair differences that are made at a time.
PAIRS = 1 << 20
#: Lags from which on islands are searched by probes, and probes that an island covers.
PROBED_LAG, PROBES = 22, 16

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _need(q: int) -> int:
    """Equal pairs in a row that a run of period q has at least."""
    return max(6, 4 * q) - q


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """counts[q] for q in 0..most: pairs (i, i + q) of equal words, exact (counts[0] is 0)."""
    n = len(ids)
    out = np.zeros(most + 1, np.int64)
    freq = np.bincount(ids)
    bound = max(64.0, (2.0 * n * np.log2(n + 1)) ** 0.5)
    heavy = np.flatnonzero(freq > bound)
    if len(heavy):
        size = 1 << int(np.ceil(np.log2(n + most + 1)))
        power = np.zeros(size // 2 + 1)
        for w in heavy:
            spectrum = np.fft.rfft(ids == w, size)
            power += spectrum.real**2 + spectrum.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    order = order[(freq[ids[order]] > 1) & (freq[ids[order]] <= bound)]
    if len(order):
        words = ids[order]
        ends = np.searchsorted(words, words, side="right")
        later = ends - np.arange(len(order)) - 1  # places of the same word after this one
        done = np.cumsum(later)
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS, side="right")))
            reps = later[at:to]
            first = np.repeat(np.arange(at, to), reps)
            step = np.arange(len(first)) - np.repeat(np.cumsum(reps) - reps, reps) + 1
            gap = order[first + step] - order[first]
            out += np.bincount(gap[gap <= most], minlength=most + 1)
            at = to
    out[0] = 0
    return out


def _streaks(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[begin, end) of stretches of true values, at least ``least`` long."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= least]


def islands(ids: np.ndarray, q: int) -> list[tuple[int, int]]:
    """[begin, end) of stretches of i with word i equal to word i + q, as long as a run of period q needs."""
    need, m = _need(q), len(ids) - q
    if q < PROBED_LAG:
        return _streaks(ids[:-q] == ids[q:], need)
    step = need // PROBES
    probes = np.arange(0, m, step)
    found = []
    for a, b in _streaks(ids[probes] == ids[probes + q], PROBES):
        lo, hi = (probes[a - 1] + 1 if a else 0), (probes[b] if b < len(probes) else m)
        found += [(lo + x, lo + y) for x, y in _streaks(ids[lo:hi] == ids[lo + q : hi + q], need)]
    return [(int(x), int(y)) for x, y in found]


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(ids)
    most = n // 4
    if n < 6 or most < 1:
        return []
    counts = lag_counts(ids, most)
    lags = np.arange(most + 1)
    asked = np.maximum(6, 4 * lags) - lags
    explained = np.zeros(most + 1, bool)
    found = []
    for q in np.flatnonzero(counts >= asked)[0:].tolist():
        if q == 0 or counts[q] < (2 * q if explained[q] else asked[q]):
            continue
        for a, b in islands(ids, q):
            s, e = a, b + q
            # A shorter period of so long a stretch divides q.
            if any(np.array_equal(ids[s : e - q // p], ids[s + q // p : e]) for p in _primes(q)):
                continue
            found.append((s, e - s, q))
            multiples = np.arange(2 * q, min(most, (e - s) // 2) + 1, q)
            counts[multiples] -= (e - s) - multiples
            explained[multiples] = True
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document in which every tenth checksum of the id makes the tail periodic."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def _number(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    open_ = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        open_[s + q] += 1
        open_[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(open_)[:-1] == 0)]


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period, then the smallest start, then period."""
    best = None
    for s, length, q in runs:  # by start, then period
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def told(doc_id: int | None, words: list[bytes]) -> tuple:
    """One row of SCHEMA."""
    runs = find_runs(_number(words))
    best = longest(runs)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(without_repeats(words, runs))
    return doc_id, len(runs), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text."""
    import pyarrow as pa

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "period")])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = t.encode().split()
                rows += [(d, *r) for r in find_runs(_number(planted(words, d) if plant else words))]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, schema=schema)
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): what is left of each text when every run keeps only its first period, words joined by one blank."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                words = t.encode().split()
                out.append(b" ".join(without_repeats(words, find_runs(_number(words)))).decode())
            yield pa.record_batch([b["doc_id"], pa.array(out, pa.string())], schema=schema)
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for each document, every tenth of them with a planted periodic tail (`planted`)."""
    import pyarrow as pa

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64() if k < 6 else pa.string()) for k, x in enumerate(names)])

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = [told(d, planted(t.encode().split(), d)) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        release()

    return _texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
