"""Best-fit packing of tokenized documents into sequences of a fixed size.

Each task packs its pieces online with a bounded number of open bins. Open bins are kept in a bitset keyed by free
space (bit f is set if an open bin has f free tokens, with the bins of that free space in a list), so the best fit
for a piece of n tokens is the lowest set bit at or above n: one shift and one bit scan. If nothing fits and the
bins are all in use, the fullest open bin (the lowest set bit) closes; `OpenBins.closed` counts those. Pieces come in the order
of a hash, with a bounded look-ahead: each BLOCK of them is placed in descending length. Half as many bins as a block has pieces are
enough: with fewer the long pieces of a block close bins that its short ones need (512 bins take 1.06 times as many sequences for uniform
lengths), and pieces of half a sequence and more let a block open about so many. A stream of fewer pieces than that never meets the bound.

Pieces are dealt to tasks by a hash of their length and id, never by document, source or length alone, so that each
task gets the same mixture and a hot source or a frequent length is split. A task gets at least ``pieces_per_task``
pieces: what the last open bins waste is a small constant for each task, far below one in a thousand sequences.

Defined cases: a null text is the empty text (one piece: the end id); equal ids make separate pieces; an empty table
gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, release
from .tokens import encoder

CAPACITY = 2048
OPEN_BINS = 2560
BLOCK = 5120
PIECES_PER_TASK = 100_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``limit`` open bins of ``capacity`` tokens; `place` gives (bin, offset) of a piece of n tokens."""

    def __init__(self, capacity: int = CAPACITY, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits, self.bins, self.open, self.made, self.closed = 0, [[] for _ in range(capacity + 1)], 0, 0, 0

    def _take(self, free: int) -> int:
        b = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return b

    def place(self, n: int) -> tuple[int, int]:
        if not 0 < n <= self.capacity:
            raise ValueError(f"a piece of {n} tokens does not fit a sequence of {self.capacity}")
        fits = self.bits >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, b = self.capacity, self.made
            self.made += 1
        left = free - n
        if left:
            self.bins[left].append(b)
            self.bits |= 1 << left
            self.open += 1
        return b, self.capacity - free


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities, except that the first piece may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(a, capacity) for a in range(first, n, capacity)]


def place_all(lengths: list[int], bins: OpenBins) -> list[tuple[int, int]]:
    """(bin, offset) of each piece of one block; longer pieces are placed first, equal ones in order."""
    out: list = [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        out[k] = bins.place(lengths[k])
    return out


def pieces(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut only documents longer than ``capacity``. ``with_ids`` adds the ids themselves."""
    import pyarrow as pa

    names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 3] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        enc = encoder(vocabulary, kind)
        end = end_id.to_bytes(enc.width, "little")
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, enc.dtype).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + n]
                    for col, v in zip(cols, (doc_id, k, start, n, zlib.crc32(part.tobytes()), part), strict=False):
                        col.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        release()

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE + ", ids array<int>" * with_ids)


def pack(parts: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, pieces_per_task: int = PIECES_PER_TASK, look_ahead: int = BLOCK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. ``parts`` must be materialized: it is counted first. ``look_ahead`` 1 is
    strictly online."""
    import pyarrow as pa

    tasks = max(1, parts.count() // pieces_per_task)
    schema = parts.schema.add("sequence_id", "long").add("offset", "long")
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    dealt = parts.repartition(tasks, *keys).sortWithinPartitions(F.xxhash64(*keys), *keys)

    def run(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        base, bins = TaskContext.get().partitionId() << 40, OpenBins(capacity, open_bins)

        def placed(block: list) -> pa.Table:
            t = pa.Table.from_batches(block).combine_chunks()
            at = place_all(t["length"].to_pylist(), bins)
            t = t.append_column("sequence_id", pa.array([base + x for x, _ in at], pa.int64()))
            return t.append_column("offset", pa.array([o for _, o in at], pa.int64()))

        held, rows = [], 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, look_ahead - rows)
                held.append(part)
                rows, b = rows + part.num_rows, b.slice(part.num_rows)
                if rows == look_ahead:
                    yield from placed(held).to_batches()
                    held, rows = [], 0
        if held:
            yield from placed(held).to_batches()

    return dealt.mapInArrow(run, schema)


def packed(docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: one row per piece, with its sequence and its place there."""
    parts = materialize(pieces(docs, vocabulary, kind, end_id, capacity, with_ids=with_ids), "pieces")
    return pack(parts, capacity)
