"""Token-ID output: length-delimited binary records with masked checksums and a separate offset index.

File format (little-endian). A shard file is a run of frames; a frame is

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

and a payload is ``u8 id width | i64 document id | ids``. The mask (rotate right by 15 bits, add a constant)
keeps the checksum of data that itself holds checksums from degenerating. Shards hold the documents in ascending
order of id, shard after shard; the index (Parquet: file, shard, doc_id, ordinal, offset, length, n_tokens,
start) lets a reader fetch any record in any order by byte range.

Defined cases: a null text is the empty text (only the end id); a null id is stored as the smallest i64 and comes
first; equal ids keep one record for each row, ordered by a hash of the text; an empty table gives no
record; other columns, whatever their names, are ignored. A task that is retried writes another file: only the
files that the committed index names belong to the output.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, broadcast_if_small, fresh_path, materialize, open_fs, release
from .tokens import encoder

MASK_DELTA = 0xA282EAD8
NULL_ID = -(2**63)
#: Documents for each shard file, about.
DOCS_PER_SHARD = 8192
#: Neighbouring index entries with a gap below this are fetched in one read.
COALESCE_GAP = 1 << 16
COALESCE_MAX = 8 << 20

INDEX = "file string, shard int, doc_id long, ordinal long, offset long, length long, n_tokens long, start long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(buf: bytes, at: int = 0) -> tuple[bytes, int]:
    """(payload, place of the next frame); raises ValueError on damage."""
    head = bytes(buf[at : at + 8])
    if len(head) < 8 or struct.unpack_from("<I", buf, at + 8)[0] != masked_crc(head):
        raise ValueError(f"record at {at}: bad length checksum")
    n = struct.unpack("<Q", head)[0]
    payload = bytes(buf[at + 12 : at + 12 + n])
    if len(payload) < n or struct.unpack_from("<I", buf, at + 12 + n)[0] != masked_crc(payload):
        raise ValueError(f"record at {at}: bad payload checksum")
    return payload, at + 16 + n


def ids_crc32(ids: bytes, width: int) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    import numpy as np

    return zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes())


def write_records(docs: DataFrame, root: str, vocabulary: str, kind: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", docs_per_shard: int = DOCS_PER_SHARD) -> DataFrame:
    """Encode and write all rows of ``docs`` in ascending id order below ``root``; returns the committed index."""
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(1, -(-docs.count() // docs_per_shard))
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    names = [x.split()[0] for x in INDEX.split(", ")]
    types = [pa.string(), pa.int32(), *[pa.int64()] * 6]

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        enc, shard = encoder(vocabulary, kind), TaskContext.get().partitionId()
        end = end_id.to_bytes(enc.width, "little")
        out, name, at, start, ordinal = None, "", 0, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, base = open_fs(root)
                fs.create_dir(f"{base}/data", recursive=True)
                name = f"data/{shard:07d}-{uuid.uuid4().hex}.rec"
                out = fs.open_output_stream(f"{base}/{name}")
            cols: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = enc.encode(text) + end
                data = frame(struct.pack("<Bq", enc.width, NULL_ID if doc_id is None else doc_id) + ids)
                n = len(ids) // enc.width
                for col, v in zip(cols, (name, shard, doc_id, ordinal, at, len(data), n, start), strict=True):
                    col.append(v)
                out.write(data)
                at, start, ordinal = at + len(data), start + n, ordinal + 1
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        if out is not None:
            out.close()
        release()

    path = f"{root}/index"
    rows.drop("_h").mapInArrow(write, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_records(index: DataFrame, root: str, digests: bool = False) -> DataFrame:
    """The records that ``index`` (all or any rows of it) names, by coalesced byte-range reads, checksums verified.

    ``digests`` gives ``ids_crc32`` in place of the ids, so that only numbers leave the task.
    """
    import pyarrow as pa

    ids_type, id_names = ([pa.int64()], ["ids_crc32"]) if digests else ([pa.binary(), pa.int32()], ["ids", "width"])
    names = ["shard", "doc_id", "ordinal", "n_tokens", "start", *id_names]
    schema = pa.schema(list(zip(names, [pa.int32(), *[pa.int64()] * 4, *ids_type], strict=True)))

    def follows(a: dict, b: dict, c: dict) -> bool:
        """c goes into the read that began at a and now ends with b."""
        gap = c["offset"] - b["offset"] - b["length"]
        return c["file"] == a["file"] and 0 <= gap <= COALESCE_GAP and c["offset"] + c["length"] - a["offset"] <= COALESCE_MAX

    def parse(r: dict, buf: bytes, base: int) -> tuple:
        payload, end = unframe(buf, r["offset"] - base)
        width, doc_id = struct.unpack_from("<Bq", payload)
        ids = payload[9:]
        n = len(ids) // width
        if end + base != r["offset"] + r["length"] or n != r["n_tokens"]:
            raise ValueError(f"{r['file']} at {r['offset']}: the index and the record differ")
        last = (ids_crc32(ids, width),) if digests else (ids, width)
        return (r["shard"], None if doc_id == NULL_ID else doc_id, r["ordinal"], n, r["start"], *last)

    def fetch(batches: Iterator) -> Iterator:
        fs, base = open_fs(root)
        open_name, handle = None, None
        for batch in batches:
            rows, k = batch.to_pylist(), 0
            while k < len(rows):
                j = k + 1
                while j < len(rows) and follows(rows[k], rows[j - 1], rows[j]):
                    j += 1
                if rows[k]["file"] != open_name:
                    if handle:
                        handle.close()
                    open_name = rows[k]["file"]
                    handle = fs.open_input_file(f"{base}/{open_name}")
                at, last = rows[k]["offset"], rows[j - 1]
                handle.seek(at)
                buf = handle.read(last["offset"] + last["length"] - at)
                cols = zip(*[parse(r, buf, at) for r in rows[k:j]], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
                k = j
        if handle:
            handle.close()

    tail = "ids_crc32 long" if digests else "ids binary, width int"
    return index.mapInArrow(fetch, f"shard int, doc_id long, ordinal long, n_tokens long, start long, {tail}")


def with_global_start(records: DataFrame, index: DataFrame) -> DataFrame:
    """``start`` counted over all shards. What is ordered in one place is a row for each shard file."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return records.join(broadcast_if_small(totals), "shard").withColumn("start", F.col("start") + F.col("_base")).drop("_base")


def token_records(spark: SparkSession, docs: DataFrame, vocabulary: str, kind: str = "word", end_id: int = 2) -> DataFrame:
    """Write ``docs`` and read every record back: one row per document, with its place in the whole token stream."""
    root = fresh_path(spark, "records")
    index = write_records(docs, root, vocabulary, kind, end_id)
    back = materialize(read_records(index, root, digests=True), "records-back")
    return with_global_start(back, index).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "ordinal")
