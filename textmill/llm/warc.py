"""WARC archives, index first: one gzip member per record, an index row (file, offset, length, url, digest, ...) per
record, and reads that go from the index to coalesced byte ranges of the selected records.

Records with equal payloads: the row with the smallest page_id is the `response`, the others are `revisit` records
that hold the headers only and refer to it. What is shuffled for that are digests and ids. The revisits are then looked up by the
pages from a broadcast; where they are too many for one, pages move once, dealt by (id, digest, url), never by a shared digest
alone, so that a page that a third of all rows repeat is no hot key.

Defined cases: a null page is the empty payload; a null url leaves out the target header; a null id never is the
smallest and leaves out the id header (a group of null ids only: all are responses); equal rows with
the smallest id of their group are all responses; an empty table gives no record; other columns are ignored. Files of failed
tasks stay unreferenced: only the committed index names a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fits_broadcast
from .common import bounded_batches, fresh_path, materialize, open_fs, release

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Neighbouring records with a gap below this are fetched in one read of at most COALESCE_MAX bytes.
COALESCE_GAP, COALESCE_MAX = 1 << 16, 8 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. ``refers_to`` makes it a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest} {refers_to}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), http headers and payload of one record; raises ValueError on damage."""
    if not raw.startswith(b"WARC/1.1\r\n"):
        raise ValueError("no WARC record here")
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    n = int(fields["content-length"])
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n" or f"sha1:{payload_digest(block)}" != fields["warc-block-digest"]:
        raise ValueError("damaged WARC block")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["warc-type"] == "response" and (len(payload) != full or f"sha1:{payload_digest(payload)}" != fields["warc-payload-digest"]):
        raise ValueError("damaged WARC payload")
    return {"fields": fields, "payload": payload, "full": full}


#: Tasks that the ids of pages with one payload are dealt to.
SALT = 32


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in schema.split(", "))])


def _with_first(rows: DataFrame, same: DataFrame) -> DataFrame:
    """``rows`` with the ``first`` id of their payload's group, without a broadcast: each revisit's (id, digest, url) carries it."""
    ident = lambda: F.xxhash64(F.col("page_id"), F.col("page_id").isNull(), F.col("sum"), F.col("url"))
    salted = same.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))  # equal payloads are dealt by a salt too
    tags = rows.where("sum is not null").select("page_id", "sum", ident().alias("ident")).distinct().withColumn("salt", F.pmod("ident", F.lit(SALT)).cast("int"))
    tags = tags.join(salted.hint("merge"), ["sum", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    tags = materialize(tags.select("ident", F.col("page_id").alias("_id"), F.col("sum").alias("_sum"), "first").distinct(), "revisits")
    tagged = rows.withColumn("ident", ident())
    return tagged.join(tags.hint("merge"), (tagged["ident"] == tags["ident"]) & tagged["page_id"].eqNullSafe(tags["_id"]) & (tagged["sum"] == tags["_sum"]), "left").drop("ident", "_id", "_sum")


def write_archive(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below ``root``; returns the committed index."""
    import pyarrow as pa

    spark = pages.sparkSession
    bounded_batches(spark)
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sum", F.when(F.length("html") >= min_bytes, F.sha1("html")))
    sums = rows.where("sum is not null").select("page_id", "sum")
    same = materialize(sums.groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sum", "first"), "same-payload")
    if fits_broadcast(same):
        rows = rows.join(F.broadcast(same), "sum", "left")
    else:
        rows = _with_first(rows, same)
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    schema = _arrow(INDEX)

    def write(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        out, name, at = None, "", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, base = open_fs(root)
                fs.create_dir(f"{base}/data", recursive=True)
                name = f"data/{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            index = []
            for page_id, url, payload, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                digest = payload_digest(payload)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = gz.compress(make_record(page_id, url, payload, digest, refers_to, date)) + gz.flush()
                out.write(data)
                index.append((name, at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(data)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*index, strict=True), schema.types, strict=True)], schema=schema)
        if out is not None:
            out.close()
        release()

    path = f"{root}/index"
    rows.mapInArrow(write, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def read_archive(index: DataFrame, root: str, payloads: bool = False) -> DataFrame:
    """The records that ``index`` (all or any of its rows) names. Index rows are sorted by place first, so that a
    selection in any order becomes a few large reads. ``payloads`` adds the payload (null for revisits)."""
    import pyarrow as pa

    spec = RESULT + ", payload binary" * payloads
    schema = _arrow(spec)

    def row(raw: bytes, r: dict) -> tuple:
        rec = parse_record(zlib.decompress(raw, 31))
        f = rec["fields"]
        digest = f["warc-payload-digest"].removeprefix("sha1:")
        if digest != r["digest"]:
            raise ValueError(f"{r['file']} at {r['offset']}: the index and the record differ")
        number = lambda k: int(f[k]) if k in f else None
        last = (rec["payload"] if f["warc-type"] == "response" else None,) * payloads
        return (number("warc-page-id"), rec["full"], digest, f["warc-type"], number("warc-refers-to-page-id"), f.get("warc-target-uri"), *last)

    def follows(a: dict, b: dict, c: dict) -> bool:
        gap = c["offset"] - b["offset"] - b["length"]
        return c["file"] == a["file"] and 0 <= gap <= COALESCE_GAP and c["offset"] + c["length"] - a["offset"] <= COALESCE_MAX

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
                cols = zip(*[row(buf[r["offset"] - at : r["offset"] - at + r["length"]], r) for r in rows[k:j]], strict=True)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)
                k = j
        if handle:
            handle.close()

    places = index.select("file", "offset", "length", "digest").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return places.mapInArrow(fetch, spec)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all rows, read every record back."""
    root = fresh_path(spark, "warc")
    index = write_archive(pages, root)
    return read_archive(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(s, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url
FROM p JOIN f USING (s)
"""
