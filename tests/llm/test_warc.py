import zlib

import pytest

from textmill.llm import warc
from textmill.llm.common import fresh_path

SCHEMA = "page_id long, url string, html string, digest string, file string, offset long"


def brute(rows):
    first = {}
    for page_id, _, html in rows:
        h = html or ""
        if page_id is not None and (h not in first or page_id < first[h]):
            first[h] = page_id
    out = []
    for page_id, url, html in rows:
        b = (html or "").encode()
        f = first.get(html or "")
        revisit = f is not None and page_id != f
        out.append((page_id, len(b), warc.payload_digest(b), "revisit" if revisit else "response", f if revisit else None, url))
    return out


EDGE = [(3, "http://a/", "<p>x</p>"), (1, "http://b/", "<p>x</p>"), (None, None, "<p>x</p>"), (4, None, None), (5, "u", ""), (6, "http://c/\r\nX: y", "é" * 100_000), (6, "http://c/\r\nX: y", "é" * 100_000), (7, "u", "a\r\n\r\nWARC/1.1\r\n"), (None, "n", "only null ids")]


def key(x):
    return tuple((v is not None, v) for v in x)


@pytest.mark.parametrize("small", [True, False])
def test_edge_cases(spark, small, monkeypatch):
    if not small:
        monkeypatch.setattr(warc, "fits_broadcast", lambda df: False)
    pages = spark.createDataFrame([(*r, "x", "y", 1) for r in EDGE], SCHEMA)
    got = sorted((tuple(r) for r in warc.archived(spark, pages).collect()), key=key)
    fix = [(a, b, c, d, e, u and u.replace("\r\n", "%0D%0A")) for a, b, c, d, e, u in brute(EDGE)]
    assert got == sorted(fix, key=key)
    assert warc.archived(spark, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_hot_payload_and_selection(spark, sf, small, monkeypatch):
    if not small:
        monkeypatch.setattr(warc, "fits_broadcast", lambda df: False)
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "'same' as html"))
    root = fresh_path(spark, "warc")
    index = warc.write_archive(pages, root)
    rows = [tuple(r) for r in pages.collect()]
    want = {x[0]: x for x in brute(rows)}
    picked = index.where("page_id % 3 = 1").orderBy("url")
    got = [tuple(r) for r in warc.read_archive(picked, root).collect()]
    assert sorted(got) == sorted(x for k, x in want.items() if k % 3 == 1) and got
    texts = {r.page_id: r.payload for r in warc.read_archive(index, root, payloads=True).collect()}
    assert all(texts[k] == h.encode() for k, _, h in rows if want[k][3] == "response")


def test_damage_is_found():
    raw = warc.make_record(1, "http://a/", b"payload", warc.payload_digest(b"payload"), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(raw)["payload"] == b"payload"
    for bad in (raw[:-1], raw.replace(b"payload\r\n", b"paxload\r\n"), b"x" + raw):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
    with pytest.raises(zlib.error):
        zlib.decompress(b"nothing", 31)
