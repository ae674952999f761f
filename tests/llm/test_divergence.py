import re
from collections import Counter, defaultdict

import duckdb
import pytest

from textmill.llm import divergence as dv

from .fixtures import edge_docs, empty_docs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, most=200):
    """The stated sums, term by term, in Python's integers. rows: (lang, source, text)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        groups[lang].add(source)
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        share = lambda c, total: 1 + 10**9 * (c + 1) // (total + len(kept))  # noqa: B023, E731
        p = {s: {t: share(count[lang, s][t], n[s]) for t in kept} for s in sources}
        whole = {t: share(sum(count[lang, s][t] for s in sources), sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], whole[t]), t) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= most]
    return sorted(out)


def got(docs, **k):
    return sorted(map(tuple, dv.divergence(docs, **k).collect()))


@pytest.fixture(params=[dv.HELD_ROWS, 100])
def held(request, monkeypatch):
    """Counts that leave a reading task at its end, or batch by batch."""
    monkeypatch.setattr(dv, "HELD_ROWS", request.param)
    return request.param


def test_documents_equal_brute_force_and_sql(spark, sf, held):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = got(docs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    assert rows == brute([tuple(r) for r in docs.select("lang", "source", "text").collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert rows == sorted(con.execute(dv.ORACLE).fetchall())


def test_edge_cases(spark):
    extra = [(20 + k, "Zebra zebra Žluť, zebra_\x00ÄB äb x1y", lang, s) for k in range(4) for lang in ("en", None, "cz") for s in ("a", "b", None, f"s{k}")]
    docs = edge_docs(spark, [*extra, (90, "rare only", "one", "x"), (91, "", "none", "x"), (92, None, "none", "y")])
    rows = got(docs)
    assert rows == brute([tuple(r) for r in docs.select("lang", "source", "text").collect()])
    assert {r[0] for r in rows if r[2] == "pair" and r[4] == 0} >= {"none"}
    assert got(docs, least_docs=1, most_terms=3) == brute([tuple(r) for r in docs.select("lang", "source", "text").collect()], 1, 3)
    assert got(empty_docs(spark)) == []


def test_counts_beyond_a_long_are_exact(spark):
    n = 4 * 10**18
    df = spark.createDataFrame([(n, n, 7), (0, 0, 0), (0, 5, 2)], "c long, n long, v long")
    F = dv.F
    assert [r[0] for r in df.select(dv._share(F.col("c"), F.col("n"), F.col("v"))).collect()] == [1 + 10**9 * (n + 1) // (n + 7), 1, 1 + 10**9 // 7]
