import numpy as np

from textmill.llm import langid

from .fixtures import edge_docs, empty_docs

EN = "the house of the king is on the hill and there was a river with a bridge that we would cross every morning"
DE = "das haus des königs ist auf dem hügel und dort war ein fluss mit einer brücke die wir jeden morgen überquerten"
FR = "la maison du roi est sur la colline et il y avait une rivière avec un pont que nous traversions chaque matin"


def train_docs(spark):
    rows = [(k * 3 + j, t, lang) for k in range(6) for j, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_mixture_and_selection(spark):
    langs, logp = langid.learn(train_docs(spark))
    m = langid.Inference(langs, logp)
    theta, some = m.proportions([EN, f"{EN} {EN} {DE}", "123 ½ --", None, "", f"{EN} {DE} {FR}", "House"])
    t = [dict(zip(langs, x, strict=True)) for x in theta.tolist()]
    assert t[0]["en"] == 1 and t[0]["de"] == 0
    assert 0.5 < t[1]["en"] < 0.8 and t[1]["de"] > 0.2 and t[1]["fr"] == 0
    assert some.tolist() == [True, True, False, False, False, True, True]
    assert all(v > 0.15 for v in t[5].values())


def plain_em(p, n, rounds):
    """One document, by the textbook."""
    k = len(p[0])
    theta = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for row, c in zip(p, n, strict=True):
            s = sum(a * b for a, b in zip(row, theta, strict=True))
            for j in range(k):
                new[j] += c * row[j] * theta[j] / s
        theta = [x / sum(n) for x in new]
    return theta


def test_rounds_equal_plain_em(spark):
    r = np.random.default_rng(1)
    p, n = r.random((40, 3)) + 0.01, r.integers(1, 5, 40).astype(float)
    doc = np.repeat([0, 1], [15, 25])
    begin = np.array([0, 15])
    got, _ = langid.Inference._em(p, n, doc, begin, np.add.reduceat(n, begin), np.full((2, 3), 1 / 3), 5)
    for d in range(2):
        assert np.allclose(got[d], plain_em(p[doc == d].tolist(), n[doc == d].tolist(), 5))


def test_defined_cases(spark):
    langs, logp = langid.learn(train_docs(spark))
    rows = langid.predicted(edge_docs(spark), langs, logp).collect()
    docs = edge_docs(spark).collect()
    for r, d in zip(rows, docs, strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, d.text or ""))) and 0 <= r.score <= 1
    nothing = langid.learn(edge_docs(spark).selectExpr("text", "cast(null as string) lang"))
    assert {r.lang_pred for r in langid.predicted(edge_docs(spark), *nothing).collect()} == {"und"}
    assert langid.languages(empty_docs(spark)).count() == 0
    assert langid.predicted(empty_docs(spark), langs, logp).count() == 0


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.languages(docs)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    held = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert held.where("lang = lang_pred").count() / held.count() > 0.97
    assert sum(r.held_out for r in got.collect()) == docs.where("crc32(cast(doc_id as string)) % 4 = 2").count()


def test_small_share_of_a_long_document_is_selected():
    """1.5 % of 10,000 words in a third language, without a neighbour that holds more of one."""
    p = np.full((10_000, 4), 1e-6)
    p[np.arange(10_000), np.repeat([0, 1, 2], [7000, 2850, 150])] = 1e-3
    model = langid.Inference(["a", "b", "c", "d"], np.zeros((langid.BUCKETS, 4)))
    theta = model._select(p, np.ones(10_000), np.zeros(10_000, int), np.array([0]), np.array([10_000.0]))
    assert (theta[0] > 0).tolist() == [True, True, True, False] and abs(theta[0, 2] - 0.015) < 0.003


def plain_choice(p, n):
    """The language set of one document, by the textbook: sets in the order of the proportions, penalised likelihood."""
    k, words = len(p[0]), sum(n)
    full = plain_em(p, n, langid.ROUNDS)
    order = sorted(range(k), key=lambda j: -full[j])
    best, out = -np.inf, None
    for size in range(1, k + 1):
        own = order[:size]
        start = [max(full[j], 1e-6) for j in own]
        theta = [x / sum(start) for x in start]
        for _ in range(1 if size == 1 else 4):
            s = [max(sum(row[j] * t for j, t in zip(own, theta, strict=True)), 1e-300) for row in p]
            theta = [sum(c * row[j] * t / x for row, c, x in zip(p, n, s, strict=True)) / words for j, t in zip(own, theta, strict=True)]
        score = sum(c * np.log(x) for c, x in zip(n, s, strict=True)) - langid.PENALTY * (size - 1) * np.log(words + 1)
        if score > best + 1e-9:
            best, out = score, {j: t for j, t in zip(own, theta, strict=True)}
    return [out.get(j, 0.0) for j in range(k)]


def test_whole_query_against_plain_python(spark, sf):
    """Every document's prediction, score and set: bags of words, trigram likelihoods, rounds and penalty one document at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, logp = langid.learn(docs.where(~langid.held_out()))
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    memo: dict = {}

    def relative(w):
        if w not in memo:
            grams = [f"\x02{w}\x03"[k : k + 3] for k in range(len(w))]
            ll = sum(logp[langid.zlib.crc32(g.encode()) % langid.BUCKETS].astype(float) for g in grams)
            memo[w] = np.exp(np.maximum(ll - ll.max(), -60)).tolist()
        return memo[w]

    for r in docs.collect()[:120]:
        bag = langid.Counter(w for w in langid._WORD.findall((r.text or "").lower()) if any(map(str.isalpha, w)))
        if not bag:
            assert got[r.doc_id].lang_pred == "und"
            continue
        theta = plain_choice([relative(w) for w in bag], list(bag.values()))
        best = max(range(len(langs)), key=lambda j: (theta[j], -j))
        assert got[r.doc_id].lang_pred == langs[best] and abs(got[r.doc_id].score - theta[best]) < 1e-6
        assert {x.partition(":")[0] for x in got[r.doc_id].langs.split(",")} == {langs[j] for j, t in enumerate(theta) if t > 0}


def test_sample_is_of_different_texts(spark):
    rows = [(k, EN + " again", "en") for k in range(3000)] + [(10_000 + k, f"{DE} {k}", "de") for k in range(50)] + [(20_000 + k, f"{EN} {k}", "en") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logp = langid.learn(docs, docs_per_language=20)
    assert langs == ["de", "en"] and {r.lang_pred for r in langid.predicted(docs.where("lang = 'en'"), langs, logp).collect()} == {"en"}
    whole = langid.learn(docs, docs_per_language=1000)[1]
    assert np.array_equal(whole, langid.learn(docs.distinct().dropDuplicates(["text"]), docs_per_language=1000)[1])
