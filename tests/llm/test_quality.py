import random

import numpy as np

from textmill.llm import quality as q

from .fixtures import edge_docs, empty_docs


def words(r, n):
    return " ".join("".join(r.choice(["an", "er", "in", "th", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t, g = words(r, r.randint(20, 200)), 2
        if k % 4 == 0:
            t, g = " ".join(x + r.choice(["***", "$$$"]) for x in t.split()), 0
        elif k % 4 == 1:
            w = t.split()
            for _ in range(8):
                w[r.randrange(len(w))] = "nastyword"
            t, g = " ".join(w), 1
        out.append((k, t, g))
    return out


def rated(spark, rows):
    return spark.createDataFrame([(i, g, "x") for i, _, g in rows], "doc_id long, grade int, text string")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 0.1, 5) for i, t, _ in rows], "doc_id long, text string, p_tail double, grade int")


def test_held_out_accuracy_and_order(spark):
    rows = labelled(1200, 1)
    model = q.train(docs_of(spark, rows), rated(spark, rows[:800]))
    assert model.grades == [0, 1, 2] and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in q.graded(docs_of(spark, rows), model, keep=["doc_id"]).collect()}
    held = rows[800:]
    assert np.mean([got[i].grade == g for i, _, g in held]) > 0.98
    assert np.mean([got[i].selected == (g == 2) for i, _, g in held]) > 0.98
    for i, t, _ in rows[:20]:
        tails = model.tails([q.buckets_of(t, q.Hashes())])[0]
        assert np.all(np.diff(tails) <= 0) and abs(got[i].expected_grade - tails.sum()) < 1e-9 and got[i].p_tail == tails[-1]


def test_gradient_reaches_the_maximum(spark):
    rows = labelled(300, 2)
    x = [q.buckets_of(t, q.Hashes()) for _, t, _ in rows]
    y = [g for *_, g in rows]

    def loss(m):
        t = m.tails(x)
        full = np.concatenate([np.ones((len(t), 1)), t, np.zeros((len(t), 1))], axis=1)
        return -np.log(full[range(len(y)), y] - full[range(len(y)), np.array(y) + 1] + 1e-12).mean()

    assert loss(q.fit(x, y, 300)) < 0.3 * loss(q.fit(x, y, 1))


def test_marks_of_a_frequent_junk_source_count():
    r = random.Random(5)
    rows = []
    for k in range(900):  # a third is junk that differs by nothing but its bars
        t = words(r, 80).split()
        rows.append((" | ".join(t) + " |" if k % 3 == 0 else " ".join(t + words(r, 80).split()), 0 if k % 3 == 0 else 3))
    x, y = [q.buckets_of(t, q.Hashes()) for t, _ in rows], [g for _, g in rows]
    model = q.fit(x[:600], y[:600])
    assert model.weights[q._hash("t |")] < 0 and model.weights[q._hash("s bars 9")] < 0
    assert np.mean((model.tails(x[600:])[:, -1] >= q.LEAST_P) == (np.array(y[600:]) == 3)) > 0.99


def test_defined_cases(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert all(r.selected and r.p_tail == 1 for r in q.graded(docs, q.train(docs, none)).collect())
    odd = spark.createDataFrame([(1, 3), (1, 0), (None, 2), (2, None), (3, 3), (4, 1), (999, 2)], "doc_id long, grade int")
    model = q.train(docs, odd)
    assert model.grades == [0, 1, 3]
    got = q.graded(docs, model, keep=["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.p_tail <= 1 and 0 <= r.expected_grade <= 3 for r in got)
    one = q.train(docs, spark.createDataFrame([(1, 2)], "doc_id long, grade int"))
    assert {r.grade for r in q.graded(docs, one).select("doc_id", "n_chars", "grade").collect()} == {2} if "grade" not in docs.columns else True
    assert q.graded(empty_docs(spark), model, keep=["doc_id"]).count() == 0
    kept = q.selected_documents(docs, odd)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert q.selected_documents(docs, none).count() == docs.count()


def test_sample_bound_is_kept(spark):
    rows = labelled(200, 3)
    twice = rated(spark, rows).unionByName(rated(spark, rows))
    a, b = (q.train(docs_of(spark, rows), f, max_train=50) for f in (twice, rated(spark, rows)))
    assert np.array_equal(a.weights, b.weights)


def test_labels_to_grades(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 1, 1), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.grade for r in q.grades_of_labels(labels).orderBy("doc_id").collect()] == [0, 1, 2, 3, None]


def test_whole_query_against_plain_python(spark, sf):
    """Every row of the query: features, sums of weights and sigmoids one document at a time."""
    from textmill.llm import registry

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in registry.op1_ordinal_quality(spark, sf).collect()}
    model = q.train(docs, q.grades_of_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    assert len(got) == docs.count()
    for r in docs.collect():
        z = sum(float(model.weights[b]) for b in q.buckets_of(r.text or "", q.Hashes()).tolist())
        tails = [1.0, *[1 / (1 + np.exp(-(z - t))) for t in model.thresholds], 0.0]
        prob = [a - b for a, b in zip(tails, tails[1:], strict=False)]
        assert got[r.doc_id].grade == model.grades[int(np.argmax(prob))] and abs(got[r.doc_id].p_tail - tails[-2]) < 1e-4
        assert abs(got[r.doc_id].expected_grade - sum(p * g for p, g in zip(prob, model.grades, strict=True))) < 1e-4
        assert got[r.doc_id].selected == (got[r.doc_id].p_tail >= q.LEAST_P)


def test_fit_against_plain_descent():
    """The penalised loss of the fit against plain proximal steps from many more rounds, on a small dense problem."""
    r = np.random.default_rng(4)
    rows = [np.array(sorted(r.choice(30, r.integers(3, 9), replace=False)), np.int32) for _ in range(400)]
    grade = [int(np.clip(sum(b < 6 for b in x) + r.integers(-1, 2), 0, 2)) for x in rows]
    x = np.zeros((400, 30))
    for k, b in enumerate(rows):
        x[k, b] = 1
    y, mean = np.array(grade), x.mean(0)
    scale = 1 / np.sqrt(mean * (1 - mean))
    z = (x - mean) * scale
    penalty = q.PENALTY / 20

    def loss(v, t):
        tail = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(-(z @ v)[:, None] + t[None, :])), np.zeros((400, 1))], axis=1)
        return -np.log(tail[range(400), y] - tail[range(400), y + 1]).mean() + penalty * np.abs(v).sum()

    model = q.fit(rows, grade)
    v, t = model.weights[:30] / scale, model.thresholds - float(model.weights[:30] @ mean)
    best, step = loss(v, t), 1e-4
    for k in range(32):  # no small move of any weight or threshold betters it
        for sign in (-1, 1):
            dv, dt = v.copy(), t.copy()
            if k < 30:
                dv[k] += sign * step
            else:
                dt[k - 30] += sign * step
            assert loss(dv, dt) > best - 1e-6


def test_columns_named_like_the_result_give_way(spark):
    docs = spark.createDataFrame([(1, "good text", "a", 5.0)], "doc_id long, text string, grade string, p_tail double")
    model = q.Ordinal([], np.zeros(q.BUCKETS, np.float32), np.zeros(0))
    for keep in (None, ["doc_id", "grade"]):
        out = q.graded(docs, model, keep=keep)
        assert len(set(out.columns)) == len(out.columns) and out.select("grade", "p_tail").first().grade == 0
