import corpus_pipeline as cp
import numpy as np
from tokenizers import Tokenizer

from textmill.llm import decontaminate, minhash, packing, pii, quality

from . import test_decontaminate, test_minhash
from .fixtures import edge_docs, empty_docs


def columns(df):
    return {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()}


def test_run_equals_brute_force_stage_by_stage(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    every = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, quality.grades_of_labels(spark.read.parquet(f"{sf}/labels.parquet")))
    memory = quality.Hashes()
    left = [i for i, r in every.items() if model.tails([quality.buckets_of(r.text, memory)])[0][-1] >= quality.LEAST_P]
    step = cp.STAGES[0][1](spark, docs, sf)
    assert step.schema == docs.schema and columns(step) == columns(docs.where(docs.doc_id.isin(left)))

    rows = [(i, every[i].text) for i in left]
    kept = docs.where(docs.doc_id.isin(left))
    links = test_minhash.brute(kept, rows, minhash.THRESHOLD)
    root = test_minhash.union([i for i, _ in rows], links)
    left = [i for i, _ in rows if root[i] == i]
    step = cp.STAGES[1][1](spark, kept, sf)
    assert step.schema == docs.schema and sorted(r.doc_id for r in step.collect()) == left

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {x[0] for x in test_decontaminate.brute([(i, every[i].text) for i in left], items) if x[5]}
    left = [i for i in left if i not in bad]
    step = cp.STAGES[2][1](spark, step, sf)
    assert step.schema == docs.schema and sorted(r.doc_id for r in step.collect()) == left

    scorer = pii.Scorer()
    want = {i: pii.mask(every[i].text, pii.found_spans([every[i].text], scorer)[0][1]) for i in left}
    step = cp.STAGES[3][1](spark, step, sf)
    assert step.schema == docs.schema and {r.doc_id: r.text for r in step.collect()} == want
    assert all(r.n_chars == len(r.text) for r in step.collect())

    tok = Tokenizer.from_file(cp.registry.vocabulary("byte_bpe_50k.json"))
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    got = cp.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in got) == sorted((i, k, s, n) for i, m in sizes.items() for k, (s, n) in enumerate(packing.cut(m, 2048)))
    fill = np.bincount(np.unique([r.sequence_id for r in got], return_inverse=True)[1], [r.length for r in got])
    assert fill.max() <= 2048 and fill.sum() == sum(sizes.values())


def test_stages_on_edge_cases(spark, sf):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count() or name == "best_fit_packing"
            assert name == "best_fit_packing" or out.schema == docs.schema
    assert decontaminate.clean_documents(edge_docs(spark), spark.createDataFrame([], "item_id long, text string")).count() == edge_docs(spark).count()
