"""The queries of this subpackage over the standard tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def vocabulary(name: str) -> str:
    """Where the public vocabulary files are; a parameter of the operators, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import graded, grades_of_labels, train

    docs = table(spark, sf_dir, "documents")
    return graded(docs, train(docs, grades_of_labels(table(spark, sf_dir, "labels"))), keep=["doc_id"])


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), "word", end_id=2)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), "byte", end_id=0)


def op5_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"))


def op8_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .chat import as_calls, linked

    return linked(as_calls(table(spark, sf_dir, "conversations"))).withColumn("errors", F.array_join("errors", "; "))


def op9_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(spark, table(spark, sf_dir, "pages"))


def op10_pii_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op11_token_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefixes import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2048)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import run_report

    return run_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import chat, decontaminate, divergence, embeddings, warc

    return {"op12_source_divergence": divergence.ORACLE, "op5_positional_decontamination": decontaminate.ORACLE, "op6_inverted_multi_index": embeddings.ORACLE, "op8_tool_call_linking": chat.ORACLE, "op9_warc_index_first": warc.ORACLE}
