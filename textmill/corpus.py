"""A corpus: any frame of (path, text). Adapters make one of a table; `lines` and `files` are its views."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import lexical

#: Text and binary limits of the line search: a NUL this early makes a file binary, a larger file is skipped.
BINARY_PROBE = 8192
SEARCH_BYTES = 16 << 20


def from_documents(docs: DataFrame) -> DataFrame:
    """documents -> (path = source/lang/doc_id, text)."""
    return docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")


def split_lines(text: Column | str = "text") -> Column:
    """Every element between line feeds: the count is the number of line feeds plus one."""
    return F.split(F.col(text) if isinstance(text, str) else text, "\n", -1)


def slice_lines(text: Column | str = "text") -> Column:
    """Lines of the slice model: a final line feed adds no line; the empty text has one line."""
    parts = split_lines(text)
    return F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def search_lines(text: Column | str = "text") -> Column:
    """Lines that a search sees: the slice model, but none in an empty text; carriage returns at line ends are not shown."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t == "", F.array().cast("array<string>")).otherwise(slice_lines(t))


def lines(corpus: DataFrame, model: Column | None = None) -> DataFrame:
    """(path, line_number from 1, text), one row per line; only path and text are read."""
    parts = search_lines() if model is None else model
    return corpus.select("path", F.posexplode(parts).alias("pos", "text")).select("path", (F.col("pos") + 1).cast("long").alias("line_number"), "text")


def is_binary(content: str = "content") -> Column:
    return F.contains(F.substring(F.col(content), 1, BINARY_PROBE), F.lit(b"\x00"))


def lossy_text(content: str = "content") -> Column:
    """UTF-8 with replacement characters for bad bytes."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def with_text(files: DataFrame) -> DataFrame:
    """Adds text, is_binary and valid_utf8 to files with ``content``."""
    return files.withColumns({"text": lossy_text(), "is_binary": is_binary(), "valid_utf8": F.is_valid_utf8(F.col("content").cast("string"))})


def explicit(spark, paths: list[str]) -> DataFrame:
    """A view (path) of a caller's list: lexical paths inside the root, sorted, each once."""
    return spark.createDataFrame([(p,) for p in sorted({lexical(p) for p in paths})], "path string")


def hash_hex(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``hash_hex``: xxh3-64 of the bytes, 16 lower-case hex digits (no native function computes it)."""
    @F.pandas_udf("string")
    def xxh3(data: pd.Series) -> pd.Series:
        import xxhash

        return data.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(bytes(b)))

    return files.withColumn("hash_hex", xxh3(F.col(content)))


def node_id(path: str = "path", hash_col: str = "hash_hex") -> Column:
    """path@hash; an unknown hash is 16 zeros. Split it at the last @."""
    return F.concat(path, F.lit("@"), F.coalesce(F.col(hash_col), F.lit("0" * 16)))
