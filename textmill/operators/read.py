"""Windows of lines over files, in two line models (see `corpus`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..corpus import slice_lines, split_lines
from ..errors import invalid


def _model(line_mode: str) -> Column:
    if line_mode not in ("slice", "splitLines"):
        raise invalid(f"unknown line mode {line_mode!r}")
    return slice_lines() if line_mode == "slice" else split_lines()


def summary(corpus: DataFrame, line_mode: str = "slice") -> DataFrame:
    """(path, total_lines, byte_len, ends_with_newline)."""
    return corpus.select("path", F.size(_model(line_mode)).cast("long").alias("total_lines"), F.octet_length("text").cast("long").alias("byte_len"), F.endswith("text", F.lit("\n")).alias("ends_with_newline"))


def read(corpus: DataFrame, offset: int | None = None, limit: int | None = None, line_numbers: bool = False, line_mode: str = "slice", strict: bool = False) -> DataFrame:
    """(path, content, total_lines, returned_lines, byte_len, truncated, past_end) of the window from the 1-based ``offset``
    (0 and none are 1) over ``limit`` lines (0 and none: to the end). An offset past the end gives a null content and
    past_end; ``strict`` makes that an error. A slice window keeps its last line's newline, a splitLines window never
    ends with one."""
    start, n = max(1, offset or 1), limit or 0
    flag = [F.col("is_binary")] if "is_binary" in corpus.columns else []
    rows = corpus.select("path", "text", _model(line_mode).alias("ls"), *flag).withColumn("total", F.size("ls"))
    count = F.greatest(F.least(F.lit(n) if n else F.col("total"), F.col("total") - (start - 1)), F.lit(0))
    rows = rows.withColumn("k", count).withColumn("w", F.slice("ls", F.lit(start), F.col("k"))).withColumn("end", F.lit(start - 1) + F.col("k"))
    closes = (F.col("end") < F.col("total")) | F.endswith("text", F.lit("\n")) if line_mode == "slice" else F.lit(False)
    shown = F.transform("w", lambda x, i: F.format_string("%6d\t%s", i + start, x)) if line_numbers else F.col("w")
    content = F.concat(F.array_join(shown, "\n"), F.when(closes & (F.col("k") > 0), "\n").otherwise(""))
    past = F.col("total") < start
    if strict:
        past = F.when(past, F.raise_error(F.concat(F.lit("offset past the end of "), "path")).cast("boolean")).otherwise(False)
    out = rows.select("path", F.when(F.col("total") >= start, content).alias("content"), F.col("total").cast("long").alias("total_lines"), F.col("k").cast("long").alias("returned_lines"), F.octet_length("text").cast("long").alias("byte_len"), ((F.lit(start) > 1) | (F.col("end") < F.col("total"))).alias("truncated"), past.alias("past_end"), *flag)
    return out.withColumn("content", F.when(F.col("is_binary"), "").otherwise(F.col("content"))) if flag else out


def numbered_lines(corpus: DataFrame) -> DataFrame:
    """(path, line_number, numbered): right-aligned number, tab, text; wider numbers widen the column."""
    from ..corpus import lines

    return lines(corpus, slice_lines()).select("path", "line_number", F.format_string("%6d\t%s", "line_number", "text").alias("numbered"))


def line_starts(corpus: DataFrame) -> DataFrame:
    """(path, line_number, start_byte, end_byte): end excludes the line feed."""
    sizes = F.transform(slice_lines(), lambda x: F.octet_length(x).cast("long"))
    step = lambda a, n: F.struct((a["at"] + n + 1).alias("at"), F.array_append(a["out"], F.struct(a["at"].alias("start_byte"), (a["at"] + n).alias("end_byte"))).alias("out"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start_byte:long,end_byte:long>>").alias("out"))
    spans = F.aggregate(sizes, zero, step, lambda a: a["out"])
    return corpus.select("path", F.posexplode(spans).alias("i", "s")).select("path", (F.col("i") + 1).cast("long").alias("line_number"), "s.start_byte", "s.end_byte")


def line_col(text: Column | str, offset: Column | str) -> Column:
    """struct(line, col), both from 1, of a byte offset: col counts bytes."""
    head = F.substring((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(1), F.col(offset) if isinstance(offset, str) else offset).cast("string")
    parts = F.split(head, "\n", -1)
    return F.struct(F.size(parts).cast("long").alias("line"), (F.octet_length(F.element_at(parts, -1)) + 1).cast("long").alias("col"))
