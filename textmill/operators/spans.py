"""Containment joins of spans and places, in DataFrame functions: which spans hold a place, and which is the innermost.

A span goes to one or two bins as wide as the least power of two that is not below its length; a place goes to its bin at each width that
occurs. So both meet by an equal key (file, width, bin): the rows that meet are those a place really shares a neighbourhood with, and one
file's spans are dealt to many keys. A span is [start, end); empty and null ones hold nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths that spans of up to 2 ** 62 units have.
MOST_WIDTHS = 63


def _level(length: Column) -> Column:
    """Least k with 2 ** k >= length (length > 0), without floating point."""
    return F.length(F.regexp_replace(F.bin((length - 1).cast("long")), "^0$", ""))


def _bin(at: Column, level: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), level)


def containing(places: DataFrame, spans: DataFrame, by: str = "path", at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows: columns of ``places``, and those of the spans of the same ``by`` with start <= at < end as the struct ``span``."""
    rows = spans.where((F.col(end) > F.col(start)) & F.col(by).isNotNull()).select(F.col(by).alias("_by"), F.struct(*spans.columns).alias("span"))
    rows = rows.withColumn("_level", _level(F.col(f"span.{end}") - F.col(f"span.{start}")))
    edges = F.array_distinct(F.array(_bin(F.col(f"span.{start}"), F.col("_level")), _bin(F.col(f"span.{end}") - 1, F.col("_level"))))
    rows = rows.withColumn("_bin", F.explode(edges))
    levels = [r[0] for r in rows.select("_level").distinct().collect()]  # MOST_WIDTHS at most
    asked = places.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>")))
    asked = asked.withColumn("_bin", _bin(F.col(at), F.col("_level")))
    rows = rows.hint("merge")  # all spans: what the planner takes for small may be large once it is spread out
    met = asked.join(rows, (asked[by] == rows["_by"]) & (asked["_level"] == rows["_level"]) & (asked["_bin"] == rows["_bin"]))
    met = met.where((F.col(f"span.{start}") <= F.col(at)) & (F.col(at) < F.col(f"span.{end}")))
    return met.select(*[asked[c] for c in places.columns], "span")


def innermost(places: DataFrame, spans: DataFrame, key: list[str], by: str = "path", at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """``places`` (``key`` tells one from another), each with the innermost span that holds it as the struct ``span``, null if none does: the
    one with the greatest start, then the least end; of equal ones the least row."""
    met = containing(places, spans, by, at, start, end)
    order = F.struct((-F.col(f"span.{start}")).alias("s"), F.col(f"span.{end}").alias("e"), "span")
    best = met.groupBy(*key).agg(F.min(order).alias("_best")).select(*key, F.col("_best.span").alias("span"))
    return places.join(best.hint("merge"), key, "left")  # as many rows as places: never sent through the driver
