"""Edits over a corpus (path, text). Single edits are native expressions; batches of edits go through Arrow, one row per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import pieces
from ..errors import invalid


def edit(corpus: DataFrame, old: str, new: str, replace_all: bool = False) -> DataFrame:
    """(path, status, replacements, byte_len, text): the target must occur once unless ``replace_all``. status is ok, noMatch
    or multipleMatches; only ok changes the text."""
    if not old or old == new:
        raise invalid("the target must not be empty, nor equal to its replacement")
    n = ((F.octet_length("text") - F.octet_length(F.replace("text", F.lit(old), F.lit("")))) / len(old.encode())).cast("long")
    rows = corpus.select("path", "text").withColumn("n", n)
    status = F.when(F.col("n") == 0, "noMatch").when((F.col("n") > 1) & F.lit(not replace_all), "multipleMatches").otherwise("ok")
    rows = rows.withColumn("status", status)
    text = F.when(F.col("status") == "ok", F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text"))
    return rows.select("path", "status", F.when(F.col("status") == "ok", F.col("n")).otherwise(0).alias("replacements"), F.octet_length(text).cast("long").alias("byte_len"), text.alias("text"))


BATCH = "path string, content string, error_kind string, error_message string, edit_index int, replacements int, normalized boolean, first_changed_line int, old_lines int, new_lines int, hunks array<array<struct<op:string,old_line:int,new_line:int,text:string>>>"


def edit_batch(corpus: DataFrame, edits: DataFrame, diff_context: int = 4, skip_diff: bool = False, whitespace_exact: bool = False, content: bool = True, original: bool = False, most_bytes: int | None = None) -> DataFrame:
    """One row per file that has edits (path, edit_index, old_text, new_text): the new content, or the error of the first edit
    that fails, in which case nothing of the file changes. A file's edits meet in its row; files never meet. Contents are left out
    without ``content``, the old ones come as ``original`` if asked for; both count towards the ``most_bytes`` of a file's result
    (`rewrite.MOST_RESULT`). A file beyond a bound of `rewrite` is an invalidInput row."""
    import pyarrow as pa

    lists = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("edit_index", "old_text", "new_text"))).alias("edits"))
    rows = corpus.select("path", "text").join(lists, "path")
    row = pa.struct([("op", pa.string()), ("old_line", pa.int32()), ("new_line", pa.int32()), ("text", pa.string())])
    schema = BATCH + (", original string" if original else "")
    types = [*[pa.string()] * 4, pa.int32(), pa.int32(), pa.bool_(), *[pa.int32()] * 3, pa.list_(pa.list_(row)), *[pa.string()] * original]
    names = [x.split()[0] for x in schema.split(", ")]

    def one(path: str, text: str, todo: list[dict]) -> tuple:
        from ..errors import CorpusError
        from ..functions import rewrite

        try:
            got = rewrite.apply_edits(text, [(e["old_text"], e["new_text"]) for e in todo], whitespace_exact)
            rewrite.check_result(text, got.content, original, content, not skip_diff, most_bytes or rewrite.MOST_RESULT)
        except CorpusError as e:
            return (path, None, e.kind, str(e), e.edit_index, 0, None, None, text.count("\n") + 1, None, None, *[None] * original)
        groups = None if skip_diff else [[{"op": o, "old_line": a, "new_line": b, "text": t} for o, a, b, t in h] for h in rewrite.hunks(text, got.content, diff_context)]
        return (path, got.content if content else None, None, None, None, got.replacements, got.normalized, rewrite.first_changed_line(text, got.content), text.count("\n") + 1, got.content.count("\n") + 1, groups, *[text] * original)

    def run(batches: Iterator) -> Iterator:
        for b in pieces(batches):
            out = [one(*r) for r in zip(b["path"].to_pylist(), b["text"].to_pylist(), b["edits"].to_pylist(), strict=True)]
            cols = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def diff(old: DataFrame, new: DataFrame, context: int = 4) -> DataFrame:
    """(path, hunk, row, op, old_line, new_line, text) between two versions of a corpus."""
    import pyarrow as pa

    schema = "path string, hunk int, row int, op string, old_line int, new_line int, text string"
    both = old.select("path", F.col("text").alias("a")).join(new.select("path", F.col("text").alias("b")), "path").where("a <> b")

    def run(batches: Iterator) -> Iterator:
        from ..functions.rewrite import hunks

        for b in pieces(batches):
            out = [(p, h, k, *r) for p, x, y in zip(b["path"].to_pylist(), b["a"].to_pylist(), b["b"].to_pylist(), strict=True) for h, rows in enumerate(hunks(x, y, context)) for k, r in enumerate(rows)]
            cols = zip(*out, strict=True) if out else [()] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "hunk", "row", "op", "old_line", "new_line", "text"])

    return both.mapInArrow(run, schema)


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, line_number, old_text, new_text) of lines that differ, for versions with equally many lines: native."""
    both = old.select("path", F.split("text", "\n", -1).alias("a")).join(new.select("path", F.split("text", "\n", -1).alias("b")), "path")
    pairs = F.filter(F.zip_with(F.zip_with("a", F.sequence(F.lit(1), F.size("a")), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), "b", lambda s, y: F.struct(s["i"].cast("long").alias("line_number"), s["x"].alias("old_text"), y.alias("new_text"))), lambda s: ~s["old_text"].eqNullSafe(s["new_text"]))
    return both.select("path", F.inline(pairs))


def normalized(corpus: DataFrame) -> DataFrame:
    """(path, text) in normalized form. ASCII texts stay native; only the others go through Python."""
    @F.pandas_udf("string")
    def other(texts: pd.Series) -> pd.Series:
        from ..functions.rewrite import normalize

        return texts.map(lambda t: None if t is None else normalize(t))

    ascii_ = F.octet_length("text") == F.char_length("text")
    plain = F.regexp_replace("text", r"(?m)[\t\x0B\x0C\r ]+$", "")
    done = corpus.where(ascii_).select("path", plain.alias("text"))
    return done.unionByName(corpus.where(~ascii_).select("path", other("text").alias("text")))
