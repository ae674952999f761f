"""Line search over a corpus (path, text). Everything about one file happens inside its row, on the array of its lines: no
shuffle for counts, context or per-file limits. Only the global limit looks across files: one scan writes (path, count) rows, a
sum of them tells whether it binds, and then they are sorted by range."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..corpus import search_lines
from ..dialect import backtracks, glob_regex, has_upper, java_regex, lexical, linear_regex, required_literal
from ..errors import CorpusError, invalid
from ..storage import materialize

DEFAULT_TOTAL = 100_000
#: What a line counts besides its text.
LINE_BYTES = 24
#: Bounds of a request.
MOST_TOTAL, MOST_CONTEXT, MOST_PATTERN, MOST_GLOBS, MOST_GLOB = 1_000_000, 10_000, 1 << 20, 256, 16 << 10


def glob_filter(corpus: DataFrame, globs: tuple[str, ...] = ()) -> DataFrame:
    """Files whose path or name matches any of the globs (``*`` crosses slashes here)."""
    if not globs:
        return corpus
    regex = "|".join(glob_regex(g, False) for g in globs)
    return corpus.where(F.col("path").rlike(regex) | F.substring_index("path", "/", -1).rlike(regex))


def searchable(files: DataFrame) -> DataFrame:
    """Without binary and oversize files; they make a search incomplete (see `rollup`)."""
    from ..corpus import SEARCH_BYTES

    if "is_binary" not in files.columns:
        return files
    return files.where(~F.col("is_binary") & (F.col("size") <= SEARCH_BYTES))


def under_root(corpus: DataFrame, root: str) -> tuple[DataFrame, bool]:
    """(files searched, whether the root is a folder): the one file of that path, or all files below it; else notFound."""
    if root in ("", "."):
        return corpus, True
    below = F.startswith("path", F.lit(root + "/"))
    kinds = corpus.where((F.col("path") == root) | below).select((F.col("path") == root).alias("file")).distinct().collect()
    if not kinds:
        raise CorpusError("notFound", "no such file or folder", path=root)
    is_file = any(r.file for r in kinds)
    return corpus.where(F.col("path") == root if is_file else below), not is_file


def _linear_flags(regex: str):
    """Whether each line of a file matches, by Arrow's RE2: linear in the line, whatever the pattern."""

    @F.pandas_udf("array<boolean>")
    def flags(lines: pd.Series) -> pd.Series:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        sizes = [0 if x is None else len(x) for x in lines]
        flat = [t for x in lines if x is not None for t in x]
        hit = np.asarray(pc.match_substring_regex(pa.array(flat, pa.string()), regex).fill_null(False)) if flat else np.zeros(0, bool)
        ends = np.cumsum(sizes)
        return pd.Series([hit[e - n : e] for e, n in zip(ends, sizes, strict=True)])

    return flags


def _once(value: Column) -> Column:
    """A value of a row as the optimizer leaves it: found once a row, not again wherever it is named. Inside a lambda over the lines of a
    file that would be once a line."""
    return F.explode_outer(F.array(value))


@dataclass
class Search:
    """A compiled search. `files`, `counts`, `content`, `blocks` and `rollup` are its result tables. ``root``: a file or a folder of
    the corpus. ``max_output_bytes``: an error if the content holds more bytes of lines and paths. ``max_file_bytes``: a file's content ends
    before the line with which its lines, LINE_BYTES each and their text, would exceed it; its later matches do not count, and the roll-up of
    mode content is incomplete."""

    corpus: DataFrame
    pattern: str
    case_insensitive: bool = False
    smart_case: bool = False
    fixed_strings: bool = False
    multiline: bool = False
    globs: tuple[str, ...] = ()
    before: int = 0
    after: int = 0
    max_count: int | None = None
    max_total_count: int = DEFAULT_TOTAL
    root: str = ""
    max_output_bytes: int | None = None
    max_file_bytes: int | None = None

    def __post_init__(self):
        if min(self.before, self.after, self.max_total_count, self.max_count or 0) < 0 or max(self.max_total_count, self.max_count or 0) > MOST_TOTAL:
            raise invalid("limits must lie between 0 and 1,000,000")
        if max(self.before, self.after) > MOST_CONTEXT:
            raise invalid(f"context is bounded by {MOST_CONTEXT} lines")
        if len(self.pattern.encode()) > MOST_PATTERN:
            raise invalid("a pattern is bounded by 1 MiB")
        if len(self.globs) > MOST_GLOBS or any(len(g.encode()) > MOST_GLOB for g in self.globs):
            raise invalid("globs are bounded by 256 of 16 KiB each")
        self.regex = java_regex(self.pattern, self.case_insensitive, self.smart_case, self.fixed_strings, self.multiline)
        self.root = lexical(self.root)
        self.corpus, self.root_is_dir = under_root(self.corpus, self.root)
        self.source = glob_filter(searchable(self.corpus), self.globs)
        fold = self.case_insensitive or self.smart_case and not has_upper(self.pattern)
        self.literal = None if fold else self.pattern if self.fixed_strings else required_literal(self.pattern)
        linear = None if self.fixed_strings or self.multiline or not backtracks(self.pattern) else linear_regex(self.pattern, fold)
        self.linear = linear is not None
        if self.linear:
            self.source = self.source.withColumn("_flags", _linear_flags(linear)(search_lines()))
        #: Files that hold what every match holds; only they are taken apart.
        self.narrow = self.source if self._may() is None else self.source.where(self._may())

    def _may(self) -> Column | None:
        """Whether a text can match at all, by the literal that every match holds."""
        return F.contains("text", F.lit(self.literal)) if self.literal and "\n" not in self.literal else None

    def _hit(self, line: Column) -> Column:
        if self.fixed_strings and not self.case_insensitive and not self.smart_case:
            return F.contains(line, F.lit(self.pattern))
        return line.rlike(self.regex)

    def _flags(self) -> Column:
        """For each line of a file whether it matches."""
        return F.col("_flags") if self.linear else F.transform(search_lines(), self._hit)

    def _all_numbers(self) -> Column:
        if self.linear:
            return F.filter(F.transform("_flags", lambda f, i: F.when(f, i + 1)), lambda i: i.isNotNull())
        return F.filter(F.transform(search_lines(), lambda x, i: F.when(self._hit(x), i + 1)), lambda i: i.isNotNull())

    def _any(self) -> Column:
        return F.exists("_flags", lambda f: f) if self.linear else F.exists(search_lines(), self._hit)

    def _numbers(self) -> Column:
        """Ascending numbers of the matching lines of a file, the per-file limit applied (0 acts as 1)."""
        all_ = self._all_numbers()
        return all_ if self.max_count is None else F.slice(all_, 1, max(1, self.max_count))

    def _counted(self, n: Column) -> DataFrame:
        """(path, n) of files with n > 0, written by the one scan of a limited view: whether the limit binds, where it cuts and the
        answer itself are read from that table."""
        return materialize(self.narrow.select("path", n.cast("long").alias("n")).where("n > 0"), "matches")

    def files(self, limited: bool = True) -> DataFrame:
        """(path) of files with a matching line; a file's scan stops at its first match. The limit counts files here."""
        hit = self._any()
        if not limited:
            return self.narrow.where(hit).select("path")
        found = self._counted(hit.cast("long"))
        cut = _cut(found, self.max_total_count)
        return (found if cut is None else found.where(F.col("path") <= cut[0]) if cut[1] else found.where(F.lit(False))).select("path")

    def _matches(self) -> Column:
        if self.max_count is None and not self.linear:
            return F.size(F.filter(search_lines(), self._hit))
        return F.size(self._numbers())

    def counts(self, limited: bool = True) -> DataFrame:
        """(path, match_count) of files with at least one matching line, up to the global limit in path order."""
        if not limited:
            return self.narrow.select("path", self._matches().cast("long").alias("match_count")).where("match_count > 0")
        found = self._counted(self._matches())
        cut = _cut(found, self.max_total_count)
        found = found.withColumnRenamed("n", "match_count")
        if cut is None:
            return found
        return found.where(F.col("path") <= cut[0]).select("path", F.when(F.col("path") == cut[0], F.lit(cut[1]).cast("long")).otherwise(F.col("match_count")).alias("match_count")).where("match_count > 0")

    def content(self, limited: bool = True) -> DataFrame:
        """`rows`, measured against ``max_output_bytes``."""
        out = self.rows(limited)
        if self.max_output_bytes is not None:
            size = out.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("path")), F.lit(0))).head()[0]
            if size > self.max_output_bytes:
                raise invalid(f"the result has {size} bytes, more than {self.max_output_bytes}")
        return out

    def rows(self, limited: bool = True) -> DataFrame:
        """(path, line_number, text, is_match): matches and their context, each line once.

        At a limit, rows stay up to the last kept match and its following context, but not from the first dropped match on.
        """
        if self.max_total_count == 0 and limited:
            return self.source.where(F.lit(False)).select("path", F.lit(0).cast("long").alias("line_number"), "text", F.lit(True).alias("is_match"))
        source, share = self.narrow, None
        if limited:
            if self.max_file_bytes is None:
                counted = self._counted(self._matches())
            else:
                counted = materialize(self._lines(source, None).select("path", F.size(F.filter("out", lambda s: s["m"])).cast("long").alias("n")).where("n > 0"), "matches")
            if cut := _cut(counted, self.max_total_count):
                source = source.where(F.col("path") <= cut[0])
                share = F.when(F.col("path") == cut[0], cut[1])
        if share is None and self.max_count is None and self.max_file_bytes is None and not self.before and not self.after and not self.linear:
            rows = source.select("path", F.posexplode(search_lines()).alias("i", "t")).where(self._hit(F.col("t")))
            return rows.select("path", (F.col("i") + 1).cast("long").alias("line_number"), F.regexp_replace("t", "\r$", "").alias("text"), F.lit(True).alias("is_match"))
        rows = self._lines(source, share)
        return rows.select("path", F.explode_outer("out").alias("s")).where("s is not null").select("path", F.col("s.n").cast("long").alias("line_number"), F.regexp_replace("s.t", "\r$", "").alias("text"), F.col("s.m").alias("is_match"))

    def _lines(self, source: DataFrame, share: Column | None) -> DataFrame:
        """(path, out, full): the lines (n, t, m) of each file with a match, of at most ``share`` matches, as one array; full where the file
        has more lines than ``max_file_bytes`` let through."""
        hit = lambda x, i: F.get("_flags", i) if self.linear else self._hit(x)
        rows = source.select("path", _once(F.transform(search_lines(), lambda x, i: F.struct((i + 1).alias("n"), x.alias("t"), hit(x, i).alias("m")))).alias("ls"))
        rows = rows.select("path", "ls", _once(F.transform(F.filter("ls", lambda s: s["m"]), lambda s: s["n"])).alias("ms")).where(F.size("ms") > 0)
        kept = F.size("ms") if self.max_count is None else F.least(F.size("ms"), F.lit(max(1, self.max_count)))
        rows = rows.withColumn("r", kept if share is None else F.least(kept, F.coalesce(share, kept))).where("r > 0")
        rows = rows.withColumn("last", F.try_element_at("ms", F.greatest(F.col("r"), F.lit(1)))).withColumn("next", F.coalesce(F.try_element_at("ms", F.col("r") + 1), F.size("ls") + 1))
        near = lambda i: F.exists(F.slice("ls", F.greatest(i - F.lit(self.after), F.lit(1)), F.least(i, F.lit(self.after + 1)) + F.lit(self.before)), lambda s: s["m"])
        out = F.filter("ls", lambda s: (s["n"] < F.col("next")) & (s["n"] <= F.col("last") + self.after) & near(s["n"]))
        out = F.transform(out, lambda s: F.struct(s["n"], s["t"], (s["m"] & (s["n"] <= F.col("last"))).alias("m")))
        rows = rows.select("path", _once(out).alias("out"))
        if self.max_file_bytes is None:
            return rows.withColumn("full", F.lit(False))
        size = lambda s: F.octet_length(F.regexp_replace(s["t"], "\r$", "")) + LINE_BYTES
        step = lambda a, s: F.struct((a["b"] + size(s)).alias("b"), (a["k"] + (a["b"] + size(s) <= self.max_file_bytes).cast("int")).alias("k"))
        fits = F.aggregate("out", F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("k")), step, lambda a: a["k"])
        rows = rows.select("path", "out", _once(fits).alias("k"))
        return rows.select("path", F.slice("out", F.lit(1), F.col("k")).alias("out"), (F.col("k") < F.size("out")).alias("full"))

    def blocks(self) -> DataFrame:
        """Multiline matches: (path, line_number of the first line, n_lines, text of the match)."""
        pieces, found = F.split("text", self.regex, -1), F.regexp_extract_all("text", F.lit(self.regex), F.lit(0))
        feeds = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
        rows = self.narrow.where(F.col("text").rlike(self.regex)).select("path", F.transform(pieces, feeds).alias("gap"), found.alias("found"))
        rows = rows.withColumn("inside", F.transform("found", feeds))
        line = lambda i: F.aggregate(F.slice("gap", F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice("inside", F.lit(1), i), F.lit(0), lambda a, x: a + x)
        out = F.transform("found", lambda m, i: F.struct((line(i) + 1).cast("long").alias("line_number"), (F.get("inside", i) + 1).cast("long").alias("n_lines"), m.alias("text")))
        return rows.select("path", F.inline(out))

    def rollup(self, mode: str = "count", limited: bool = True) -> DataFrame:
        """One row: files_searched, files_with_matches, total_matches (both after limits), limit_reached, incomplete, root, root_is_dir.
        In ``mode`` files a file counts as one match, in mode content those count that ``max_file_bytes`` lets through. Without
        ``limited`` all matches count, and limit_reached only tells whether they are as many as the limit."""
        n = self._any().cast("long") if mode == "files" else self._matches().cast("long")
        n = n if self._may() is None else F.when(self._may(), n).otherwise(0)
        capped = mode == "content" and self.max_file_bytes is not None
        if capped:
            per = self._lines(self.source, None).select("path", F.size(F.filter("out", lambda s: s["m"])).cast("long").alias("n"), "full")
            rest = self.source.select("path", (~self._any()).alias("none")).where("none")
            per = materialize(per.unionByName(rest.select("path", F.lit(0).cast("long").alias("n"), F.lit(False).alias("full"))), "matches")
        else:
            per = materialize(self.source.select("path", n.alias("n")), "matches")
        cut = _cut(per.where("n > 0").select("path", "n"), self.max_total_count) if limited else None
        shown = (F.col("n") > 0) if cut is None else (F.col("n") > 0) & ((F.col("path") < cut[0]) | (F.col("path") == cut[0]) & F.lit(cut[1] > 0))
        total = F.coalesce(F.sum("n"), F.lit(0))
        agg = per.agg(F.count("*").alias("files_searched"), F.count_if(shown).alias("files_with_matches"), (F.least(total, F.lit(self.max_total_count)) if limited else total).cast("long").alias("total_matches"), (total >= self.max_total_count).alias("limit_reached"))
        last = [F.lit(self.root).alias("root"), F.lit(self.root_is_dir).alias("root_is_dir")]
        full = F.lit(capped and per.where("full").limit(1).count() > 0)
        if "is_binary" not in self.corpus.columns:
            return agg.select("*", full.alias("incomplete"), *last)
        from ..corpus import SEARCH_BYTES

        skipped = self.corpus.agg((F.coalesce(F.bool_or(F.col("is_binary") | (F.col("size") > SEARCH_BYTES)), F.lit(False)) | full).alias("incomplete"))
        return agg.join(skipped).select("*", *last)


def _cut(counts: DataFrame, limit: int) -> tuple[str, int] | None:
    """(path, matches that it may still give) where ``limit`` matches are reached in path order; None if they never are.
    counts: (path, n > 0). Sorted by range, a sum for each range, and then the one range that holds the cut."""
    total, first = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.min("path")).head()
    if total < limit or first is None:
        return None
    if limit == 0:
        return first, 0
    ranges = materialize(counts.select("path", "n").repartitionByRange("path").withColumn("part", F.spark_partition_id()), "counts-by-path")
    before = 0
    for r in ranges.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        if before + r.n >= limit:
            break
        before += r.n
    inside = ranges.where(F.col("part") == r.part).orderBy("path").limit(limit)  # one range, at most ``limit`` rows
    running = F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)) + before
    row = inside.withColumn("total", running).where(F.col("total") >= limit).orderBy("path").limit(1).head()
    return row.path, row.n - (row.total - limit)


def grep(corpus: DataFrame, pattern: str, mode: str = "files", **options) -> DataFrame:
    """mode: files | count | content | blocks | rollup; files, count and content come in path and line order."""
    s = Search(corpus, pattern, **options)
    views = {"files": s.files, "count": s.counts, "content": s.content, "blocks": s.blocks, "rollup": s.rollup}
    if mode not in views:
        raise invalid(f"unknown mode {mode!r}")
    out = views[mode]()
    return out.orderBy("path", "line_number") if mode == "content" else out.orderBy("path") if mode in ("files", "count") else out
