"""Path search over entries (rel_path, kind): globs, exact count, limit, output budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dialect import find_regex, glob_regex
from ..errors import invalid

DEFAULT_LIMIT, MOST = 1000, 1_000_000
BUDGET = 50 * 1024
PATTERN_BYTES, EXCLUDES, EXCLUDE_BYTES = 4096, 128, 16 * 1024


def entries_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Files and all folders above them, as (rel_path, kind)."""
    parts = F.split(path, "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("rel_path"))
    return files.select(F.col(path).alias("rel_path"), F.lit("file").alias("kind")).unionByName(folders.where("rel_path is not null").distinct().select("rel_path", F.lit("dir").alias("kind")))


def hidden(path: str = "rel_path") -> Column:
    return F.exists(F.split(path, "/"), lambda x: F.startswith(x, F.lit(".")))


def matching(entries: DataFrame, pattern: str = "", exclude: tuple[str, ...] = (), show_hidden: bool = True, root: str = "") -> DataFrame:
    """Entries that a pattern finds, rendered (folders end with a slash). ``root``: what full-path patterns see before the
    relative path. Excludes come first, are case-sensitive, and see folders with their slash."""
    if len(pattern.encode()) > PATTERN_BYTES or len(exclude) > EXCLUDES or sum(len(x.encode()) for x in exclude) > EXCLUDE_BYTES:
        raise invalid("pattern or excludes too long")
    shown = F.concat("rel_path", F.when(F.col("kind") == "dir", "/").otherwise(""))
    rows = entries.withColumn("shown", shown)
    if not show_hidden:
        rows = rows.where(~hidden())
    name = F.substring_index("rel_path", "/", -1)
    for whole, seen in ((False, name), (True, F.col("rel_path"))):
        globs = [g for g in exclude if ("/" in g.rstrip("/")) == whole]
        if globs:
            regex = "|".join(glob_regex(g, True) for g in globs)
            rows = rows.where(~(seen.rlike(regex) | F.concat(seen, F.when(F.col("kind") == "dir", "/").otherwise("")).rlike(regex)))
    if compiled := find_regex(pattern):
        regex, whole = compiled
        rows = rows.where((F.concat(F.lit(root.rstrip("/") + "/"), "rel_path") if whole else name).rlike(regex))
    return rows


def find(entries: DataFrame, pattern: str = "", limit: int = DEFAULT_LIMIT, exclude: tuple[str, ...] = (), show_hidden: bool = True, root: str = "", budget: int = BUDGET) -> DataFrame:
    """(position, shown, kind) of the kept paths in component order: at most ``limit``, and within the output budget, which
    the first path that crosses it may exceed."""
    if not 0 <= limit <= MOST:
        raise invalid("limit must lie between 0 and 1,000,000")
    rows = matching(entries, pattern, exclude, show_hidden, root)
    order = F.split("rel_path", "/")
    kept = rows.select("rel_path", "shown", "kind", order.alias("o")).orderBy("o", "kind").limit(limit)
    before = Window.orderBy("o", "kind").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.select("shown", "kind", F.coalesce(F.sum(F.octet_length("shown") + 1).over(before), F.lit(0)).alias("used"), F.row_number().over(Window.orderBy("o", "kind")).cast("long").alias("position"))
    return kept.where(F.col("used") <= budget).select("position", "shown", "kind")


def find_summary(entries: DataFrame, pattern: str = "", limit: int = DEFAULT_LIMIT, **options) -> DataFrame:
    """One row: total_matches (exact, whatever the limits), limit_reached, output_limit_reached."""
    budget = options.pop("budget", BUDGET)
    total = matching(entries, pattern, **options).agg(F.count("*").alias("total_matches"))
    kept = find(entries, pattern, limit, budget=budget, **options).agg(F.count("*").alias("n"))
    return total.join(kept).select("total_matches", (F.col("total_matches") > limit).alias("limit_reached"), (F.col("n") < F.least(F.col("total_matches"), F.lit(limit))).alias("output_limit_reached"))
