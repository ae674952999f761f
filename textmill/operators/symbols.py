"""The symbol index as a table, plain or stored for look-up: definitions, outline, fuzzy search. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .lookup import Lookup

#: Order in which kinds are jumped to.
JUMP = ["function", "method", "class", "struct", "interface", "enum", "trait", "type", "module", "constant", "field"]
DEFAULT_LIMIT = 200
PER_FILE = 10_000


def jump_priority(kind: str = "kind") -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, JUMP)), F.col(kind)), F.lit(0)), F.lit(len(JUMP) + 1))


def outline(symbols: DataFrame, path: str | None = None) -> DataFrame:
    """Symbols of a file (or of all) in source order, at most PER_FILE each."""
    rows = symbols if path is None else symbols.where(F.col("path") == path)
    order = Window.partitionBy("path").orderBy("def_start", F.desc("def_end"), "line", "name_start")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= PER_FILE)


def capped(symbols: DataFrame, most: int = PER_FILE) -> DataFrame:
    """The first ``most`` symbols of each file by ``idx``, with ``truncated``: whether the file has that many or more."""
    file = Window.partitionBy("path")
    rows = symbols.withColumn("_k", F.row_number().over(file.orderBy("idx"))).withColumn("truncated", F.count("*").over(file) >= most)
    return rows.where(F.col("_k") <= most).drop("_k")


def definitions(symbols: DataFrame, name: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Symbols of that name, whatever the case: by kind, depth, path, line. One more row than ``limit`` tells that there are more."""
    return symbols.where(F.lower("name") == name.lower()).orderBy(jump_priority(), "depth", "path", "line").limit(limit)


def score(name: Column, needle: str) -> Column:
    """Fuzzy score of a lower-case name, null without a match: exact, prefix, substring (better at a word's start), subsequence."""
    n = needle.strip().lower()
    size, at = F.char_length(name), F.instr(name, n)
    head = F.substring_index(name, n, 1)
    boundary = F.right(head, F.lit(1)).isin("_", "-", ".", ":")
    step = lambda a, c: F.struct(
        _next(c, name, a).alias("pos"),
        F.when(a["first"] == 0, _next(c, name, a)).otherwise(a["first"]).alias("first"),
        (a["ok"] & (_next(c, name, a) > 0)).alias("ok"),
    )
    zero = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("first"), F.lit(True).alias("ok"))
    walk = F.aggregate(F.array(*map(F.lit, n)), zero, step)
    gaps = walk["pos"] - walk["first"] - (len(n) - 1)
    return (
        F.when(name == n, 10000 - size)
        .when(F.startswith(name, F.lit(n)), 8000 - size)
        .when(at > 0, F.when(boundary, 6000).otherwise(4000) - F.octet_length(head) - size)
        .when(walk["ok"], 2000 - F.least(gaps, F.lit(1000)) - size)
    )


def _next(c: Column, name: Column, a: Column) -> Column:
    """Place (from 1) of a character after a["pos"], 0 if none."""
    return F.call_function("locate", c, name, a["pos"] + 1)


def search(symbols: DataFrame, needle: str, limit: int = DEFAULT_LIMIT, view: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` symbols by score, then shorter names (bytes), path, line, place in the file. ``view`` (path) narrows."""
    if not needle.strip():
        return symbols.withColumn("score", F.lit(0)).where(F.lit(False))
    rows = symbols if view is None else symbols.join(view.select("path"), "path", "left_semi")
    rows = rows.withColumn("score", score(F.lower("name"), needle)).where("score is not null")
    return rows.orderBy(F.desc("score"), F.octet_length("name"), "path", "line", "idx").limit(limit)


def nesting(symbols: DataFrame) -> DataFrame:
    """Depth from spans: how many symbols of the file enclose one. Ends of open spans are kept on a stack within the row of a
    file."""
    rest = [c for c in symbols.columns if c not in ("path", "idx", "depth", "def_start", "def_end", "line", "name")]
    order = F.array_sort(F.collect_list(F.struct("def_start", (-F.col("def_end")).alias("e"), "line", "name", "idx", "def_end", *([F.struct(*rest).alias("rest")] if rest else []))))
    live = lambda a, s: F.filter(a["open"], lambda e: e >= s["def_end"])
    fits = lambda a, s: F.filter(live(a, s), lambda e: e > s["def_start"])
    zero = F.struct(F.array().cast("array<long>").alias("open"), F.array().cast("array<int>").alias("out"))
    step = lambda a, s: F.struct(F.array_append(fits(a, s), s["def_end"]).alias("open"), F.array_append(a["out"], F.size(fits(a, s))).alias("out"))
    files = symbols.groupBy("path").agg(order.alias("s"))  # all columns: no join, for which texts would be parsed again
    rows = files.select("path", F.explode(F.arrays_zip("s", F.aggregate("s", zero, step, lambda a: a["out"]).alias("depth"))).alias("d"))
    of = lambda c: F.col("d.depth" if c == "depth" else f"d.s.rest.`{c}`" if c in rest else f"d.s.`{c}`").alias(c)
    return rows.select("path", "d.s.idx", *[of(c) for c in symbols.columns if c not in ("path", "idx", "depth")], of("depth"))


def merge_adjacent(symbols: DataFrame) -> DataFrame:
    """Neighbours of one name, kind and depth in a file become one (languages that define a function by several equations)."""
    w = Window.partitionBy("path").orderBy("idx")
    same = (F.lag("name").over(w) == F.col("name")) & (F.lag("kind").over(w) == F.col("kind")) & (F.lag("depth").over(w) == F.col("depth"))
    return symbols.withColumn("_same", F.coalesce(same, F.lit(False))).where("not _same").drop("_same")


#: Letters of a gram, and the bits of a name's letter signature.
GRAM, BITS = 3, 63
#: No subsequence scores more.
BEST_SUBSEQUENCE = 2000


def _signature(name: Column) -> Column:
    """Bits of the letters of a name; a name holds a subsequence only if its signature holds that of the needle."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(BITS)).cast("int"))
    return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(bit(c)))


def _mask(needle: str) -> int:
    return sum({1 << ord(c) % BITS for c in needle if ord(c) < 128})


class SymbolIndex:
    """Symbols stored for look-up: by lower-case name, with an inverted list of the names' grams and a table of the distinct names.

    `definitions` reads the rows of one name. `search` intersects the lists of the needle's grams, scores the rows of those names,
    and is done if they fill the limit with scores that no subsequence reaches; else it goes through the distinct names, narrowed by their
    letters, not through the symbols. Results are those of the functions of this module."""

    def __init__(self, by_name: Lookup, grams: Lookup, names: DataFrame, columns: list[str]):
        self.by_name, self.grams, self.names, self.columns = by_name, grams, names, columns

    @classmethod
    def build(cls, symbols: DataFrame) -> SymbolIndex:
        rows = materialize(symbols.where("name is not null").withColumn("name_lc", F.lower("name")), "symbols")
        names = materialize(rows.select("name_lc").distinct().withColumn("letters", _signature(F.col("name_lc"))), "names")
        starts = F.sequence(F.lit(1), F.char_length("name_lc") - (GRAM - 1))
        grams = names.where(F.char_length("name_lc") >= GRAM).select(F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("name_lc", i, F.lit(GRAM))))).alias("gram"), "name_lc")
        return cls(Lookup.write(rows, "name_lc", "symbols-by-name"), Lookup.write(materialize(grams, "grams"), "gram", "names-by-gram"), names, symbols.columns)

    def definitions(self, name: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        return definitions(self.by_name.of([name.lower()]), name, limit).select(*self.columns)

    def _best(self, names: DataFrame, needle: str, limit: int, view: DataFrame | None) -> DataFrame:
        return search(self.by_name.of_frame(names), needle, limit, view).select(*self.columns, "score")

    def search(self, needle: str, limit: int = DEFAULT_LIMIT, view: DataFrame | None = None) -> DataFrame:
        n = needle.strip().lower()
        if not n:
            return search(self.by_name.all(), needle, limit, view).select(*self.columns, "score")
        if len(n) >= GRAM:
            grams = sorted({n[k : k + GRAM] for k in range(len(n) - GRAM + 1)})
            held = self.grams.of(grams).groupBy("name_lc").agg(F.count("*").alias("k")).where(F.col("k") == len(grams)).select("name_lc")
            best = materialize(self._best(held, needle, limit, view), "best")
            rows, least = best.agg(F.count("*"), F.min("score")).head()
            if rows == limit and limit and least >= BEST_SUBSEQUENCE:
                return best.orderBy(F.desc("score"), F.octet_length("name"), "path", "line", "idx")
        mask = F.lit(_mask(n)).cast("long")
        return self._best(self.names.where(F.col("letters").bitwiseAND(mask) == mask).select("name_lc"), needle, limit, view)
