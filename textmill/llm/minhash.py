"""Near-duplicate detection by improved consistent weighted sampling (ICWS) over TF-IDF weighted word shingles.

1. Document frequencies of all shingles of all documents, hashed to DF_BUCKETS sums; idf = ln(1 + documents / df).
2. Equal texts become one class. A class's sketch has BANDS x ROWS consistent weighted samples of its shingles, weights
   tf * idf; each band's samples are hashed to one value.
3. Classes that share a band value are candidates. Every member of such a bucket is paired with the bucket's centre (a member
   chosen by a hash that differs from band to band), which needs no pairs within a group.
4. Pairs are verified: exact weighted Jaccard similarity of at least THRESHOLD over the whole texts.
5. Links make components. Where the members of a bucket are still apart, those outside its largest component are
   paired with other members of that component, for ROUNDS rounds; last, the members of one bucket that are still apart are
   compared in blocks of about BLOCK texts or BLOCK_BYTES, whichever is less, so that no candidate link between different components
   is lost. Blocks are dealt as ids; a text joins each pair of blocks that needs it (it is smaller than its shingles with their
   counts). A block gives a spanning forest of its links, never its pairs.

Words are runs of lowered ASCII letters, digits, underscores and non-ASCII characters; a text of one to four words is one shingle. Defined cases: a null text, or one without
words, is never linked: equal ones share no class and each stays its own; repeated rows are copies of one another;
null ids sort last; an empty table gives no rows; other columns are ignored (`one_of_each` keeps them).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected as components
from .common import bounded_batches, broadcast_if_small, materialize, release

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
ROUNDS = 1
BLOCK, BLOCK_BYTES = 256, 8 << 20
DF_BUCKETS = 1 << 18
POOL = 1 << 16


#: Bytes of words: ASCII letters (lowered), digits, the underscore, and all of non-ASCII characters.
_IN_WORD = bytes(c >= 128 or c in b"abcdefghijklmnopqrstuvwxyz0123456789_" for c in range(256))
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of _BASE and of its inverse modulo 2 ** 64, as many as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = None

    def get(self, n: int):
        import numpy as np

        if self.up is None or len(self.up) < n:
            size = max(1 << 16, 1 << (n - 1).bit_length())
            ones = lambda v: np.concatenate([np.ones(1, np.uint64), np.full(size - 1, v, np.uint64)])
            self.up = np.cumprod(ones(_BASE), dtype=np.uint64)
            self.down = np.cumprod(ones(pow(_BASE, -1, 1 << 64)), dtype=np.uint64)
        return self.up, self.down


def _mix(h):
    import numpy as np

    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(text: str, memory: Powers):
    """A 64-bit hash of each word, from prefix sums over the text's bytes: no loop over words."""
    import numpy as np

    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(_IN_WORD, np.uint8)[b]
    edge = np.flatnonzero(np.diff(inside, prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = memory.get(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def shingles(text: str, memory: Powers, size: int = WORDS):
    """(distinct shingle hashes, ascending; how often each occurs)"""
    import numpy as np

    h = word_hashes(text, memory)
    if not len(h):
        return h, np.zeros(0, np.int64)
    n = max(1, len(h) - size + 1)
    s = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        s = (s * np.uint64(_BASE) + h[k : k + n]) ^ (s >> np.uint64(29))
    return np.unique(_mix(s), return_counts=True)


class Sampler:
    """ICWS. The draws (r, ln c, beta) of a shingle and a sample come from one pool of POOL triples, entered at a
    multiplicative hash of the shingle that differs from sample to sample."""

    def __init__(self, samples: int, seed: int = 1):
        import numpy as np

        g = np.random.default_rng(seed)
        self.r = g.gamma(2.0, 1.0, POOL).astype(np.float32)
        self.ln_c = np.log(g.gamma(2.0, 1.0, POOL)).astype(np.float32)
        self.beta = g.random(POOL).astype(np.float32)
        self.odd = g.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, h, weight):
        """One 64-bit value per sample: the chosen shingle with its quantised weight."""
        import numpy as np

        best = np.full(len(self.odd), np.inf, np.float32)
        out = np.zeros(len(self.odd), np.uint64)
        for a in range(0, len(h), 20_000):
            part, ln_w = h[a : a + 20_000], np.log(weight[a : a + 20_000]).astype(np.float32)
            at = ((part[None, :] * self.odd[:, None]) >> np.uint64(48)).astype(np.int32)
            r = self.r[at]
            t = np.floor(ln_w[None, :] / r + self.beta[at])
            score = self.ln_c[at] - r * (t - self.beta[at]) - r
            k = score.argmin(1)
            rows = np.arange(len(k))
            value = part[k] * np.uint64(0x9E3779B97F4A7C15) + t[rows, k].astype(np.int64).astype(np.uint64)
            take = score[rows, k] < best
            best[take], out[take] = score[rows, k][take], value[take]
        return out


def weighted_jaccard(a, wa, b, wb) -> float:
    """Sum of minima over sum of maxima; a and b ascending and distinct."""
    import numpy as np

    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[ia], wb[ib]).sum())
    return low / max(float(wa.sum()) + float(wb.sum()) - low, 1e-300)


def document_frequencies(docs: DataFrame, text_col: str = "text"):
    """(documents, df per bucket as an array of DF_BUCKETS numbers). Sums meet in Spark; what comes to the driver is bounded."""
    import numpy as np
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        memory, total = Powers(), np.zeros(DF_BUCKETS, np.int64)
        for b in batches:
            got = [shingles(t, memory)[0] % np.uint64(DF_BUCKETS) for t in b["t"].to_pylist() if t]
            if got:
                total += np.bincount(np.concatenate(got).astype(np.int64), minlength=DF_BUCKETS)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 65536):
            k = at[a : a + 65536]
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array(total[k])], names=["bucket", "n"])
        release()

    n = docs.count()
    sums = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(DF_BUCKETS)
    df[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    return n, df


def content(text: str | Column = "text") -> Column:
    """Digest that stands for a text; null for a null text."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


class Weights:
    """Shingles of a text with their tf * idf."""

    def __init__(self, n: int, df):
        import numpy as np

        self.idf = np.log1p(n / np.maximum(df, 1.0))
        self.memory = Powers()

    def __call__(self, text: str):
        h, tf = shingles(text, self.memory)
        return h, self.weigh(h, tf)

    def weigh(self, h, tf):
        import numpy as np

        return tf * self.idf[(h % np.uint64(DF_BUCKETS)).astype(np.int64)]


def sketches(docs: DataFrame, idf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, bands) per row; bands is null for a text without words."""
    import numpy as np
    import pyarrow as pa

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), content(text_col).alias("h"), F.col(text_col).alias("t"))

    def run(batches: Iterator) -> Iterator:
        weights, sampler = Weights(*idf.value), Sampler(BANDS * ROWS)
        fold = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)[:ROWS]
        for b in batches:
            out = []
            for t in b["t"].to_pylist():
                h, w = weights(t or "")
                if not len(h):
                    out.append(None)
                    continue
                v = sampler.samples(h, w).reshape(BANDS, ROWS) * fold
                v = v[:, 0] ^ (v[:, 1] >> np.uint64(7)) ^ (v[:, 2] << np.uint64(9)) if ROWS == 3 else np.bitwise_xor.reduce(v, axis=1)
                out.append(v.astype(np.int64))
            yield pa.record_batch([b["doc_id"], b["h"], pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "h", "bands"])
        release()

    return rows.mapInArrow(run, "doc_id long, h string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of content digests whose texts are similar enough, with the similarity."""
    import pyarrow as pa

    left = texts.select(F.col("h").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("t").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator) -> Iterator:
        weights, recent = Weights(*idf.value), OrderedDict()

        def of(h: str, text: str):
            if h not in recent:
                if len(recent) >= 64:
                    recent.popitem(last=False)
                recent[h] = weights(text)
            recent.move_to_end(h)
            return recent[h]

        for x in batches:
            cols = [x[c].to_pylist() for c in ("a", "b", "ta", "tb")]
            rows = [(a, b, weighted_jaccard(*of(a, ta), *of(b, tb))) for a, b, ta, tb in zip(*cols, strict=True)]
            rows = [r for r in rows if r[2] >= threshold]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["a", "b", "similarity"])
        recent.clear()
        release()

    return both.mapInArrow(run, "a string, b string, similarity double")


def _order(*parts: str) -> Column:
    return F.xxhash64(*[F.col(p) for p in parts])


def _distinct_pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _labels(links: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of linked classes, and the bucket members with their labels."""
    found = components(links)
    tagged = members.join(broadcast_if_small(found), F.col("h") == F.col("node"), "left").select("i", "v", "h", F.coalesce("label", "h").alias("label"))
    return found, materialize(tagged, "tagged")


def _apart(tagged: DataFrame) -> DataFrame:
    """Members of the buckets whose members lie in more than one component."""
    split = tagged.groupBy("i", "v").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("i", "v")
    return materialize(tagged.join(broadcast_if_small(materialize(split, "split")), ["i", "v"], "left_semi"), "apart")


def similarities(sets: list):
    """Weighted Jaccard of all pairs of (shingles, weights, counts): weight = count * idf, so a pair's minima are the idf of
    the (shingle, occurrence) features that both have, one product of matrices."""
    import numpy as np

    n = len(sets)
    total = np.array([w.sum() for _, w, _ in sets])
    sizes = [int(tf.sum()) for *_, tf in sets]
    doc = np.repeat(np.arange(n), sizes)
    h = np.concatenate([np.repeat(h, tf) for h, _, tf in sets])
    idf = np.concatenate([np.repeat(w / tf, tf) for _, w, tf in sets])
    turn = np.concatenate([np.arange(m) - np.repeat(np.cumsum(tf) - tf, tf) for m, (*_, tf) in zip(sizes, sets, strict=True)])
    key = h ^ (turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, column, often = np.unique(key, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    doc, column, idf = doc[shared], np.unique(column[shared], return_inverse=True)[1], idf[shared]
    order = np.argsort(column, kind="stable")
    doc, column, idf = doc[order], column[order], idf[order]
    low = np.zeros((n, n))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [c, c + 4096])
        m = np.zeros((n, 4096))
        m[doc[a:b], column[a:b] - c] = np.sqrt(idf[a:b])
        low += m @ m.T
    np.fill_diagonal(low, total)
    return low / np.maximum(total[:, None] + total[None, :] - low, 1e-300)


def block_links(apart: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) that connect what the links between differently labelled members of each bucket connect.

    The members outside a bucket's largest component (the rest) meet the members inside it, and one another, in
    groups of one block with another; members of the largest component never meet.
    """
    import numpy as np
    import pyarrow as pa

    from .embeddings import forest

    wide = texts.join(broadcast_if_small(materialize(apart.select("h").distinct(), "apart-texts")), "h", "left_semi").select("h", F.octet_length("t").cast("long").alias("w"))
    sizes = apart.join(broadcast_if_small(materialize(wide, "widths")), "h").groupBy("i", "v", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    plan = sizes.groupBy("i", "v").agg(F.max(F.struct("n", "label", "w")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(BLOCK)), F.least(n, F.ceil(w / F.lit(BLOCK_BYTES)))).cast("int")
    plan = plan.select("i", "v", F.col("m.label").alias("main"), blocks(F.col("m.n"), F.col("m.w")).alias("bm"), blocks(F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")).alias("br"))
    plan = materialize(plan, "plan")
    rows = apart.join(broadcast_if_small(plan), ["i", "v"]).withColumn("inside", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("h", "i"), F.when(F.col("inside"), F.col("bm")).otherwise(F.col("br"))).cast("int")
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    key = lambda kind, p, q: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))
    mine = F.col("own")
    to = F.when(F.col("inside"), F.transform(upto("br"), lambda p: key(0, p, mine))).otherwise(
        F.concat(F.transform(upto("bm"), lambda q: key(0, mine, q)), F.transform(upto("br"), lambda q: key(1, F.least(mine, q), F.greatest(mine, q))))
    )
    dealt = rows.withColumn("own", own).select("i", "v", "h", "label", F.explode(to).alias("g")).select("i", "v", "g.*", "h", "label")
    dealt = dealt.join(texts, "h")

    def run(batch: pa.Table) -> pa.Table:
        weights = Weights(*idf.value)
        h, label = np.array(batch["h"].to_pylist(), object), batch["label"].to_pylist()
        names, at = np.unique(label, return_inverse=True)
        sets = []
        for t in batch["t"].to_pylist():
            s, tf = shingles(t, weights.memory)
            sets.append((s, weights.weigh(s, tf), tf))
        m = (similarities(sets) >= threshold) & (at[:, None] != at[None, :])
        a, b = forest(m, h, h) if m.any() else ([], [])
        return pa.table({"a": pa.array(list(a), pa.string()), "b": pa.array(list(b), pa.string())})

    return dealt.groupBy("i", "v", "kind", "p", "q").applyInArrow(run, "a string, b string")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, h (its text), class_id (smallest id of its group), kept (it is that document),
    class_h (the text that stands for the group), n_class (rows of the group). A text without words is alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col))
    rows = materialize(sketches(docs, idf, id_col, text_col), "sketches")
    null_last = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"))
    worded = rows.where("bands is not null")
    classes = materialize(worded.groupBy("h").agg(F.min(null_last).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")), "classes")
    bands = materialize(classes.select("h", F.posexplode("bands").alias("i", "v")), "bands")
    centres = materialize(bands.groupBy("i", "v").agg(F.min(F.struct(_order("h", "i").alias("o"), "h")).alias("c"), F.count("*").alias("n")).where("n > 1").select("i", "v", "c.h"), "centres")
    members = bands.join(broadcast_if_small(centres.select("i", "v", F.col("h").alias("c"))), ["i", "v"])
    members = materialize(members, "members")
    wanted = members.select("h").distinct().join(classes.select("h", "first.id"), "h")
    wanted = materialize(wanted, "candidates")
    texts = docs.select(content(text_col).alias("h"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    wanted = broadcast_if_small(wanted.select(F.col("h").alias("_h"), F.col("id").alias("first")))
    texts = texts.join(wanted, (F.col("h") == F.col("_h")) & F.col("id").eqNullSafe(F.col("first")))  # by both: copies of a text lie apart
    texts = materialize(texts.groupBy("h").agg(F.first("t").alias("t")), "texts")

    tried = materialize(_distinct_pairs(members.select(F.col("h").alias("a"), F.col("c").alias("b"))), "pairs")
    links = materialize(verified(tried, texts, idf).select("a", "b"), "links")
    found, tagged = _labels(links, members.select("i", "v", "h"))
    for turn in range(ROUNDS + 1):
        apart = _apart(tagged)
        if not apart.limit(1).count():
            break
        if turn < ROUNDS:
            sizes = apart.groupBy("i", "v", "label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("h", "i", F.lit(turn + 7)).alias("o"), "h")).alias("pick"))
            main = sizes.groupBy("i", "v").agg(F.max(F.struct("n", "label", "pick")).alias("m")).select("i", "v", F.col("m.label").alias("main"), F.col("m.pick.h").alias("b"))
            main = materialize(main, "main")
            new = apart.join(broadcast_if_small(main), ["i", "v"]).where("label <> main").select(F.col("h").alias("a"), "b")
            new = materialize(_distinct_pairs(new).join(tried, ["a", "b"], "left_anti"), "pairs")
            more, tried = verified(new, texts, idf).select("a", "b"), tried.unionByName(new)
        else:
            more = block_links(apart, texts, idf)
        links = materialize(links.unionByName(more), "links")
        found, tagged = _labels(links, members.select("i", "v", "h"))

    merged = classes.select("h", "first", "n").join(broadcast_if_small(found), F.col("h") == F.col("node"), "left").select("h", "first", "n", F.coalesce("label", "h").alias("label"))
    merged = materialize(merged, "merged")
    groups = merged.groupBy("label").agg(F.min(F.struct(F.col("first.n").alias("n"), F.col("first.id").alias("id"), "h")).alias("rep"), F.sum("n").alias("n_class"))
    groups = materialize(groups, "groups")
    reps = merged.select("h", "label").join(broadcast_if_small(groups), "label").select("h", F.col("rep.id").alias("class_id"), F.col("rep.h").alias("class_h"), "n_class")
    reps = materialize(reps, "classes-of-texts")
    some = worded.select("doc_id", "h").join(reps, "h").select("doc_id", "h", "class_id", "class_h", "n_class", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))).alias("kept"))
    alone = rows.where("bands is null").select("doc_id", "h", F.col("doc_id").alias("class_id"), F.col("h").alias("class_h"), F.lit(1).cast("long").alias("n_class"), F.lit(True).alias("kept"))
    return some.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, and all rows without words; all own columns.

    Of identical rows (same id, same text) of a kept text one stays.
    """
    found = materialize(near_classes(docs, id_col, text_col), "near")
    names = docs.columns
    tag = [content(text_col).alias("_h"), F.col(id_col).cast("long").alias("_id")]
    gone = found.where("not kept").select(F.col("h").alias("_gh"), F.col("doc_id").alias("_gid")).distinct()
    gone = materialize(gone, "gone")
    twice = found.where("kept and n_class > 1").groupBy(F.col("h").alias("_th"), F.col("doc_id").alias("_tid")).agg(F.count("*").alias("n"))
    twice = materialize(twice.where("n > 1").select("_th", "_tid"), "twice")
    kept = docs.select(F.struct(*names).alias("_row"), *tag)
    in_gone = (F.col("_h") == F.col("_gh")) & F.col("_id").eqNullSafe(F.col("_gid"))
    in_twice = (F.col("_h") == F.col("_th")) & F.col("_id").eqNullSafe(F.col("_tid"))
    kept = kept.join(broadcast_if_small(gone), in_gone, "left_anti")
    if twice.limit(1).count():
        same = kept.join(broadcast_if_small(twice), in_twice, "left_semi").dropDuplicates(["_h", "_id"])
        kept = kept.join(broadcast_if_small(twice), in_twice, "left_anti").unionByName(same)
    return kept.select("_row.*")
