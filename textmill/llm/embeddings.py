"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the (unit-length) vectors, make a grid of K x K cells; all vectors are stored in the
shared folder as inverted lists sorted by cell. A vector visits cells in the order of its distance to their centroid
pairs (multi-sequence traversal over two sorted lists) until the slack over its own cell exceeds a bound that was set for a
target recall: on the true neighbours that a bounded set of query vectors has among all vectors (brute force, in blocks),
and on made neighbours with cosines from the threshold to 1, so that rare loose pairs count too. Cells that
any member visits are compared whole, in both directions, by exact cosine in double precision.

Equal vectors are one class with a count, so copies cost nothing. A large cell is compared in blocks; a block gives
counts and a spanning forest of its links, never its pairs.

Vectors are compared with those of their own dimension only; each dimension has its own grid, with as many codes as give PER_CELL
vectors a cell, up to MAX_CODES (so a dimension of about two cells' vectors is one cell). Grids are fitted on at most TRAIN vectors, or
CODE_TRAIN for each code, and the bound on QUERIES of them against all; every vector is indexed. `recall` measures the links of every
vector whose id is divisible by 100 against brute force. The directory of the lists is a table that the work is
joined with; what the driver holds are the codebooks.

Defined cases: a null or empty vector, one with null or non-finite components and a zero vector link with nothing: n_links 0, its own
id as component, kept. Repeated rows are linked to one another. A null id never is a component's smallest id unless
all are null. Empty table: no rows. Labels and other columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid
from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected as components
from .common import broadcast_if_small, fresh_path, materialize, open_fs

THRESHOLD = 0.9
TARGET_RECALL = 0.99
#: Share of made neighbours, with cosines spread from the threshold to 1, whose cell must be visited.
TARGET_MADE = 0.97
TRAIN, CODE_TRAIN = 20_000, 20
QUERIES = 256
PER_CELL = 64
MAX_CODES = 4096
#: Cells of one dimension are numbered below this; the dimension is in the digits above.
CELLS = 1 << 32
BLOCK = 1024
CACHE_BYTES = 48 << 20
SLACKS = 4000


def kmeans(x, k: int, seed: int = 3, rounds: int = 12):
    """Centroids of Lloyd's rounds from a seeded choice of distinct rows."""
    import numpy as np

    u = np.unique(x, axis=0)
    k = max(1, min(k, len(u)))
    c = u[np.random.default_rng(seed).permutation(len(u))[:k]].copy()
    for _ in range(rounds):
        near = (np.sum(c * c, 1)[None, :] - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((k, 0))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def multi_sequence(d1, d2, bound: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending order of d1[i] + d2[j], while that is at most ``bound``."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        d, a, b = heapq.heappop(heap)
        if d > bound:
            return
        yield int(o1[a]), int(o2[b])
        for n in ((a + 1, b), (a, b + 1)):
            if n[0] < len(o1) and n[1] < len(o2) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (d1[o1[n[0]]] + d2[o2[n[1]]], *n))


class Grid:
    """Two codebooks over the halves of unit vectors."""

    def __init__(self, sample, codes: int):
        self.half = max(1, sample.shape[1] // 2)
        self.c1, self.c2 = kmeans(sample[:, : self.half], codes), kmeans(sample[:, self.half :], codes)

    def distances(self, x):
        import numpy as np

        a, b = x[:, : self.half], x[:, self.half :]
        far = lambda v, c: np.sum(v * v, 1)[:, None] + np.sum(c * c, 1)[None, :] - 2 * v @ c.T
        return far(a, self.c1), far(b, self.c2)

    def cells(self, x):
        d1, d2 = self.distances(x)
        return d1.argmin(1) * len(self.c2) + d2.argmin(1)

    def slack(self, x, y):
        """How far beyond its own cell each row of x has to go to visit the cell of the same row of y."""
        import numpy as np

        (d1, d2), cell, row = self.distances(x), self.cells(y), np.arange(len(x))
        return d1[row, cell // len(self.c2)] - d1.min(1) + d2[row, cell % len(self.c2)] - d2.min(1)


def _matrix(column):
    import numpy as np

    flat = column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(x):
    import numpy as np

    return x / np.sqrt(np.sum(x * x, axis=1))[:, None]


def _slack_bound(classes: DataFrame, grid: Grid, queries, threshold: float) -> float:
    """Slack that reaches TARGET_RECALL of the queries' true neighbours, and TARGET_MADE of made ones."""
    import numpy as np
    import pyarrow as pa

    top = 8.0

    def run(batches: Iterator) -> Iterator:
        total = np.zeros(SLACKS, np.int64)
        for b in batches:
            y = unit(_matrix(b["v"]))
            for a in range(0, len(y), 4096):
                near = np.stack(np.nonzero(queries @ y[a : a + 4096].T >= threshold))
                for p in range(0, near.shape[1], 8192):
                    q, k = near[:, p : p + 8192]
                    s = np.clip(grid.slack(queries[q], y[a : a + 4096][k]), 0, top - 1e-9)
                    total += np.bincount((s / top * SLACKS).astype(np.int64), minlength=SLACKS)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["s", "n"])

    found = classes.select("v").mapInArrow(run, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    hist = np.zeros(SLACKS)
    for r in found:
        hist[r.s] = r.n
    r = np.random.default_rng(7)
    x = np.repeat(queries, 8, axis=0)
    cos = r.uniform(threshold, 1, len(x))[:, None]
    u = r.normal(size=x.shape)
    u -= np.sum(u * x, 1)[:, None] * x
    y = cos * x + np.sqrt(1 - cos * cos) * u / np.maximum(np.sqrt(np.sum(u * u, 1)), 1e-12)[:, None]
    made = float(np.quantile(grid.slack(x, unit(y)), TARGET_MADE))
    true = (np.searchsorted(np.cumsum(hist), TARGET_RECALL * hist.sum()) + 1) * top / SLACKS if hist.sum() else 0.0
    return max(made, true) + 1e-9


def _by_dimension(column) -> Iterator[tuple[int, object, object]]:
    """(dimension, places in the batch, unit vectors) of a batch of lists."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, unit(_matrix(column.take(at) if len(at) < len(sizes) else column))


def _write_lists(classes: DataFrame, grids, root: str, lists: int) -> DataFrame:
    """Inverted lists below ``root`` in cell order; returns the committed directory (cell, file, at, n), at in bytes."""
    import numpy as np
    import pyarrow as pa

    def assign(batches: Iterator) -> Iterator:
        known = grids.value
        for b in batches:
            cell = np.zeros(b.num_rows, np.int64)
            for d, at, x in _by_dimension(b["v"]):
                cell[at] = d * CELLS + (known[d][0].cells(x) if d in known else 0)
            yield pa.record_batch([pa.array(cell), b["cid"], b["n"], b["v"]], names=["cell", "cid", "n", "v"])

    dealt = classes.mapInArrow(assign, "cell long, cid long, n long, v array<double>").repartitionByRange(lists, "cell", "cid").sortWithinPartitions("cell", "cid")

    def write(batches: Iterator) -> Iterator:
        out, name, at, rows = None, "", 0, []
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs, base = open_fs(root)
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.list"
                out = fs.open_output_stream(f"{base}/{name}")
            cells = b["cell"].to_numpy()
            edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = b.slice(begin, end - begin)
                rec = np.concatenate([part[c].to_numpy().view(np.float64)[:, None] for c in ("cid", "n")] + [_matrix(part["v"])], axis=1)
                data = np.ascontiguousarray(rec).tobytes()
                out.write(data)
                rows.append((int(cells[begin]), name, at, end - begin))
                at += len(data)
        if out is not None:
            out.close()
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["cell", "file", "at", "n"])

    return materialize(dealt.mapInArrow(write, "cell long, file string, at long, n long"), "directory")


class Lists:
    """Reads inverted lists by byte range; keeps the last CACHE_BYTES of unit vectors."""

    def __init__(self, root: str):
        self.fs, self.base = open_fs(root)
        self.cache, self.held = OrderedDict(), 0

    def part(self, cell: int, parts: list, low: int, high: int):
        """(cid, n, unit vectors) of the members low..high of a cell; ``parts``: its directory rows (file, at, n)."""
        import numpy as np

        key = (cell, low, high)
        if key in self.cache:
            self.cache.move_to_end(key)
            return self.cache[key]
        width = cell // CELLS + 2
        chunks, seen, size = [], 0, 8 * width
        for p in parts:
            a, b = max(low, seen), min(high, seen + p["n"])
            if a < b:
                with self.fs.open_input_file(f"{self.base}/{p['file']}") as f:
                    f.seek(p["at"] + (a - seen) * size)
                    chunks.append(np.frombuffer(f.read((b - a) * size), np.float64).reshape(-1, width))
            seen += p["n"]
        rec = np.concatenate(chunks)
        got = (np.ascontiguousarray(rec[:, 0]).view(np.int64), np.ascontiguousarray(rec[:, 1]).view(np.int64), unit(rec[:, 2:]))
        self.cache[key], self.held = got, self.held + got[2].nbytes
        while self.held > CACHE_BYTES and len(self.cache) > 1:
            self.held -= self.cache.popitem(last=False)[1][2].nbytes
        return got


def forest(links, qa, qb):
    """Edges (a, b) that connect what a block's links connect. links[i, j]: qa[i] and qb[j] are linked."""
    import numpy as np

    i, j = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    m = links[np.ix_(i, j)]
    nodes = np.unique(np.concatenate([qa[i], qb[j]]))
    label = np.arange(len(nodes))
    pi, pj = np.searchsorted(nodes, qa[i]), np.searchsorted(nodes, qb[j])
    while True:
        old = label.copy()
        big = len(nodes)
        np.minimum.at(label, pi, np.where(m, label[pj][None, :], big).min(1))
        np.minimum.at(label, pj, np.where(m, label[pi][:, None], big).min(0))
        if np.array_equal(old, label):
            keep = label != np.arange(len(nodes))
            return nodes[keep], nodes[label[keep]]


def _codes(count: int) -> int:
    """Codes of each half for so many distinct vectors."""
    return max(1, min(MAX_CODES, round((count / PER_CELL) ** 0.5)))


def _fitted(classes: DataFrame, count: int, threshold: float) -> tuple[Grid, float]:
    """Grid and slack bound of the vectors of one dimension."""
    codes = _codes(count)
    sample = classes.select("v", F.xxhash64("v").alias("o")).orderBy("o", "v").limit(max(TRAIN, CODE_TRAIN * codes)).select("v").toArrow()
    sample = unit(_matrix(sample["v"].combine_chunks()))
    grid = Grid(sample, codes)
    return grid, _slack_bound(classes, grid, sample[:QUERIES], threshold)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    alone = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(fine)
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("cid"), "v", "first", "n"), "vector-classes")
    sizes = {r.d: r.n for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a dimension
    if not sizes:
        return alone
    count = sum(sizes.values())
    grids = spark.sparkContext.broadcast({d: _fitted(classes.where(F.size("v") == d), n, threshold) for d, n in sizes.items() if _codes(n) > 1})

    root = fresh_path(spark, "lists")
    directory = _write_lists(classes.select("cid", "n", "v"), grids, root, max(1, min(512, count // 4096)))
    directory = directory.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("file", "at", "n"))).alias("parts"), F.sum("n").alias("size"))
    directory = materialize(directory, "cells")

    def visits(batches: Iterator) -> Iterator:
        known = grids.value
        pairs = set()
        for b in batches:
            for dim, _, x in _by_dimension(b["v"]):
                if dim not in known:
                    pairs.add((dim * CELLS, dim * CELLS))
                    continue
                (grid, bound), first = known[dim], dim * CELLS
                width = len(grid.c2)
                for a in range(0, len(x), 2048):
                    d1, d2 = grid.distances(x[a : a + 2048])
                    for p, q in zip(d1, d2, strict=True):
                        own = first + int(p.argmin()) * width + int(q.argmin())
                        for i, j in multi_sequence(p, q, p.min() + q.min() + bound):
                            other = first + i * width + j
                            pairs.add((own, other) if own <= other else (other, own))
        got = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        yield pa.record_batch([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    pairs = materialize(classes.select("v").mapInArrow(visits, "a long, b long").distinct(), "cell-pairs")
    both = pairs.union(pairs.select("b", "a").where("a <> b"))
    lists_of = lambda c: directory.select(F.col("cell").alias(c), F.col("parts").alias(f"{c}_parts"), F.col("size").alias(f"{c}_size"))
    work = both.join(lists_of("b"), "b").groupBy("a").agg(F.collect_list(F.struct("b", "b_parts", "b_size")).alias("visit")).join(lists_of("a"), "a")
    work = work.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("a_size") / BLOCK) - 1)))
    work = work.repartition(max(spark.sparkContext.defaultParallelism, min(4096, count // 512)), "a", "block")

    def compare(batches: Iterator) -> Iterator:
        lists = Lists(root)
        for b in batches:
            for r in b.to_pylist():
                k = r["block"]
                qa, na, x = lists.part(r["a"], r["a_parts"], k * BLOCK, min(r["a_size"], (k + 1) * BLOCK))
                linked, ea, eb = na - 1, [], []
                for c in sorted(r["visit"], key=lambda c: c["b"]):
                    for at in range(0, c["b_size"], BLOCK):
                        qb, nb, y = lists.part(c["b"], c["b_parts"], at, min(c["b_size"], at + BLOCK))
                        m = x @ y.T >= threshold
                        m[qa[:, None] == qb[None, :]] = False
                        if m.any():
                            linked = linked + m @ nb
                            p, q = forest(m, qa, qb)
                            ea.append(p)
                            eb.append(q)
                cid = np.concatenate([qa, *ea])
                link = np.concatenate([linked, *[np.full(len(e), -1) for e in ea]])
                to = np.concatenate([qa, *eb])
                yield pa.record_batch([pa.array(cid), pa.array(link), pa.array(to)], names=["cid", "n_links", "other"])

    found = materialize(work.mapInArrow(compare, "cid long, n_links long, other long"), "vector-links")
    labels = components(found.where("n_links < 0").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    per_class = classes.join(found.where("n_links >= 0").select("cid", "n_links"), "cid").join(broadcast_if_small(labels), F.col("cid") == F.col("node"), "left")
    per_class = materialize(per_class.select("cid", "v", "first", "n_links", F.coalesce("label", "cid").alias("label")), "labelled")
    least = materialize(per_class.groupBy("label").agg(F.min("first").alias("component_id")), "least")
    result = materialize(per_class.join(broadcast_if_small(least), "label").select("v", "n_links", "component_id"), "vector-result")
    joined = rows.join(result, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.unionByName(alone)


def recall(vectors: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row (queries, true_links, found_links): links of the vectors whose id is divisible by ``every``, by brute force against all
    vectors and in ``found`` (rows of `near_vectors`). Queries go to all vectors in blocks; a task holds one block and one batch."""
    import numpy as np
    import pyarrow as pa

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.where(fine)
    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("d"))
    block = F.floor(F.row_number().over(Window.partitionBy("d", F.pmod(F.xxhash64("vec_id", "v"), F.lit(64))).orderBy("vec_id")) / BLOCK)
    asked = asked.withColumn("b", F.concat_ws("/", "d", F.pmod(F.xxhash64("vec_id", "v"), F.lit(64)), block))
    blocks = asked.groupBy("b", "d").agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))  # at most BLOCK each
    parts = rows.select("v", F.size("v").alias("d"), F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() % (1 << 33) / BLOCK).alias("k"))
    parts = parts.groupBy("d", "p", "k").agg(F.collect_list("v").alias("all"))

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            ids, n = [], []
            for q, y in zip(b["asked"], b["all"], strict=True):
                q = q.as_py()
                x = unit(np.array([r["v"] for r in q], np.float64))
                hits = (x @ unit(np.array(y.as_py(), np.float64)).T >= threshold).sum(1)
                ids += [r["vec_id"] for r in q]
                n += hits.tolist()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["vec_id", "n"])

    true = parts.join(broadcast_if_small(blocks), "d").mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("true_links"))
    both = true.join(found.select("vec_id", "n_links").groupBy("vec_id").agg(F.max("n_links").alias("found")), "vec_id")
    return both.agg(F.count("*").alias("queries"), F.coalesce(F.sum("true_links"), F.lit(0)).alias("true_links"), F.coalesce(F.sum("found"), F.lit(0)).alias("found_links"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(least(a, b)) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
