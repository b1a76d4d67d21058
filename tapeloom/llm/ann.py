"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors of length one are projected by a few Gaussian (2-stable) directions, so that squared projected distances over
squared distances follow a chi-square law. The projections are indexed by a kd-tree: its upper levels, cut at medians of a
sample, deal the vectors into blocks; the lower ones are built within each block. A query meets leaves in the order of
projected distance and verifies their vectors exactly, until the chi-square test says that an unseen vector nearer than
the k-th found would, with probability `confidence`, have been projected nearer.

Every vector is indexed. A query searches the block it falls into; then only those other blocks whose cells the same test,
with what the first search found, leaves possible. The best of all are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import stash

#: Vectors of an index block (64 floats each: 17 MB), and blocks at least, so that small tables use several cores too.
BLOCK_ROWS, LEAST_BLOCKS = 65_536, 8
#: Vectors of each length, in an order by hash, whose medians divide the blocks; they come to the driver (64 floats each: 10 MB).
SAMPLE = 20_000
LEAF = 48
DIRECTIONS = 8
CONFIDENCE = 0.7


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """Distribution function of the chi-square law for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float), 1e4) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(np.array(mid), freedom) < p else (lo, mid)
    return hi


def axes(dim: int, directions: int = DIRECTIONS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, directions))


def project(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Projections of vectors, made one long."""
    v = vectors.astype(np.float64)
    return (v / np.sqrt((v * v).sum(axis=1))[:, None]) @ directions


class Cells:
    """The upper levels of the kd-tree: a cell for each block."""

    def __init__(self, sample: np.ndarray, blocks: int):
        m = sample.shape[1]
        low, high = [np.full(m, -np.inf)], [np.full(m, np.inf)]
        parts = [sample]
        self.axis, self.cut = [], []  # level by level
        while len(parts) < blocks:
            next_parts, next_low, next_high = [], [], []
            axis, cut = [], []
            for x, lo, hi in zip(parts, low, high, strict=True):
                k = int(np.ptp(x, axis=0).argmax()) if len(x) > 1 else 0
                c = float(np.median(x[:, k])) if len(x) else 0.0
                axis.append(k)
                cut.append(c)
                below, above = hi.copy(), lo.copy()
                below[k], above[k] = min(hi[k], c), max(lo[k], c)
                next_parts += [x[x[:, k] < c], x[x[:, k] >= c]]
                next_low += [lo, above]
                next_high += [below, hi]
            parts, low, high = next_parts, next_low, next_high
            self.axis.append(np.array(axis))
            self.cut.append(np.array(cut))
        self.low, self.high = np.array(low), np.array(high)

    def locate(self, p: np.ndarray) -> np.ndarray:
        at = np.zeros(len(p), dtype=np.int64)
        for axis, cut in zip(self.axis, self.cut, strict=True):
            at = 2 * at + (p[np.arange(len(p)), axis[at]] >= cut[at])
        return at

    def bounds(self, p: np.ndarray) -> np.ndarray:
        """The least squared projected distance from each point to each cell."""
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        return np.einsum("qcd,qcd->qc", gap, gap)


class Index:
    """A kd-tree over the projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: int = DIRECTIONS, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order].astype(np.float64)
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.axes = axes(vectors.shape[1], directions, seed)
        p = (self.raw / self.norm[:, None]) @ self.axes
        leaves, todo = [], [np.arange(len(ids))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                leaves.append(rows)
                continue
            axis = int(np.ptp(p[rows], axis=0).argmax())
            half = len(rows) // 2
            cut = np.argpartition(p[rows, axis], half)
            todo += [rows[cut[half:]], rows[cut[:half]]]
        self.leaf = np.full((len(leaves), LEAF), -1, dtype=np.int64)
        self.low, self.high = (np.empty((len(leaves), directions)) for _ in range(2))
        for i, rows in enumerate(leaves):
            self.leaf[i, : len(rows)] = rows
            self.low[i], self.high[i] = p[rows].min(axis=0), p[rows].max(axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, confidence: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the query, id, cosine) of the k best of each query, its own id left out; known: the k-th best cosine found elsewhere."""
        q = queries.astype(np.float64)
        q_norm = np.sqrt((q * q).sum(axis=1))
        p = (q / q_norm[:, None]) @ self.axes
        gap = np.maximum(np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]), 0)
        bound = np.einsum("qld,qld->ql", gap, gap)
        order = np.argsort(bound, axis=1, kind="stable")
        reach = chi_square_quantile(confidence, self.axes.shape[1])
        best = np.full((len(q), k), -np.inf)
        best_row = np.full((len(q), k), -1, dtype=np.int64)
        active = np.arange(len(q))
        known = np.full(len(q), -np.inf) if known is None else known
        for t in range(order.shape[1]):
            leaf = order[active, t]
            far = np.maximum(2 - 2 * np.maximum(best[active, -1], known[active]), 0)  # squared distance of the k-th found, of unit vectors
            go = ~(bound[active, leaf] > reach * far)
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            rows = self.leaf[leaf]
            score = (self.raw[rows] * q[active][:, None, :]).sum(axis=2) / (self.norm[rows] * q_norm[active][:, None])
            score[(rows < 0) | (self.ids[rows] == query_ids[active][:, None])] = -np.inf
            every = np.concatenate([best[active], score], axis=1)
            row = np.concatenate([best_row[active], np.where(np.isfinite(score), rows, -1)], axis=1)
            keep = np.lexsort((np.where(row < 0, np.iinfo(np.int64).max, row), -every))[:, :k]  # rows are in order of ids
            best[active] = np.take_along_axis(every, keep, axis=1)
            best_row[active] = np.take_along_axis(row, keep, axis=1)
        at, place = np.nonzero(best_row >= 0)
        return at, self.ids[best_row[at, place]], best[at, place]


def usable(vector: str) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _searcher(k: int, confidence: float):
    def run(batches):
        index, key, ids, rows = None, None, [], []
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "kind")], axis=1)
            cuts = np.flatnonzero((block[1:] != block[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                here, kind = tuple(block[a, :2]), block[a, 2]
                if here != key:
                    index, key, ids, rows = None, here, [], []
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                vectors = _matrix(part.column("vector"), len(own))
                if kind == 0:
                    ids.append(own)
                    rows.append(vectors)
                    continue
                if not ids and index is None:
                    continue
                if index is None:
                    index = Index(np.concatenate(ids), np.concatenate(rows))
                    ids, rows = [], []
                known = part.column("known").to_numpy(zero_copy_only=False)
                for s in range(0, len(own), 256):
                    at, found, score = index.search(own[s : s + 256], vectors[s : s + 256], k, confidence, known[s : s + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(own[s : s + 256][at]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _by_dim(batch: pa.RecordBatch):
    """Parts of a batch whose vectors are of one length."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", confidence: float = CONFIDENCE, block_rows: int = BLOCK_ROWS, sample: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row that is_query marks, by cosine, ties to smaller ids.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id. Vectors are
    compared with those of the same length. Of equal vectors only the k + 1 of the smallest ids can be among a query's k
    nearest, so the rest isn't indexed; rows that repeat id and vector count once. A query with fewer than k candidates gets
    all of them. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    same = Window.partitionBy("vector").orderBy("vec_id")
    candidates = good.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1).select("vec_id", "vector", F.lit(True).alias("indexed"), F.lit(False).alias("asks"))
    queries = good.where("is_query").select("vec_id", "vector", F.lit(False).alias("indexed"), F.lit(True).alias("asks"))
    both = candidates.unionByName(queries).groupBy("vec_id", "vector").agg(F.max("indexed").alias("indexed"), F.max("asks").alias("asks"))
    base = stash(both.withColumn("dim", F.size("vector")), "vectors")
    count = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one number for each length
    cells = {}
    for d, n in count.items():
        got = base.where(F.col("dim") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow().column("vector").combine_chunks()
        blocks = 1 << max(0, int(np.ceil(np.log2(max(LEAST_BLOCKS, -(-n // block_rows))))))
        cells[d] = Cells(project(_matrix(got, len(got)), axes(d)), blocks)
    sent = spark.sparkContext.broadcast(cells)
    reach = chi_square_quantile(confidence, DIRECTIONS)

    def placed(batches):
        for batch in batches:
            for d, part in _by_dim(batch):
                block = sent.value[d].locate(project(_matrix(part.column("vector"), part.num_rows), axes(d)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(block.astype(np.int32))], names=[*part.schema.names, "block"])

    def others(batches):
        for batch in batches:
            for d, whole in _by_dim(batch):
                for s in range(0, whole.num_rows, 256):
                    part = whole.slice(s, 256)
                    known = part.column("known").to_numpy(zero_copy_only=False)
                    bound = sent.value[d].bounds(project(_matrix(part.column("vector"), part.num_rows), axes(d)))
                    go = bound <= (reach * np.maximum(2 - 2 * known, 0))[:, None]
                    go[np.arange(len(go)), part.column("block").to_numpy(zero_copy_only=False)] = False
                    row, block = np.nonzero(go)
                    part = part.take(pa.array(row))
                    yield part.set_column(part.schema.get_field_index("block"), "block", pa.array(block.astype(np.int32)))

    schema = "vec_id long, vector array<double>, indexed boolean, asks boolean, dim int"
    there = stash(base.select("vec_id", "vector", "indexed", "asks", "dim").mapInArrow(placed, f"{schema}, block int"), "placed")
    one = there.where("indexed").select("dim", "block", F.lit(0).alias("kind"), "vec_id", "vector", F.lit(float("-inf")).alias("known"))
    columns = ("dim", "block", "kind", "vec_id", "vector", "known")

    def search(asked: DataFrame, blocks: DataFrame) -> DataFrame:
        dealt = blocks.unionByName(asked.withColumn("kind", F.lit(1)).select(*columns)).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind")
        return dealt.mapInArrow(_searcher(k, confidence), "query_id long, vec_id long, score double")

    asked = there.where("asks")
    first = stash(search(asked.withColumn("known", F.lit(float("-inf"))), one), "first")
    kth = first.distinct().groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("known")).where(F.col("n") >= k).select("vec_id", "known")
    more = asked.join(kth, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf")))).select("vec_id", "vector", "dim", "block", "known")
    more = stash(more.mapInArrow(others, "vec_id long, vector array<double>, dim int, block int, known double"), "more")
    wanted = more.select("dim", "block").distinct()
    second = search(more, one.join(F.broadcast(wanted), ["dim", "block"], "left_semi"))  # a row for each block at most
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(second).distinct()
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
