"""Exact top-k by inner product over a pivot-distance index.

Vectors become integers, floor(scale * x). One more component, sqrt(M - |x|^2) with M the largest
squared norm, gives all of them the same length, so that the largest inner product is the
smallest distance: d(q, x)^2 = |q|^2 + M - 2 q.x. Every vector is keyed by its nearest pivot and
its distance r to it, and the index is sorted by that key; a run of neighbours in it is an
annulus. By the triangle inequality no vector of an annulus [r0, r1] around p is nearer to q than
max(r0 - d(q,p), d(q,p) - r1). A query takes the annuli in the order of this bound, outward from
its own distance, and stops when the bound cannot reach its k-th best score.

Queries are a stated set and go to the workers in blocks of bounded size, each against the whole
index. Pivots are drawn from a bounded sample; every vector is indexed and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spindlewatch.session import stage

SCALE = 256
PIVOTS = 64
QUERY_BYTES = 16 << 20
RING = 512
NONE = -(1 << 62)  # below every score
EXACT = 2.0 ** 52  # scores below are whole in doubles
SLACK = 1e-6  # of the squared norms, for rounding in the bounds: distances are roots of differences


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): one row per id, v the integer vector.

    Null ids and vectors that are null, empty, or hold a null or non-finite component take no
    part. Of several vectors under one id the smallest counts; repeated rows are one.
    """
    def whole(x: Column) -> Column:
        return F.floor(x.cast("double") * F.lit(float(scale))).cast("long")

    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.filter(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & finite)
            .groupBy(F.col(vec_id).cast("long").alias("vec_id"))
            .agg(F.min(F.transform(vector, whole)).alias("v")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of b to rows of a."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))])


def index(held: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, float]:
    """The staged index (pivot, distance, vec_id, v), its lifted pivots, and M.

    Pivots are the `pivots` vectors whose ids hash lowest. The index is range-partitioned by
    (pivot, distance, vec_id), so vectors that are all alike still spread over partitions.
    """
    stats = held.agg(
        F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("most")).first()
    width, most = stats["width"] or 0, stats["most"] or 0.0
    if most >= -NONE:
        raise ValueError("scores do not fit 64-bit integers: scale the vectors down")
    drawn = held.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    points = np.zeros((len(drawn), width))
    for i, row in enumerate(drawn):
        points[i, :len(row["v"])] = row["v"]
    centres = _lift(points, most)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distance(_lift(_matrix(batch.column("v"), width), most), centres)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near]),
                 batch.column("vec_id"), batch.column("v")],
                names=["pivot", "distance", "vec_id", "v"])

    keyed = held.mapInArrow(key, "pivot int, distance double, vec_id long, v array<long>")
    keyed = stage(keyed, "keyed-vectors")
    sorted_ = (keyed.repartitionByRange("pivot", "distance", "vec_id")
               .sortWithinPartitions("pivot", "distance", "vec_id"))
    return stage(sorted_, "pivot-index"), centres, most


class _Best:
    """The k best (score, id) of every query so far; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # all that could be among the first k, ties included
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            floor = np.maximum(kth, self.score[rows, -1])
            keep = (score >= floor[:, None]).any(axis=0)
            score, ids = score[:, keep], ids[keep]
        all_score = np.concatenate([self.score[rows], score], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((all_ids, -all_score), axis=1)[:, :k]
        self.score[rows] = np.take_along_axis(all_score, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def _scores(q: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers, exact below 2^62: in 64-bit integers where doubles would round."""
    if most < EXACT:
        return np.rint(q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.T.astype(np.int64)


def _search(ids: np.ndarray, q: np.ndarray, centres: np.ndarray, most: float, k: int):
    width = q.shape[1]
    square = (q * q).sum(1)
    to_pivot = _distance(np.column_stack([q, np.zeros(len(q))]), centres)
    # The pivots are vectors too: their scores, the query itself aside, start the k-th best.
    own = q @ centres[:, :-1].T
    seed = np.full(len(q), -np.inf)
    if len(centres) > k:  # one of the pivots may be the query itself
        seed = np.sort(own, axis=1)[:, -(k + 1)]

    def rings(pivot: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero(np.diff(pivot)) + 1
        starts = np.concatenate([[0], edge])
        ends = np.concatenate([edge, [len(pivot)]])
        return np.concatenate([np.arange(s, e, RING) for s, e in zip(starts, ends)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(q), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot = batch.column("pivot").to_numpy()
            r = batch.column("distance").to_numpy()
            names = batch.column("vec_id").to_numpy()
            v = _matrix(batch.column("v"), width)
            first = rings(pivot)
            last = np.append(first[1:], len(pivot))
            d = to_pivot[:, pivot[first]]
            bound = np.maximum(np.maximum(r[first] - d, d - r[last - 1]), 0)
            # The largest score that the bound leaves open, with room for rounding.
            reach = (square[:, None] + most - bound ** 2) / 2
            reach += SLACK * (square[:, None] + most) + 0.25
            order = np.argsort(-reach, axis=1, kind="stable")
            live = np.arange(len(q))
            for turn in range(len(first)):
                ring = order[live, turn]
                kth = np.maximum(best.score[live, -1], seed[live])
                live, ring = (x[reach[live, ring] >= kth] for x in (live, ring))
                if not len(live):
                    break
                for one in np.unique(ring):
                    rows, at = live[ring == one], slice(first[one], last[one])
                    score = _scores(q[rows], v[at], most)
                    score[ids[rows][:, None] == names[at][None, :]] = NONE
                    best.offer(rows, score, names[at])
        row, place = np.nonzero(best.score > NONE)
        if len(row):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(best.ids[row, place]), pa.array(best.score[row, place])],
                names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id",
          vector: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS,
          query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query.

    is_query is a condition on `vec_id`. Ties go to the smaller id; a query with fewer than k
    others gets them all. Vectors of unequal length are compared as if padded with zeros. Rows
    that cannot take part and repeated ids are treated as `integer_vectors` says. An empty table
    has no result. Scores are exact; a ValueError tells that a squared norm of 2^62 or more, whose
    scores a long may not hold, is among the integer vectors.
    """
    held = stage(integer_vectors(vectors, vec_id, vector, scale), "integer-vectors")
    spark = vectors.sparkSession
    ring, centres, most = index(held, pivots)
    width = max(centres.shape[1] - 1, 1)
    queries = held.filter(is_query)
    parts = [ring.mapInArrow(_search(ids, q, centres, most, k),
                             "query_id long, vec_id long, score long")
             for ids, q in _query_blocks(queries, width, max(1, query_bytes // (8 * width)))]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (reduce(DataFrame.union, parts)
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _query_blocks(queries: DataFrame, width: int, size: int) -> Iterator[tuple]:
    rows: list = []

    def block():
        q = np.zeros((len(rows), width))
        for i, row in enumerate(rows):
            q[i, :len(row["v"])] = row["v"]
        return np.array([r["vec_id"] for r in rows], np.int64), q

    for row in queries.toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield block()
            rows = []
    if rows:
        yield block()
