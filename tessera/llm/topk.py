"""Exact top-k inner-product search with a pivot table.

Inner products of integer vectors follow from distances: 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. The pivot table
holds every vector with its distances to PIVOTS pivots, computed once and written in the order of the nearest
pivot and the distance to it. By the triangle inequality the largest |d(q, p) - d(x, p)| bounds d(q, x) from
below, so it bounds the score from above: first for a run of rows, by the range of their distances to each
pivot, then for each row. Candidates are evaluated in the order of that bound until it falls under the k-th
best score: exact, ties included. A bounded sample gives every query a k-th best score to begin with.

Queries go in blocks of bounded size, each broadcast to one scan of the table: no row is copied for a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize

PIVOTS = 64
#: Vectors, beside the pivots, whose scores give the first k-th best one.
SEEDS = 2048
SCALE = 1024
#: Rows of the pivot table in a file, rows that are passed over together, and queries in a block, about.
FILE_ROWS = 8192
RUN = 512
BLOCK = 4096
#: Candidates evaluated at a time in bound order.
STEP = 128
#: Whole numbers under it are exact as float64.
EXACT = 2.0**53


def quantize(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component); vectors that are null or hold null, NaN or infinite ones go."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (
        vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))
    )


def _matrix(vectors: list, width: int, kind: type = np.float64) -> np.ndarray:
    out = np.zeros((len(vectors), width), kind)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Search:
    """The k best of a block of queries among the rows seen so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, seeds: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.to_pivots, self.square = _distances(q.astype(np.float64), pivots), (q.astype(np.float64) ** 2).sum(1)
        self.least, self.first = seeds.copy(), seeds
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, q.dtype))] * len(ids)
        self.pairs = self.evaluated = 0

    def _reach(self, low: np.ndarray, squares: np.ndarray | float, asked: np.ndarray) -> np.ndarray:
        """Scores that distances of at least `low` allow; rounding never loses a candidate."""
        q2 = self.square[asked] if low.ndim == 1 else self.square[asked][:, None]
        return (q2 + squares - low * low) / 2 + 2e-6 * (q2 + squares) + 1

    def see(self, ids: np.ndarray, x: np.ndarray, to_pivots: np.ndarray) -> None:
        """Compare all queries with a run of rows."""
        self.pairs += len(ids) * len(self.ids)
        squares = (x.astype(np.float64) ** 2).sum(1)
        gap = np.maximum(to_pivots.min(0) - self.to_pivots, self.to_pivots - to_pivots.max(0)).max(1, initial=0.0)
        asked = np.flatnonzero(self._reach(np.maximum(gap, 0), squares.max(), np.arange(len(self.ids))) >= self.least)
        if not len(asked):
            return
        low = np.zeros((len(asked), len(ids)))
        for p in range(to_pivots.shape[1]):
            np.maximum(low, np.abs(to_pivots[:, p] - self.to_pivots[asked, p][:, None]), out=low)
        high = self._reach(low, squares, asked)
        high[self.ids[asked][:, None] == ids] = -np.inf
        for row, i in enumerate(asked):
            open_ = np.flatnonzero(high[row] >= self.least[i])
            open_ = open_[high[row, open_] > -np.inf]
            open_ = open_[np.argsort(-high[row, open_], kind="stable")]
            for at in range(0, len(open_), STEP):
                part = open_[at : at + STEP]
                if high[row, part[0]] < self.least[i]:
                    break
                self.evaluated += len(part)
                score = x[part] @ self.q[i]
                keep = score >= self.least[i]
                if not keep.any():
                    continue
                own, best = np.r_[self.best[i][0], ids[part][keep]], np.r_[self.best[i][1], score[keep]]
                top = np.lexsort((own, -best))[: self.k]
                self.best[i] = own[top], best[top]
                if len(top) == self.k:
                    self.least[i] = max(self.least[i], float(best[top[-1]]))

    def found(self) -> pd.DataFrame:
        """query_id, vec_id, score of what may be among the best; and a row without query_id: pairs, pairs evaluated."""
        rows = [(int(q), int(v), int(s)) for q, (own, best) in zip(self.ids, self.best, strict=True) for v, s in zip(own, best, strict=True)]
        out = pd.DataFrame([*rows, (None, self.pairs, self.evaluated)], columns=["query_id", "vec_id", "score"])
        return out.astype("Int64")


def _seeds(ids: np.ndarray, q: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in the sample; minus infinity if it has fewer other vectors."""
    if len(sample_ids) < k + 1:
        return np.full(len(ids), -np.inf)
    score = q.astype(np.float64) @ sample.T.astype(np.float64)
    score[ids[:, None] == sample_ids] = -np.inf
    least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    return least - 1e-9 * np.abs(least)  # float products of very large numbers may round up


def pivot_table(table: DataFrame, pivots: np.ndarray, width: int, n: int) -> DataFrame:
    """vec_id, v, d (distance to every pivot), in the order of the nearest pivot and the distance to it."""
    sent = table.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d = _distances(_matrix(batch["v"], width), sent.value).astype(np.float32)
            near = d.argmin(1) if len(d) else np.empty(0, np.int64)
            yield batch.assign(d=list(d), cell=near, own=d[np.arange(len(d)), near])

    cells = table.mapInPandas(run, "vec_id long, v array<long>, d array<float>, cell int, own float")
    key = ["cell", "own", "vec_id"]  # the id splits many equal vectors
    return materialize(cells.repartitionByRange(max(1, -(-n // FILE_ROWS)), *key).sortWithinPartitions(*key).select("vec_id", "v", "d"), "pivots")


def _candidates(vectors: DataFrame, every: int, k: int, n_pivots: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each task's rows, and each task's count of pairs (see Search.found)."""
    spark = vectors.sparkSession
    table = quantize(vectors)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    n, width = size["n"], max(size["width"] or 0, 1)
    exact = width * float(size["most"] or 0) ** 2 < EXACT
    kind = np.float64 if exact else np.int64
    sample = table.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots + SEEDS).collect()  # bounded by both parameters
    sample_ids, sample = np.array([r["vec_id"] for r in sample], np.int64), _matrix([r["v"] for r in sample], width)
    pivots = sample[:n_pivots] if len(sample) else np.zeros((1, width))
    rows = pivot_table(table, pivots, width, n)
    blocks = max(1, -(-n // (every * BLOCK)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")), "queries")

    def search(sent) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q, pivots, seeds = sent.value
            search = Search(ids, q, pivots, seeds, k)
            for batch in batches:
                for a in range(0, len(batch), RUN):
                    part = batch.iloc[a : a + RUN]
                    search.see(part["vec_id"].to_numpy(np.int64), _matrix(part["v"], width, kind), np.stack(list(part["d"])).astype(np.float64))
            yield search.found()

        return materialize(rows.mapInPandas(run, "query_id long, vec_id long, score long"), "found")

    found = []
    for block in range(blocks):
        own = asked.where(F.col("block") == block).orderBy("vec_id").collect()  # BLOCK queries, about
        ids, q = np.array([r["vec_id"] for r in own], np.int64), _matrix([r["v"] for r in own], width, kind)
        if len(ids):
            found.append(search(spark.sparkContext.broadcast((ids, q, pivots, _seeds(ids, q, sample_ids, sample, k)))))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, n_pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query, ties to smaller vec_id.

    Queries: vectors whose vec_id is divisible by `every`; candidates: all but those of the query's own
    vec_id. Fewer candidates give fewer rows; an empty table gives none. Missing components of shorter
    vectors count as 0. Repeated rows are candidates each, but a repeated query counts once, with its smallest
    vector. Scores are exact up to 64-bit integers, which a larger product overflows. Other columns are ignored.
    """
    found = _candidates(vectors, every, k, n_pivots).where("query_id is not null")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, every: int = 100, k: int = 10, n_pivots: int = PIVOTS) -> float:
    """The share of all pairs of query and row whose score had to be computed."""
    row = _candidates(vectors, every, k, n_pivots).where("query_id is null").agg(F.sum("vec_id"), F.sum("score")).first()
    return (row[1] or 0) / (row[0] or 1)
