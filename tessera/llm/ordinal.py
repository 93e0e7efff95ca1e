"""Quality classifier: cumulative-link regression on graded ratings over hashed text.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector w for all grades and thresholds t_1 < t_2 < ...,
so the tails of a text are ordered. x holds, of every hashed word, word shape and layout token of the
text, log(1 + count), scaled to length 1. Training rows stay in the tasks: each step sums the gradients of
the tasks' blocks, and the driver keeps the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.exchange import LOWER_CODE, mix, unzip_arrays, word_hashes, zip_arrays
from tessera.llm.inputs import documents

DIMENSIONS = 1 << 15
#: Labelled rows that training reads at most, about: a larger table is thinned by a hash of doc_id.
SAMPLE_ROWS = 16_000
STEPS, RATE, RIDGE = 40, 0.3, 1e-4
BLOCK_BYTES = 400_000
BLOCK_TEXTS = 300

_CLASS = np.zeros((4, 256), np.int64)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_CLASS[3, 97:123] = 1
_CLASS[3, 128:] = 1


def _bins(x: np.ndarray, n: int) -> np.ndarray:
    return np.minimum((x * n).astype(np.int64), n - 1)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, value) of the hashed features of some texts, in order of row."""
    buffer = b"\n".join(texts)
    h, start, end = word_hashes(buffer, LOWER_CODE)
    size = np.array([len(t) for t in texts], np.int64)
    bounds = np.cumsum(size + 1) - size - 1
    row = np.searchsorted(bounds, start, side="right") - 1
    b = np.frombuffer(buffer, np.uint8)
    upper, digit, mark, lower = (np.r_[0, np.cumsum(c[b])] for c in _CLASS)
    upper, digit, mark, lower = (c[end] - c[start] for c in (upper, digit, mark, lower))
    case = np.where(upper == 0, 0, np.where(lower == 0, 2, 1))
    shape = ((case * 4 + np.minimum(digit, 3)) * 4 + np.minimum(mark, 3)) * 8 + np.minimum(end - start, 15) // 2
    n = np.bincount(row, minlength=len(texts))
    distinct = np.bincount(np.unique(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20)).view(np.int64) >> 44, minlength=len(texts))
    marks = np.bincount(row, mark, len(texts)) / np.maximum(size, 1)
    uppers = np.bincount(row, upper, len(texts)) / np.maximum(size, 1)
    layout = [np.minimum(np.log2(n + 1).astype(np.int64), 19), 20 + _bins(distinct / np.maximum(n, 1), 20), 40 + _bins(marks * 2, 20), 60 + _bins(uppers * 2, 20)]
    layout += [80 + _bins(np.array([len(set(p)) / len(p) for p in (t.split(b"\n") for t in texts)]), 20)]
    every = np.arange(len(texts))
    rows = np.concatenate([row, row, *[every] * len(layout)])
    codes = np.concatenate([h, mix(shape.astype(np.uint64) + np.uint64(1 << 40)), *(mix(x.astype(np.uint64) + np.uint64(1 << 41)) for x in layout)])
    key, count = np.unique(rows * DIMENSIONS + (codes % np.uint64(DIMENSIONS)).astype(np.int64), return_counts=True)
    rows, value = key // DIMENSIONS, np.log1p(count)
    value /= np.sqrt(np.bincount(rows, value * value, len(texts)))[rows]
    return rows, key % DIMENSIONS, value.astype(np.float32)


def tails(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k from 1 on, a column each."""
    return 1 / (1 + np.exp(-np.clip(margin[:, None] - thresholds, -500, 500)))


def gradient(rows: np.ndarray, dims: np.ndarray, values: np.ndarray, grades: np.ndarray, w: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss and gradients, by weights and thresholds, summed over the texts."""
    n = len(grades)
    tail = np.c_[np.ones(n), tails(np.bincount(rows, w[dims] * values, n), thresholds), np.zeros(n)]
    here, above = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
    p = np.maximum(here - above, 1e-12)
    slope_here, slope_above = here * (1 - here), above * (1 - above)
    by_margin = -(slope_here - slope_above) / p
    by_threshold = np.zeros((n, len(thresholds) + 2))
    by_threshold[np.arange(n), grades] += slope_here / p
    by_threshold[np.arange(n), grades + 1] -= slope_above / p
    return -float(np.log(p).sum()), np.bincount(dims, by_margin[rows] * values, DIMENSIONS), by_threshold[:, 1:-1].sum(0)


class Model:
    """Weights and ordered thresholds; apply() grades a DataFrame of texts."""

    def __init__(self, w: np.ndarray, thresholds: np.ndarray) -> None:
        self.w, self.thresholds = w, thresholds

    def apply(self, docs: DataFrame) -> DataFrame:
        """doc_id, expected_grade, tail_1, tail_2, ... of every row; docs has doc_id and text without nulls."""
        sent = docs.sparkSession.sparkContext.broadcast((self.w, self.thresholds))
        names = [f"tail_{k + 1}" for k in range(len(self.thresholds))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, thresholds = sent.value
            for batch in batches:
                for a in range(0, len(batch), BLOCK_TEXTS):
                    part = batch.iloc[a : a + BLOCK_TEXTS]
                    rows, dims, values = vectors([t.encode() for t in part["text"]])
                    tail = tails(np.bincount(rows, w[dims] * values, len(part)), thresholds)
                    out = pd.DataFrame(tail, columns=names).assign(doc_id=part["doc_id"].astype("Int64").to_numpy(), expected_grade=tail.sum(1))
                    yield out[["doc_id", "expected_grade", *names]]

        return docs.select("doc_id", "text").mapInPandas(run, ", ".join(["doc_id long, expected_grade double", *(f"{x} double" for x in names)]))


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most about sample_rows rated documents; ratings: doc_id, grade (0 to n_grades - 1).

    Rows with a null doc_id or a grade that is null or out of range are left out; of repeated ratings of a
    document the lowest counts. Without ratings all grades are as likely.
    """
    known = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, sample_rows / max(n, 1))))
    sample = known.where(share).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("int").alias("grade"))

    def featurize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), BLOCK_TEXTS):
                part = batch.iloc[a : a + BLOCK_TEXTS]
                rows, dims, values = vectors([t.encode() for t in part["text"]])
                yield pd.DataFrame({"block": [zip_arrays(rows.astype(np.int64), dims.astype(np.int64), values, part["grade"].to_numpy(np.int64))], "n": [len(part)]})

    blocks = materialize(documents(docs).join(F.broadcast(sample), "doc_id").mapInPandas(featurize, "block binary, n int"), "rated").coalesce(6)
    total = blocks.agg(F.sum("n")).first()[0] or 0
    w, start = np.zeros(DIMENSIONS), np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades)))
    steps = np.r_[start[0], np.log(np.diff(start))]  # t_1 and the logs of the distances: thresholds stay ordered
    seen_w, seen_s, mean_w, mean_s = (np.zeros_like(x) for x in (w, steps, w, steps))
    for t in range(1, STEPS + 1 if total else 1):
        thresholds = np.cumsum(np.r_[steps[0], np.exp(steps[1:])])
        sent = docs.sparkSession.sparkContext.broadcast((w, thresholds))

        def sums(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            w, thresholds = sent.value
            by_w, by_t = np.zeros(DIMENSIONS), np.zeros(len(thresholds))
            for batch in batches:
                for block in batch["block"]:
                    rows, dims, values, grades = (np.frombuffer(a, k) for a, k in zip(unzip_arrays(block), (np.int64, np.int64, np.float32, np.int64), strict=True))
                    _, g_w, g_t = gradient(rows, dims, values, grades, w, thresholds)
                    by_w += g_w
                    by_t += g_t
            yield pd.DataFrame({"w": [by_w.astype(np.float32).tobytes()], "t": [by_t.tobytes()]})

        parts = blocks.mapInPandas(sums, "w binary, t binary").collect()  # a row for each of a few tasks
        g_w = sum(np.frombuffer(r["w"], np.float32).astype(float) for r in parts) / total + RIDGE * w
        g_t = sum(np.frombuffer(r["t"], np.float64) for r in parts) / total
        back = np.cumsum(g_t[::-1])[::-1]
        g_s = back * np.r_[1.0, np.exp(steps[1:])]
        for x, g, mean, seen in ((w, g_w, mean_w, seen_w), (steps, g_s, mean_s, seen_s)):
            mean += 0.1 * (g - mean)
            seen += 0.05 * (g * g - seen)
            x -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(seen / (1 - 0.95**t)) + 1e-4)
    return Model(w, np.cumsum(np.r_[steps[0], np.exp(steps[1:])]))


def rating(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Three grades: 0 of low quality, 1 good but toxic, 2 good."""
    return F.when(F.col(quality) == 0, 0).when(F.col(toxic) == 1, 1).when((F.col(quality) == 1) & (F.col(toxic) == 0), 2)


def grade(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, level: int = 1, least: float = 0.5) -> DataFrame:
    """Per document: doc_id, expected_grade, tail_1 to tail_(n_grades - 1), selected (P(grade >= level) >= least).

    A null text is an empty one and is graded like any; repeated rows get a row each; a null doc_id is
    kept; an empty table gives no rows; other columns are ignored.
    """
    return train(docs, ratings, n_grades).apply(documents(docs)).withColumn("selected", F.col(f"tail_{level}") >= least)
