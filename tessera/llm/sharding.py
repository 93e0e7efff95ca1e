"""Histogram sort into shards of near equal bytes.

Rows are ordered by a hash of the text, then of doc_id, so equal texts are neighbours. Splitters are found by
counting: every round all tasks count exact bytes and rows below some candidate keys, the driver sums them and
probes closer to the targets, until each splitter meets its tolerance or no key lies closer. The same rounds
cut the shards into cells of some rows, whose exact counts also say where each begins in its shard. Rows are
then exchanged once, by cell, and numbered there.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize

#: A shard's splitter may be off its place by this share of a shard's bytes.
TOLERANCE = 0.01
#: Rows of a cell, about: what one task sorts.
CELL_ROWS = 200_000
#: A cell's splitter may be off by this share of a cell's rows.
CELL_TOLERANCE = 0.1
PROBES = 24
MAX_ROUNDS = 64
_HALF = 1 << 63
#: Keys of one text, and all keys.
_TEXT, _SPACE = 1 << 64, 1 << 128


def _key(h: int, t: int) -> int:
    """Order of (h, t) as one unsigned number of 128 bits."""
    return (h + _HALF) << 64 | (t + _HALF)


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) - _HALF, (key & (1 << 64) - 1) - _HALF


@dataclass
class _Splitter:
    """A wanted place in the order, and the keys around it; below(key) is (bytes, rows) of smaller keys."""

    measure: int
    target: float
    slack: float
    text_slack: float
    low: int = 0
    high: int = _SPACE
    inside: bool = False
    key: int | None = None

    def probes(self, n: int) -> set[int]:
        """Keys between the ends, evenly spaced: between texts at first, then inside the one text that is left."""
        step = 1 if self.inside else _TEXT
        first, last = self.low // step + 1, (self.high - 1) // step
        n = min(n, last - first + 1)
        ends = {k for k in (self.low, self.high) if 0 < k < _SPACE}
        return ends | {(first + (last - first) * i // max(1, n - 1)) * step for i in range(n)}

    def narrow(self, below_low: tuple[int, int], below_high: tuple[int, int], first: int, last: int) -> None:
        """The place lies between two probes with that much below them; first and last are the outer keys there."""
        one_text = first // _TEXT == last // _TEXT
        if self.inside:
            self.low, self.high = first, last + 1
        else:
            self.low, self.high = first // _TEXT * _TEXT, (last // _TEXT + 1) * _TEXT
        off, key = min((abs(below_low[self.measure] - self.target), self.low), (abs(below_high[self.measure] - self.target), self.high))
        if off <= self.slack or first == last or one_text and not self.inside and off <= self.text_slack:
            self.key = key
        elif one_text:
            self.inside = True


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key (h, t) of each row; a null text is empty and has size 1."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id").cast("long")).alias("t"),
    )


def _cells_of(h: np.ndarray, t: np.ndarray, ph: np.ndarray, pt: np.ndarray) -> np.ndarray:
    """How many of the sorted probes (ph, pt) are not above each key."""
    at, end = np.searchsorted(ph, h, side="left"), np.searchsorted(ph, h, side="right")
    for first in np.unique(at[end > at]):
        same = (at == first) & (end > first)
        at[same] = first + np.searchsorted(pt[first : end[same][0]], t[same], side="right")
    return at


def _arrays(probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [_pair(k) for k in probes]
    return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] < b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1])


def histogram(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """By how many of the sorted probes are not above a key: exact bytes and rows, the smallest and largest key.

    A task keeps six numbers a probe and answers once.
    """
    ph, pt = _arrays(probes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size, n = np.zeros(len(ph) + 1, np.int64), np.zeros(len(ph) + 1, np.int64)
        low, high = np.zeros((len(ph) + 1, 2), np.int64), np.zeros((len(ph) + 1, 2), np.int64)
        for b in batches:
            order = np.lexsort((b["t"], b["h"]))
            keys = b[["h", "t"]].to_numpy(np.int64)[order]
            cells = _cells_of(keys[:, 0], keys[:, 1], ph, pt)
            here, first, many = np.unique(cells, return_index=True, return_counts=True)
            new = n[here] == 0
            a, z = keys[first], keys[first + many - 1]
            for ends, own, moved in ((low, a, _before(a, low[here])), (high, z, _before(high[here], z))):
                ends[here[new | moved]] = own[new | moved]
            np.add.at(size, cells, b["size"].to_numpy()[order])
            n[here] += many
        here = np.flatnonzero(n)
        yield pd.DataFrame({"cell": here, "bytes": size[here], "n": n[here], "h0": low[here, 0], "t0": low[here, 1], "h1": high[here, 0], "t1": high[here, 1]})

    found = keyed.select("h", "t", "size").mapInPandas(count, "cell long, bytes long, n long, h0 long, t0 long, h1 long, t1 long")
    summed = found.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min(F.struct("h0", "t0")).alias("low"), F.max(F.struct("h1", "t1")).alias("high"))
    return {r["cell"]: (r["bytes"], r["n"], _key(*r["low"]), _key(*r["high"])) for r in summed.collect()}


def find_splitters(keyed: DataFrame, wanted: list[_Splitter]) -> list[int]:
    """The keys of the wanted splitters; a round is one pass over the keys, and its answer is a row a probe."""
    for _ in range(MAX_ROUNDS):
        open_ = [s for s in wanted if s.key is None]
        if not open_:
            return [s.key for s in wanted]
        sharing = Counter((s.low, s.high) for s in open_)
        probes = sorted(set().union(*(s.probes(PROBES * sharing[s.low, s.high]) for s in {(s.low, s.high, s.inside): s for s in open_}.values())))
        cells = histogram(keyed, probes)
        below = [(0, 0)]
        for i in range(len(probes) + 1):
            size, n = cells.get(i, (0, 0))[:2]
            below.append((below[-1][0] + size, below[-1][1] + n))
        sums = [[b[m] for b in below[1:]] for m in (0, 1)]
        for s in open_:
            i = j = bisect_left(sums[s.measure], s.target)
            if not s.inside:  # its ends lie between texts, whatever others probe inside one
                while i and probes[i - 1] % _TEXT:
                    i -= 1
                while j < len(probes) and probes[j] % _TEXT:
                    j += 1
            here = [cells[k] for k in range(i, j + 1) if k in cells]
            s.narrow(below[i], below[j + 1], min(c[2] for c in here), max(c[3] for c in here))
    raise RuntimeError(f"splitters not found in {MAX_ROUNDS} rounds")


@dataclass
class Plan:
    """Cells in key order: their lower ends, shards, and the first slot of each in its shard."""

    keys: list[int]
    shards: list[int]
    first_slots: list[int]


def plan(keyed: DataFrame, shards: int) -> Plan:
    """Splitters of the shards by bytes and of the cells by rows, and exact counts of the cells between them."""
    total = keyed.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("m")).first()
    if not total["n"]:
        return Plan([], [0], [0])
    share, rows = total["b"] / shards, total["n"]
    by_bytes = [_Splitter(0, share * i, TOLERANCE * share, max(TOLERANCE * share, total["m"] / 2)) for i in range(1, shards)]
    cells = -(-rows // CELL_ROWS)
    by_rows = [_Splitter(1, rows * i / cells, CELL_TOLERANCE * rows / cells, 0) for i in range(1, cells)]
    found = find_splitters(keyed, by_bytes + by_rows)
    edges = sorted(found[: shards - 1])
    keys = sorted(set(found))
    counts = histogram(keyed, keys) if keys else {0: (total["b"], rows)}
    of, first, at = [], [], {}
    for i in range(len(keys) + 1):
        shard = bisect_right(edges, keys[i - 1]) if i else 0
        of.append(shard)
        first.append(at.get(shard, 0))
        at[shard] = first[-1] + (counts[i][1] if i in counts else 0)
    return Plan(keys, of, first)


def _placed(keyed: DataFrame, cut: Plan) -> DataFrame:
    ph, pt = _arrays(cut.keys)

    @F.pandas_udf("int")
    def cell(h: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(_cells_of(h.to_numpy(), t.to_numpy(), ph, pt))

    return keyed.withColumn("cell", cell("h", "t"))


def _cells(spark: SparkSession, cut: Plan) -> DataFrame:
    return spark.createDataFrame([(i, s, f) for i, (s, f) in enumerate(zip(cut.shards, cut.first_slots, strict=True))], "cell int, shard int, first_slot long")


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row's shard and its place there, gapless from 0.

    Shards are ranges of the key with near equal bytes: a splitter is off by at most 1 % of a shard, or else is
    the closest place between two keys. Equal texts share a shard, except where a splitter falls into texts
    with so many copies that neither side of them is within that tolerance (or half the longest text).
    Slots follow the key, then doc_id; repeated rows of one doc_id and text stay together. Null and empty
    texts have size 1; a null doc_id is a value of its own; an empty table gives no rows; extra columns are not read.
    """
    keyed = materialize(with_keys(docs), "shard-keys")
    cut = plan(keyed, shards)
    order = Window.partitionBy("cell").orderBy("h", "t", "doc_id", "size", "text_crc32")
    numbered = _placed(keyed, cut).withColumn("place", F.row_number().over(order) - 1)
    return numbered.join(_cells(docs.sparkSession, cut), "cell").select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("place")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Whole rows as Parquet, a folder shard=... each: the same shards, every file sorted like their slots."""
    cut = plan(materialize(with_keys(docs).select("h", "t", "size"), "shard-keys"), shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("h"), F.xxhash64(F.col("doc_id").cast("long")).alias("t"))
    dealt = _placed(rows, cut).join(_cells(docs.sparkSession, cut), "cell").repartition(len(cut.shards), "cell").sortWithinPartitions("shard", "cell", "h", "t")
    dealt.select("row.*", F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)
