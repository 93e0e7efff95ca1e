"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are range-sorted by length and open gaps by size, both as runs of equal values: there are at
most `capacity` lengths and `capacity` gaps whatever the size of the corpus. Because the runs are that few,
the steps over them (take the longest length left, match it with its successor among the gaps, settle the
documents that want the same gap by their rank within the length, update the gaps, repeat) are a loop in
the driver over a bounded histogram, not Spark supersteps: the result is exactly best-fit decreasing, whose
order is sequential. The documents never leave the executors: a row finds its place from its rank, which
is counted with salted windows.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.inputs import documents

CAPACITY = 2048
#: Rows that one salted window partition of the ranking holds, about.
ROWS_PER_SALT = 20_000
END_MARK = "<|endoftext|>"
SPECIAL = {END_MARK: 50256}
#: White space in a row beyond which the splitting pattern would run out of stack.
LONG_BLANK = 2_048
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANK)
_encodings: dict = {}


def encoding(path: str):
    """The byte-level BPE whose ranks are in the file at path, loaded once per Python worker."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encodings[path]


def ordinary_ids(path: str, text: str) -> list[int]:
    """Ids of a text of any shape without special tokens.

    The pattern takes a run of white space but its last character as one piece (at the end of a text all of
    it); runs of LONG_BLANK are cut out that way beforehand, so the ids are the same.
    """
    own = encoding(path)
    if len(text) < LONG_BLANK:
        return own.encode_ordinary(text)
    ids, at = [], 0
    for run in _BLANKS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += own.encode_ordinary(text[at : run.start()])
        ids += own._encode_single_piece(text[run.start() : end])
        at = end
    return ids + own.encode_ordinary(text[at:])


def ids_of(path: str, text: str) -> list[int]:
    """Ids of a text in which the end mark is a special token."""
    parts = text.split(END_MARK)
    ids = ordinary_ids(path, parts[0])
    for part in parts[1:]:
        ids.append(SPECIAL[END_MARK])
        ids += ordinary_ids(path, part)
    return ids


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The ranks of the same vocabulary as byte_bpe_50k.json; ids are equal, encoding is five times faster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    head = [(0, first)] if first else []
    return head + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every whole text followed by id 0."""
    path = path or ranks_path()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = ids_of(path, text)
                ids.append(0)
                raw = np.array(ids, dtype="<u4").tobytes()
                rows += [(doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents(docs).mapInPandas(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs (length, rank_lo, rank_hi, bin_lo, offset): rank r of a length goes to bin bin_lo + r - rank_lo.

    counts: documents of each length, 1 to capacity. Exactly best-fit decreasing; its size depends on
    capacity, not on the number of documents.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def leave(gap: int, start: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((start, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                break
            gap = order[at]
            start, n = gaps[gap].pop()
            take = min(n, left)
            if take < n:
                gaps[gap].append((start + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            runs.append((length, rank, rank + take, start, capacity - gap))
            leave(gap - length, start, take)
            rank, left = rank + take, left - take
        each = capacity // length
        for bins, held in ((left // each, each), (1, left % each)):
            if bins and held:
                for k in range(held):
                    runs.append((length, rank, rank + bins, opened, k * length))
                    rank += bins
                leave(capacity - held * length, opened, bins)
                opened += bins
    return pd.DataFrame(runs, columns=["length", "rank_lo", "rank_hi", "bin_lo", "offset"]).sort_values(["length", "rank_lo"])


def ranked(pieces: DataFrame, n_rows: int) -> DataFrame:
    """pieces with `rank`, 0 up within each length; salts keep a common length out of a single task."""
    salts = 8 + n_rows // ROWS_PER_SALT
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .select("length", "salt", "before")
    )
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("row", F.row_number().over(within))
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("row") - 1)
        .drop("salt", "row", "before")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text counts as empty (one token, the end). Documents longer than capacity are cut; only the
    first piece may be shorter. Repeated rows are packed once each; an empty table gives no rows; a null
    doc_id is kept as it is; other columns are ignored.
    """
    pieces = materialize(token_pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(counts, capacity)
    lengths, rank_lo, bin_lo, offset = (plan[c].to_numpy(np.int64) for c in ("length", "rank_lo", "bin_lo", "offset"))
    first = np.searchsorted(lengths, np.arange(capacity + 2))
    sent = docs.sparkSession.sparkContext.broadcast((first, rank_lo, bin_lo, offset))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, rank_lo, bin_lo, offset = sent.value
        for batch in batches:
            rank = batch.pop("rank").to_numpy()
            at = np.empty(len(batch), np.int64)
            for length, rows in batch.groupby("length").indices.items():
                a, b = first[length], first[length + 1]
                at[rows] = a + np.searchsorted(rank_lo[a:b], rank[rows], side="right") - 1
            batch["sequence_id"] = bin_lo[at] + rank - rank_lo[at]
            batch["offset"] = offset[at]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(pieces, sum(counts.values())).mapInPandas(place, schema)
