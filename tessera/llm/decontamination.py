"""Benchmark decontamination by spaced-seed hashing, DataFrame and SQL functions only.

Words are runs of letters and digits of the lower-cased text. A seed is a fixed mask over some words that
looks at 7 of them and ignores the rest, so it still hits when an ignored word was substituted. The masks are
lossless: whichever words of a window differ, as far as the threshold admits, one mask fits in between. Seeds
of the benchmark are few (checked before they are broadcast) and are joined with the seeds of every document;
each hit names a diagonal, along which document and item are compared word by word.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.inputs import documents

#: Word positions that each mask looks at: whichever 2 of 13 words differ, one of these fits between them.
LOSSLESS = ((0, 1, 2, 4, 5, 6, 7), (0, 1, 3, 6, 8, 9, 10), (0, 1, 3, 4, 5, 8, 9))
#: A diagonal is an overlap if some WINDOW words of the item in a row have SIMILAR equal to the document's.
WINDOW = 13
SIMILAR = 0.8
#: Rows of seeds or hits that may be broadcast; beyond, the join is an ordinary one.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def masks_for(words: int, window: int = WINDOW, similar: float = SIMILAR) -> tuple[tuple[int, ...], ...]:
    """Masks of which one at least hits every overlap with an item of so many words.

    Of `width` words at most `differ` are not equal. They leave `differ` + 1 runs of equal words, the longest of
    which has width // (differ + 1) at least: without better masks, that many words in a row are the seed.
    """
    width = min(words, window)
    differ = width - ceil(width * similar)
    return LOSSLESS if (width, differ) == (13, 2) else (tuple(range(max(width // (differ + 1), 1))),)


def seeds(df: DataFrame, key: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """key, at, seed: a row for each mask at each place of the text."""
    hashed = df.select(key, F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)
    placed = hashed.select(key, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("at"))
    looks = [F.when(F.col("at") + m[-1] < F.size("w"), F.xxhash64(F.lit(repr(m)), *(F.get(F.col("w"), F.col("at") + p) for p in m))) for m in masks]
    return placed.select(key, "at", F.explode(F.array(*looks)).alias("seed")).where("seed is not null")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similar: float = SIMILAR) -> DataFrame:
    """Per document and item that overlap: doc_id, item_id, matched, item_words, best.

    matched: words equal along the best diagonal; best: most equal words within `window` words of the item
    in a row (all of a shorter item). All diagonals with best >= ceil(similar * window) count, or
    ceil(similar * item_words) for a shorter item. Null texts and ids, and texts or items without words, overlap
    with nothing; repeated rows of either table count once; empty tables give no rows; other columns are ignored.
    """
    if not 0 < similar <= 1:
        raise ValueError("without equal words no seed finds an overlap")
    spark = docs.sparkSession
    docs = documents(docs).where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    length = F.least(F.size(words_of(F.col("text"))), F.lit(window))
    lengths = sorted(r["n"] for r in items.select(length.alias("n")).distinct().collect() if r["n"])  # `window` different ones at most
    own = [seeds(items.where(length == n), "item_id", list(masks_for(n, window, similar))) for n in lengths]
    masks = sorted({m for n in lengths for m in masks_for(n, window, similar)}) or [(0,)]
    known = reduce(DataFrame.unionByName, own, spark.createDataFrame([], "item_id long, at int, seed long"))
    known = materialize(known.select("item_id", F.col("at").alias("item_at"), "seed").distinct(), "seeds")
    hits = (
        seeds(docs, "doc_id", masks).join(_small(known), "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    )
    hits = materialize(hits, "hits")
    lines = items.select("item_id", words_of(F.col("text")).alias("i"))
    n = F.size("i")
    width = F.least(F.lit(window), n)
    paired = (
        docs.join(_small(hits), "doc_id")
        .select("doc_id", "item_id", "diagonal", words_of(F.col("text")).alias("d"))
        .join(lines, "item_id")
        .withColumn("eq", F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(F.get(F.col("d"), j + F.col("diagonal")) == F.get(F.col("i"), j), F.lit(False)).cast("int")))
    )
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    return (
        paired.select(
            "doc_id",
            "item_id",
            n.cast("long").alias("item_words"),
            width.alias("width"),
            total(F.col("eq")).cast("long").alias("matched"),
            F.array_max(F.transform(F.sequence(F.lit(1), n - width + 1), lambda s: total(F.slice(F.col("eq"), s, width)))).cast("long").alias("best"),
        )
        .where(F.col("best") >= F.ceil(F.col("width") * F.lit(similar)))
        .groupBy("doc_id", "item_id")
        .agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"), F.max("best").alias("best"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, with all their columns; rows with a null doc_id stay."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(found, docs["doc_id"].cast("long") == found["_leaked"], "left_anti")
