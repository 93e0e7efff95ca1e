"""Filter interaction audit: what every order of five filters removes, from one table of failure masks.

A document is its mask of failed filters, so the corpus is reduced to counts by (part, mask) and nothing
after that grows with it. In the lexicographic list of the 120 orders, those that share a prefix are
neighbours. A mask is removed at step k by the orders whose first k - 1 letters it passes and whose k-th it
fails: a few intervals of ranks. The mask's count is added where an interval begins and taken off where it
ends, and a running sum over the ranks gives every order's removals at once.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize
from tessera.llm.inputs import WORD_BREAK

FILTERS = "ABCDE"
FACTORIAL = (1, 1, 2, 6, 24, 120)
ORDERS = FACTORIAL[len(FILTERS)]
#: Limits of the filters.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 200, 50, 3, "[#$%&*|]"
TALLIES = ("rows", "good", "toxic")


def lehmer_rank(letters: str) -> int:
    """Rank of the first order that begins with these letters."""
    left, rank = list(FILTERS), 0
    for x in letters:
        at = left.index(x)
        rank += at * FACTORIAL[len(left) - 1]
        left.pop(at)
    return rank


def removal_intervals(mask: int) -> list[tuple[int, int, int]]:
    """(step, first rank, rank after the last) of the orders in which a document with this mask goes at that step."""
    fails = [x for i, x in enumerate(FILTERS) if mask >> i & 1]
    passes = [x for i, x in enumerate(FILTERS) if not mask >> i & 1]
    found = []
    for step in range(1, len(passes) + 2):
        for prefix in permutations(passes, step - 1):
            for x in fails:
                first = lehmer_rank("".join((*prefix, x)))
                found.append((step, first, first + FACTORIAL[len(FILTERS) - step]))
    return found


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails; bit i stands for the i-th letter."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        text.rlike(MARKS),
    )
    return sum((f.cast("int") * (1 << i) for i, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, rows, good, toxic: documents of a part (lang; null: empty) by what they fail, all of it.

    Equal texts meet by their SHA-256. The smallest doc_id of a text is one partial minimum a task; a row
    asks for it by text and doc_id together, so a text with a third of all rows is spread over all tasks. A
    row fails E if a smaller doc_id has its text: repeated rows of the smallest one pass, and so does a null
    doc_id. A document is good or toxic if any of its labels says so. Null text is the empty text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text, 256).alias("same"), failures(text).alias("failed"))
    facts = materialize(facts, "audit-facts")
    least = facts.groupBy("same").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")))
    rows = facts.join(least, ["same", "doc_id"], "left").join(marks, "doc_id", "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.groupBy("part", (F.col("failed") + again.cast("int") * (1 << FILTERS.index("E"))).alias("mask")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("quality").alias("good"), F.count_if("toxic").alias("toxic")
    )


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, filter_order and step from counts by mask, zeros included; the columns are those of `audit`.

    Everything here has at most 32 masks or 600 rows a part; the interval table has 840 rows whatever the data.
    """
    spark = counts.sparkSession
    spans = [(mask, *span) for mask in range(1, 1 << len(FILTERS)) for span in removal_intervals(mask)]
    spans = spark.createDataFrame(spans, "mask int, step int, start int, stop int")
    ends = counts.join(F.broadcast(spans), "mask").select(
        "part", "step", F.inline(F.array(*(F.struct(F.col(at).alias("rank"), *((sign * F.col(t)).alias(t) for t in TALLIES)) for at, sign in (("start", 1), ("stop", -1)))))
    )
    changes = ends.groupBy("part", "step", "rank").agg(*(F.sum(t).alias(t) for t in TALLIES))
    steps = F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS))))
    grid = counts.select("part").distinct().withColumn("step", steps).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))))
    so_far = Window.partitionBy("part", "step").orderBy("rank")
    removed = grid.join(changes, ["part", "step", "rank"], "left").select("part", "step", "rank", *(F.sum(F.coalesce(F.col(t), F.lit(0))).over(so_far).alias(t) for t in TALLIES))

    names = spark.createDataFrame([(rank, "".join(p)) for rank, p in enumerate(permutations(FILTERS))], "rank int, filter_order string")
    steps_of = removed.join(F.broadcast(names), "rank").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    hit = lambda i: F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
    each = [F.struct(F.lit(x).alias("filter"), F.sum(F.when(hit(i), F.col("rows")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("mask") == 1 << i, F.col("rows")).otherwise(0)).alias("unique_fails")) for i, x in enumerate(FILTERS)]
    totals = counts.groupBy("part").agg(F.sum("rows").alias("all"), F.array(*each).alias("each"))
    by_filter = totals.select("part", "all", F.inline("each"))
    gone = F.sum("rows").over(Window.partitionBy("part", "rank").orderBy("step"))
    return steps_of.join(by_filter, ["part", "filter"]).select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), (F.col("all") - gone).alias("kept"), F.col("rows").alias("removed"), (F.col("fails") - F.col("rows")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("rows").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all 120 orders.

    No documents give no rows; extra columns are not read; null and empty texts, ties and repeated rows as `masks` says.
    """
    return interactions(materialize(masks(docs, labels), "audit-masks"))
