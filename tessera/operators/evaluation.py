"""Retrieval and pairwise evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, with_positions

#: Groups of bootstrap_ci() that are sent to all tasks, at most; more are joined by a sort.
SENT_GROUPS = 2_000_000


def query_summary(queries: DataFrame, judgments: DataFrame) -> DataFrame:
    """query_id, judged, relevant of every query; queries without judgements have 0."""
    counts = judgments.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("grade") > 0).alias("relevant"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("judged", F.lit(0)).alias("judged"), F.coalesce("relevant", F.lit(0)).alias("relevant"))


def judged_candidates(ranked: DataFrame, judgments: DataFrame) -> DataFrame:
    """ranked with grade; null for items without a judgement."""
    return ranked.join(judgments, ["query_id", "item_id"], "left")


def retrieval_metrics(ranked: DataFrame, judgments: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per judged query: rr and, for each cutoff k, p_k, r_k, ndcg_k, to 6 decimals.

    Gain 2^grade - 1, discount log2(rank + 1); the ideal order is that of all judgements. Items without a
    judgement have grade 0; a query without relevant judgements has recall and ndcg 0.
    """
    graded = judged_candidates(ranked.select("query_id", "item_id", "rank"), judgments)
    return graded_metrics(graded, judgments.groupBy("query_id", "grade").agg(F.count(F.lit(1)).alias("n")), cutoffs)


def graded_metrics(graded: DataFrame, grades: DataFrame, cutoffs: list[int]) -> DataFrame:
    """retrieval_metrics() of a ranking that has its grades: graded (query_id, rank, grade), grades (query_id, grade, n) of all judgements.

    The best gains follow from how often each grade occurs: no judgement is ranked, and no list of them is needed.
    """
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    before = Window.partitionBy("query_id").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)
    runs = grades.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))  # a grade's ranks: at + 1 to at + n
    ranks = lambda k: F.when(F.col("at") < k, F.sequence(F.col("at") + 1, F.least(F.col("at") + F.col("n"), F.lit(k))))
    discounts = lambda k: F.coalesce(F.aggregate(ranks(k), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0)), F.lit(0.0))
    ideal = lambda k: F.sum(F.coalesce(gain(F.col("grade")) * discounts(k), F.lit(0.0)))
    best = runs.groupBy("query_id").agg(F.coalesce(F.sum(F.when(F.col("grade") > 0, F.col("n"))), F.lit(0)).alias("relevant"), *(ideal(k).alias(f"ideal_{k}") for k in cutoffs))
    graded = graded.withColumn("g", F.coalesce("grade", F.lit(0)))
    dcg = lambda k: F.sum(F.when(F.col("rank") <= k, gain(F.col("g")) / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    hits = lambda k: F.count_if((F.col("rank") <= k) & (F.col("g") > 0))
    got = graded.groupBy("query_id").agg(F.min(F.when(F.col("g") > 0, F.col("rank"))).alias("first"), *(hits(k).alias(f"hits_{k}") for k in cutoffs), *(dcg(k).alias(f"dcg_{k}") for k in cutoffs))
    out = [F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr")]
    for k in cutoffs:
        found = F.coalesce(f"hits_{k}", F.lit(0))
        out += [
            F.round(found / float(k), 6).alias(f"p_{k}"),
            F.round(F.when(F.col("relevant") > 0, found / F.col("relevant")).otherwise(0.0), 6).alias(f"r_{k}"),
            F.round(F.when(F.col(f"ideal_{k}") > 0, F.coalesce(f"dcg_{k}", F.lit(0.0)) / F.col(f"ideal_{k}")).otherwise(0.0), 6).alias(f"ndcg_{k}"),
        ]
    return best.join(got, "query_id", "left").select("query_id", *out)


def macro_metrics(metrics: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the mean of every metric, judged queries and skipped queries."""
    names = [c for c in metrics.columns if c != "query_id"]
    joined = queries.select("query_id").join(metrics, "query_id", "left")
    return joined.agg(*(F.round(F.avg(c), 6).alias(c) for c in names), F.count("rr").alias("judged"), F.count_if(F.col("rr").isNull()).alias("skipped"))


def pair_agreement(cases: DataFrame, predictions: DataFrame, baseline: str, tie: float = 1e-9) -> DataFrame:
    """method, agreement, delta_pp and relative_pct against the baseline.

    cases: id, winner (left, right, tie); predictions: id, method, left_score, right_score.
    """
    gap = F.col("left_score") - F.col("right_score")
    said = F.when(F.abs(gap) <= tie, "tie").when(gap > 0, "left").otherwise("right")
    rate = predictions.join(cases, "id").groupBy("method").agg(F.avg((said == F.col("winner")).cast("double")).alias("agreement"))
    base = rate.where(F.col("method") == baseline).select(F.col("agreement").alias("b"), F.lit(1).alias("one"))
    joined = rate.withColumn("one", F.lit(1)).join(base, "one", "left")
    return joined.select(
        "method", F.round("agreement", 6).alias("agreement"), F.round(100 * (F.col("agreement") - F.col("b")), 6).alias("delta_pp"),
        F.round(100 * (F.col("agreement") - F.col("b")) / F.nullif("b", F.lit(0.0)), 6).alias("relative_pct"),
    )


def bootstrap_ci(values: DataFrame, group: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """mean, low, high (2.5 and 97.5 %) of the mean under resampling whole groups; nulls for fewer than 2 groups.

    Groups are pre-aggregated and numbered by a range sort; each draw picks as many numbers as there are groups by a hash
    of (seed, draw, slot), so draws are rows that Spark spreads, and the same seed gives the same result. The sums of the
    groups go to the draws: Spark takes the draws, made up from a small range, for the smaller side, and must not send them.
    """
    sums = values.groupBy(group).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    numbered = materialize(with_positions(sums, F.col(group), name="at").select("at", "s", "n"), "groups")
    size = F.broadcast(numbered.agg(F.max("at").alias("top"), (F.sum("s") / F.sum("n")).alias("mean")).withColumn("one", F.lit(1)))
    spark = values.sparkSession
    slots = spark.range(draws).withColumnRenamed("id", "draw").withColumn("one", F.lit(1)).join(size, "one").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))))
    picked = slots.withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "draw", "slot"), F.col("top") + 1))
    looked_up = F.broadcast(numbered) if numbered.count() <= SENT_GROUPS else numbered.hint("merge")
    means = picked.join(looked_up, "at").groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("m"), F.max("mean").alias("mean"), F.max("top").alias("top"))
    edge = lambda p: F.when(F.max("top") >= 1, F.percentile("m", F.lit(p)))
    return means.agg(F.max("mean").alias("mean"), edge(0.025).alias("low"), edge(0.975).alias("high"))


def stratified_split(rows: DataFrame, by: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """rows with `test`: round(n * fraction), half to even, of each class by a hash of the key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), key))
    return rows.withColumn("test", place <= F.bround(n * fraction))
