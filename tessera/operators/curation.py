"""Filters, gates, search, selection and listings over items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import dot, norm


def eligible(items: DataFrame, min_quality: float, exclude_rejects: bool = True) -> DataFrame:
    """Items that are not rejected and have the quality; a null quality is too low."""
    kept = items.where(F.coalesce(F.col("quality_score"), F.lit(0.0)) >= min_quality)
    return kept.where(~F.coalesce(F.col("auto_reject"), F.lit(False))) if exclude_rejects else kept


def eligibility_counts(items: DataFrame, min_quality: float) -> DataFrame:
    """Per collection: rejected, low_quality (of those not rejected) and eligible items, in one aggregate."""
    rejected, low = F.coalesce(F.col("auto_reject"), F.lit(False)), F.coalesce(F.col("quality_score"), F.lit(0.0)) < min_quality
    return items.groupBy("collection_id").agg(
        F.count_if(rejected).alias("rejected"), F.count_if(~rejected & low).alias("low_quality"), F.count_if(~rejected & ~low).alias("eligible")
    )


def restrict(items: DataFrame, ids: DataFrame, key: str = "item_id") -> DataFrame:
    return items.join(ids.select(key), key, "left_semi")


def complete_collections(items: DataFrame, complete: Column) -> DataFrame:
    """Items of the collections all of whose items are complete."""
    whole = items.groupBy("collection_id").agg(F.bool_and(F.coalesce(complete, F.lit(False))).alias("whole")).where("whole")
    return items.join(whole.select("collection_id"), "collection_id", "left_semi")


def gate_reasons(items: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """items with reasons: the names of the gates that do not hold (a null gate does not)."""
    return items.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()))))


def validate_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, violation: a row for each rule that a row breaks."""
    return gate_reasons(rows, rules).select(key, F.explode("reasons").alias("violation"))


def vector_violations(rows: DataFrame, key: str, vec: str, dimension: int) -> DataFrame:
    """key, violation for vectors of another dimension, with components that are not finite, or of length zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return validate_rows(rows, key, {"dimension": F.size(v) == dimension, "finite": finite, "zero": norm(v) > 0})


#: Items and queries of a block of search(): one product of two such blocks is what a task works on at a time.
SEARCH_ITEMS, SEARCH_QUERIES = 4_096, 512
#: More than rounding to 6 decimals can change the order by.
ROUNDING = 2e-6


def _blocks(rows: DataFrame, key: str, size: int, part: str) -> tuple[DataFrame, DataFrame]:
    """(collection_id, dim, part, rows) in blocks of about `size` by a hash of key, and (collection_id, dim, parts)."""
    known = rows.where(F.col("collection_id").isNotNull() & F.col(key).isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v"))
    parts = known.groupBy("collection_id", "dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{part}s"))
    dealt = known.join(parts, ["collection_id", "dim"]).withColumn(part, F.pmod(F.xxhash64(key), F.col(f"{part}s")).cast("int"))
    return dealt.groupBy("collection_id", "dim", part).agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "collection_id"))).alias(f"{part}_rows")), parts


def search(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, item_id, score: the k best items of the query's collection.

    queries: query_id, collection_id, query_vec. The order is score (6 decimals) and quality, largest
    first, then item_id; the query's own item is left out. Blocks of items meet blocks of queries as products of
    matrices, spread over all tasks by (collection, block, block), so a large collection is many tasks; a block gives
    each query the items that can be among its k best, and only those are ranked. Null vectors, vectors of another
    length and null ids or collections are not found and find nothing.
    """
    left = items.select("collection_id", "item_id", F.col("quality_score").cast("double").alias("quality"), F.col("vec").cast("array<double>").alias("v"))
    right = queries.select("collection_id", "query_id", F.col("query_vec").cast("array<double>").alias("v"))
    (i, i_parts), (q, q_parts) = _blocks(left, "item_id", SEARCH_ITEMS, "i"), _blocks(right, "query_id", SEARCH_QUERIES, "q")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    i = i.join(q_parts, ["collection_id", "dim"]).withColumn("q", every("qs")).drop("qs")
    q = q.join(i_parts, ["collection_id", "dim"]).withColumn("i", every("is")).drop("is")
    kinds = [f"{n} {d.schema[n].dataType.simpleString()}" for d, n in ((right, "query_id"), (left, "item_id"))]

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, asked in zip(batch["i_rows"], batch["q_rows"], strict=True):
                score = np.array([a["v"] for a in asked], float) @ np.array([x["v"] for x in own], float).T
                ids, names = (np.array([r[n] for r in rows], object) for rows, n in ((own, "item_id"), (asked, "query_id")))
                score[names[:, None] == ids[None, :]] = -np.inf
                least = np.partition(score, -k, axis=1)[:, -k] if k < score.shape[1] else np.full(len(score), -np.inf)
                a, b = np.nonzero((score >= (least - ROUNDING)[:, None]) & (score > -np.inf))
                quality = np.array([x["quality"] for x in own], float)
                yield pd.DataFrame({"query_id": names[a], "item_id": ids[b], "quality": quality[b], "raw": score[a, b]})

    found = i.join(q, ["collection_id", "dim", "i", "q"]).select("i_rows", "q_rows").mapInPandas(best, f"{', '.join(kinds)}, quality double, raw double")
    scored = found.withColumn("score", F.round("raw", 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce(F.nanvl("quality", F.lit(0.0)), F.lit(0.0)).desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "item_id", "score")


def search_by_item(items: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """search() with the vectors of the items that refs (item_id) name."""
    queries = items.join(refs.select("item_id").distinct(), "item_id").select(F.col("item_id").alias("query_id"), "collection_id", F.col("vec").alias("query_vec"))
    return search(items, queries, k)


def cap_per_group(items: DataFrame, group: Column, cap: int, order: list) -> DataFrame:
    return items.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= cap).drop("_rn")


def group_capacity(candidates: DataFrame, problem: str, group: str, cap: int, k: int) -> DataFrame:
    """Per problem: capacity (sum of min(group size, cap)) and feasible (capacity >= k)."""
    sizes = candidates.groupBy(problem, group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(problem).agg(F.sum(F.least("n", F.lit(cap))).alias("capacity")).withColumn("feasible", F.col("capacity") >= k)


def select_capped(candidates: DataFrame, problem: str, group: str, k: int, cap: int) -> DataFrame:
    """Exactly k candidates a problem of the largest total score, at most cap a group; infeasible problems give none.

    Caps form a partition matroid, so the greedy choice, the best cap of each group and then the best k,
    is exact. Scores count in millionths; ties go to the smaller item_id.
    """
    order = [F.round(F.col("score") * 1_000_000).desc(), F.col("item_id")]
    capped = cap_per_group(candidates, F.struct(problem, group), cap, order)
    feasible = group_capacity(candidates, problem, group, cap, k).where("feasible").select(problem)
    ranked = capped.join(feasible, problem, "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy(problem).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def curate(items: DataFrame, gates: dict[str, Column], utility: Column) -> DataFrame:
    """item_id, utility, reasons, kept: the first passing member of each group by utility, or why not.

    items: item_id, group_id (null: a group of its own).
    """
    judged = gate_reasons(items.withColumn("utility", utility), gates).withColumn("_pass", F.size("reasons") == 0)
    group = F.coalesce(F.col("group_id"), F.concat(F.lit("item:"), F.col("item_id")))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_pass"), F.desc("utility"), "item_id"))
    kept = F.col("_pass") & (first == 1)
    reasons = F.when(F.col("_pass") & (first > 1), F.array(F.lit("not_best"))).otherwise(F.col("reasons"))
    return judged.select("item_id", "utility", reasons.alias("reasons"), kept.alias("kept"))


def replace_item(selection: DataFrame, removed: DataFrame, candidates: DataFrame, cap: int) -> DataFrame:
    """problem, item_id: selections with the removed member exchanged for the best candidate that keeps the caps.

    selection: problem, item_id, group_id; removed: problem, item_id; candidates: problem, item_id, group_id,
    score. Problems without a candidate keep the rest only.
    """
    rest = selection.join(removed, ["problem", "item_id"], "left_anti")
    full = rest.groupBy("problem", "group_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cap)
    free = candidates.join(removed.select("problem").distinct(), "problem", "left_semi").join(selection, ["problem", "item_id"], "left_anti").join(full, ["problem", "group_id"], "left_anti")
    best = free.withColumn("_rn", F.row_number().over(Window.partitionBy("problem").orderBy(F.desc("score"), "item_id"))).where("_rn = 1")
    return rest.select("problem", "item_id").unionByName(best.select("problem", "item_id"))


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


#: Listing orders by name, as SQL before the path; an unknown capture time or quality comes last.
LISTINGS = {"path": (), "quality": ("-quality_score",), "capture_time": ("capture_ts",)}


def list_items(items: DataFrame, mode: str, limit: int, offset: int = 0, include_rejects: bool = True, tie: str | None = None) -> DataFrame:
    """The items of one page of every collection, in the order of `mode` (path, quality or capture_time), with place and total.

    items: collection_id, path, quality_score, capture_ts, auto_reject and more; place counts from 1 over the whole listing
    of a collection, total is its length. Spark keeps offset + limit rows a collection and task before the shuffle, and
    totals are partial sums, so a large collection costs what its page costs. A collection with no row has no page. Items of
    one path are in the order of the column `tie`; without it their order is open.
    """
    if mode not in LISTINGS:
        raise ValueError(f"mode must be one of {sorted(LISTINGS)}")
    shown = items if include_rejects else items.where(~F.coalesce("auto_reject", F.lit(False)))
    totals = shown.groupBy(F.col("collection_id").alias("_c")).agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("collection_id").orderBy(*(F.expr(x).asc_nulls_last() for x in LISTINGS[mode]), "path", *([tie] if tie else []))
    paged = shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= offset + limit).where(F.col("place") > offset)
    return paged.join(totals, F.col("collection_id").eqNullSafe(F.col("_c"))).drop("_c")


def classify(items: DataFrame, prototypes: DataFrame, margin: float = 0.015) -> DataFrame:
    """item_id, label: the nearest prototype, or `uncertain` if the second is within the margin; ties by label.

    prototypes (label, vec): a row for each class, folded into one row, so items never meet them in a join of pairs.
    """
    folded = prototypes.agg(F.array_sort(F.collect_list(F.struct("label", F.col("vec").alias("pv")))).alias("prototypes"))
    scored = F.transform("prototypes", lambda p: F.struct((-F.round(dot(F.col("vec"), p["pv"]), 9)).alias("s"), p["label"].alias("label")))
    ranked = items.join(F.broadcast(folded)).select("item_id", F.array_sort(scored).alias("r"))
    sure = (F.size("r") < 2) | (F.get("r", F.lit(1))["s"] - F.get("r", F.lit(0))["s"] >= margin)
    return ranked.select("item_id", F.when(sure, F.get("r", F.lit(0))["label"]).otherwise("uncertain").alias("label"))
