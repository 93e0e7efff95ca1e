"""Upserts, freshness, membership, summaries and consistency checks of an item catalog.

All operators are joins on keys and aggregates that Spark combines before the shuffle. A null key matches
nothing in a join and counts as its own group in an aggregate; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.logs import latest_per_key, snapshot_digest


def with_item_id(rows: DataFrame, *parts: Column) -> DataFrame:
    """rows with item_id: 32 hex digits that the lower-cased parts decide."""
    return rows.withColumn("item_id", F.substring(F.sha2(F.lower(F.concat_ws("/", *parts)), 256), 1, 32))


def read_items(items: DataFrame, collection_id: str | None = None) -> DataFrame:
    """Items of a collection (all without one) in order of item_id; on partitioned files only its folder is read."""
    kept = items if collection_id is None else items.where(F.col("collection_id") == collection_id)
    return kept.orderBy("item_id")


def merge_scores(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key of both tables, new before old, then by order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [F.desc("_new"), *order]).drop("_new")


def merge_judgments(old: DataFrame, new: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, rejected): old judgements replaced by new ones, and the new rows refused with a reason.

    A key that the batch holds more than once is refused as `duplicate`, an unknown item as `foreign`.
    """
    keys = ["query_id", "item_id"]
    counted = new.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    known = counted.join(items.select("item_id", F.lit(True).alias("_known")).distinct(), "item_id", "left")
    reason = F.when(F.col("_known").isNull(), "foreign").when(F.col("_n") > 1, "duplicate")
    judged = known.withColumn("reason", reason).select(*new.columns, "reason")
    good = judged.where("reason is null").drop("reason")
    return old.join(good.select(*keys), keys, "left_anti").unionByName(good), judged.where("reason is not null")


def selection_history(selections: DataFrame, document: str, schema: str, defaults: dict[str, object]) -> DataFrame:
    """selections with the fields of a JSON document; text that does not parse gives the defaults."""
    parsed = selections.withColumn("_json", F.from_json(document, schema))
    return parsed.withColumns({k: F.coalesce(F.col("_json")[k], F.lit(v)) for k, v in defaults.items()}).drop("_json")


def is_analyzed(*columns: str) -> Column:
    """All columns are known."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return whole


def is_fresh(provider: str, recorded: list[tuple[str, str]], digest: str) -> Column:
    """The row was made by provider, the recorded columns equal the current ones and the digest is 64 hex digits."""
    fresh = F.col("provider") == provider
    for was, now in recorded:
        fresh = fresh & (F.col(was) == F.col(now))
    return F.coalesce(fresh & F.col(digest).rlike("^[0-9a-f]{64}$"), F.lit(False))


def split_stale(rows: DataFrame, fresh: Column) -> tuple[DataFrame, DataFrame]:
    """(current, stale) rows; an unknown state is stale."""
    ok = F.coalesce(fresh, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def entity_members(mentions: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of known items, with the label of their entity where it has one."""
    return mentions.join(items, "item_id").join(entities, "entity_id", "left")


def with_scores(items: DataFrame, scores: DataFrame, by: str) -> DataFrame:
    """Items with their score, of the groups in which every item has one."""
    joined = items.join(scores, "item_id", "left")
    whole = joined.groupBy(by).agg(F.bool_and(F.col("score").isNotNull()).alias("_whole")).where("_whole").select(by)
    return joined.join(whole, by, "left_semi")


def collection_summary(items: DataFrame) -> DataFrame:
    """Counts of each collection in one aggregate; provider only where all rows name the same one."""
    return items.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("quality_score").alias("scored"),
        F.count_if("auto_reject").alias("rejected"),
        F.countDistinct("group_id").alias("groups"),
        F.when((F.min("provider") == F.max("provider")) & (F.count("provider") == F.count(F.lit(1))), F.max("provider")).alias("provider"),
    )


def library_overview(collections: DataFrame, items: DataFrame, mentions: DataFrame, selections: DataFrame) -> DataFrame:
    """collections with all their counts: items, analyzed, rejected, groups, embedded, embedding_provider, mentions, processed, entity_provider, selections.

    items: collection_id, item_id, quality_score, blur_score, phash, dhash, auto_reject, group_id, file_size, mtime, and for
    embedding_ and entity_ each provider, size, mtime; embedding_path and embedding_sha, processed. mentions: item_id;
    selections: collection_id. A derived value counts if it was made from the file as it is now; a provider is named only
    where it is the only one. One aggregate of each table, joined by collection; a collection without rows has zeros.
    """
    c = F.col
    current = lambda kind: (c(f"{kind}_size") == c("file_size")) & (c(f"{kind}_mtime") == c("mtime"))
    embedded = F.coalesce(c("embedding_path").isNotNull() & current("embedding") & c("embedding_sha").rlike("^[0-9a-f]{64}$"), F.lit(False))
    processed = F.coalesce(c("processed") & current("entity"), F.lit(False))
    only = lambda when, name: F.when(F.min(F.when(when, c(name))) == F.max(F.when(when, c(name))), F.max(F.when(when, c(name))))
    whole = F.coalesce(c("quality_score"), c("blur_score")).isNotNull() & c("quality_score").isNotNull() & c("blur_score").isNotNull() & c("phash").isNotNull() & c("dhash").isNotNull()
    of_items = items.groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(whole).alias("analyzed"), F.count_if("auto_reject").alias("rejected"), F.countDistinct("group_id").alias("groups"),
        F.count_if(embedded).alias("embedded"), only(embedded, "embedding_provider").alias("embedding_provider"), F.count_if(processed).alias("processed"), only(processed, "entity_provider").alias("entity_provider"),
    )
    per_item = mentions.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    of_mentions = items.select("collection_id", "item_id").join(per_item, "item_id").groupBy("collection_id").agg(F.sum("n").alias("mentions"))
    of_selections = selections.groupBy("collection_id").agg(F.count(F.lit(1)).alias("selections"))
    joined = collections.join(of_items, "collection_id", "left").join(of_mentions, "collection_id", "left").join(of_selections, "collection_id", "left")
    counts = ("items", "analyzed", "rejected", "groups", "embedded", "mentions", "processed", "selections")
    return joined.withColumns({n: F.coalesce(c(n), F.lit(0)).cast("long") for n in counts})


def entity_state(rows: DataFrame, by: str, done: Column) -> DataFrame:
    """Per group: processed rows, rows left, providers of the processed ones and the last."""
    ok = F.coalesce(done, F.lit(False))
    return rows.groupBy(by).agg(
        F.count_if(ok).alias("processed"), F.count_if(~ok).alias("pending"), F.countDistinct(F.when(ok, F.col("provider"))).alias("providers"), F.max(F.when(ok, F.col("provider"))).alias("provider")
    )


def verify_selection(selection: DataFrame, problem: str, group: str, k: int, cap: int) -> DataFrame:
    """problem, rule, found: the rules that a delivered selection breaks (size, cap, duplicate)."""
    per = selection.groupBy(problem, group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("item_id").alias("d"))
    sums = per.groupBy(problem).agg(F.sum("n").alias("size"), F.max("n").alias("cap"), F.sum(F.col("n") - F.col("d")).alias("duplicate"))
    broken = F.array_compact(F.array(
        F.when(F.col("size") != k, F.struct(F.lit("size").alias("rule"), F.col("size").alias("found"))),
        F.when(F.col("cap") > cap, F.struct(F.lit("cap").alias("rule"), F.col("cap").alias("found"))),
        F.when(F.col("duplicate") > 0, F.struct(F.lit("duplicate").alias("rule"), F.col("duplicate").alias("found"))),
    ))
    return sums.select(problem, F.explode(broken).alias("b")).select(problem, "b.rule", "b.found")


def label_counts(members: DataFrame, label: str, item: str, least: int) -> DataFrame:
    """Distinct items of each label, whichever entities carry it, and whether they are enough."""
    return members.where(F.col(label).isNotNull()).groupBy(label).agg(F.countDistinct(item).alias("items")).withColumn("enough", F.col("items") >= least)


def feasibility(candidates: DataFrame, problem: str, category: str, k: int, quotas: dict[str, int]) -> DataFrame:
    """problem, status: category_quota_infeasible, infeasible (too few candidates) or feasible."""
    counts = [F.count_if(F.col(category) == c).alias(f"_q{n}") for n, c in enumerate(quotas)]
    short = F.lit(sum(quotas.values()) > k)
    for n, least in enumerate(quotas.values()):
        short = short | (F.col(f"_q{n}") < least)
    status = F.when(short, "category_quota_infeasible").when(F.col("_n") < k, "infeasible").otherwise("feasible")
    return candidates.groupBy(problem).agg(F.count(F.lit(1)).alias("_n"), *counts).select(problem, status.alias("status"))


def selection_feasibility(candidates: DataFrame, required: DataFrame, k: int, cap: int, quotas: dict[str, int], minimums: dict[str, int]) -> DataFrame:
    """problem, status: required_items_infeasible, category_quota_infeasible, infeasible or feasible, the first that holds.

    candidates: problem, item_id, grp, category, labels; required: problem, item_id. Required items must be candidates and
    not more than k; quotas must fit k and the candidates; label minimums too; groups of at most cap must leave k items. A
    problem that only required names has no candidates. Repeated rows count once; a null group is one group.
    """
    one = candidates.dropDuplicates(["problem", "item_id"])
    counts = [F.count_if(F.col("category") == x).alias(f"_q{n}") for n, x in enumerate(quotas)] + [F.count_if(F.array_contains("labels", x)).alias(f"_m{n}") for n, x in enumerate(minimums)]
    held = one.groupBy("problem").agg(*counts, F.count(F.lit(1)).alias("_n"))
    room = one.groupBy("problem", "grp").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("_room")).groupBy("problem").agg(F.sum("_room").alias("_room"))
    asked = required.select("problem", "item_id").distinct().join(one.select("problem", "item_id", F.lit(1).alias("_there")), ["problem", "item_id"], "left")
    asked = asked.groupBy("problem").agg(F.count(F.lit(1)).alias("_asked"), F.count("_there").alias("_found"))
    rows = held.join(room, "problem").join(asked, "problem", "full")
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    any_of = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    short = F.lit(sum(quotas.values()) > k) | any_of(n(f"_q{i}") < least for i, least in enumerate(quotas.values()))
    few = any_of(F.lit(least > k) | (n(f"_m{i}") < least) for i, least in enumerate(minimums.values())) | (n("_room") < k)
    status = F.when((n("_asked") > k) | (n("_asked") > n("_found")), "required_items_infeasible").when(short, "category_quota_infeasible").when(few, "infeasible").otherwise("feasible")
    return rows.select("problem", status.alias("status"))


def dim_conflicts(events: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """Keys whose vectors have more than one length."""
    size = F.when(F.col(vec).isNotNull(), F.size(vec))
    return events.groupBy(*keys).agg(F.countDistinct(size).alias("dimensions")).where("dimensions > 1")


def drifted(stored: DataFrame, current: DataFrame, group: str, key: str, columns: list[str]) -> DataFrame:
    """group, drifted: whether the digests of both row sets differ or a side is missing."""
    a = snapshot_digest(stored, group, key, columns).select(group, F.col("digest").alias("was"))
    b = snapshot_digest(current, group, key, columns).select(group, F.col("digest").alias("now"))
    return a.join(b, group, "full").select(group, (~F.col("was").eqNullSafe(F.col("now"))).alias("drifted"))


def apply_label_updates(labels: DataFrame, updates: DataFrame, key: str, order: list) -> DataFrame:
    """updates with status: applied, superseded (not the first of its key), stale (other revision) or unknown (no such key)."""
    first = updates.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    known = first.join(labels.select(key, F.col("revision").alias("_revision")), key, "left")
    status = (
        F.when(F.col("_revision").isNull(), "unknown").when(F.col("_place") > 1, "superseded").when(F.col("_revision") != F.col("expected_revision"), "stale").otherwise("applied")
    )
    return known.withColumn("status", status).drop("_place", "_revision")


def pin_mismatches(assets: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field: pinned columns that differ from the source record, nulls equal; `missing` without a record."""
    renamed = source.select(key, F.lit(True).alias("_found"), *(F.col(c).alias(f"_{c}") for c in columns))
    differ = [F.when(F.col("_found").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]
    joined = assets.join(renamed, key, "left")
    return joined.select(key, F.explode(F.array_compact(F.array(F.when(F.col("_found").isNull(), F.lit("missing")), *differ))).alias("field"))


def _ranked_cases(cases: DataFrame) -> DataFrame:
    query = [F.col("query")] if "query" in cases.columns else []
    pair = Window.partitionBy(F.least("left", "right"), F.greatest("left", "right"), *query).orderBy("id")
    return cases.withColumn("_rn", F.row_number().over(pair))


def rejected_cases(cases: DataFrame) -> DataFrame:
    """The cases that repeat a pair, whichever way round, of the same query (if there is such a column) and a smaller id."""
    return _ranked_cases(cases).where("_rn > 1").drop("_rn")


def blind_cases(cases: DataFrame, seed: int) -> DataFrame:
    """Cases with sides swapped by a hash of (seed, id), but for rejected_cases()."""
    kept = _ranked_cases(cases).where("_rn = 1")
    swapped = F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")), 256), 1, 1) < "8"
    return kept.select("id", F.when(swapped, F.col("right")).otherwise(F.col("left")).alias("first"), F.when(swapped, F.col("left")).otherwise(F.col("right")).alias("second"), swapped.alias("swapped"))


def unblind(blinded: DataFrame, answers: DataFrame) -> DataFrame:
    """id, winner (left, right, tie) of the answers first, second, tie; cases without an answer have none."""
    said = F.when(F.col("answer") == "tie", "tie").when((F.col("answer") == "first") != F.col("swapped"), "left").when(F.col("answer").isNotNull(), "right")
    return blinded.join(answers, "id", "left").select("id", said.alias("winner"))


def validate_citations(claims: DataFrame, citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_id, claim_id, violation: all that is wrong with answers and their citations.

    claims: run_id, claim_id, text; citations: run_id, claim_id, item_id; evidence: run_id, item_id. Every
    check is an equi-join or a count on keys. A null text is untrimmed.
    """
    own, ref = ["run_id", "claim_id"], ["run_id", "item_id"]
    said = lambda df, name: df.select(*own, F.lit(name).alias("violation")).distinct()
    same = claims.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("run_id", F.lower(F.trim("text"))))).where("_n > 1 and text is not null")
    found = [
        said(claims.where(~F.coalesce(F.col("claim_id").rlike("^c[0-9]+$"), F.lit(False))), "id"),
        said(claims.where(~F.coalesce((F.trim("text") == F.col("text")) & (F.col("text") != ""), F.lit(False))), "text"),
        said(same, "duplicate_text"),
        said(claims.join(citations, own, "left_anti"), "uncited"),
        said(citations.join(claims, own, "left_anti"), "unknown_claim"),
        said(citations.join(evidence, ref, "left_anti"), "outside_evidence"),
        said(citations.groupBy(*own, "item_id").count().where("count > 1"), "duplicate_pair"),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
