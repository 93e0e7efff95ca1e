"""Clusters of mentions: ids, summaries and the life of their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNNAMED = "Unknown"


def set_digest(members: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """key, name, n: SHA-256 of the count and two sums of member hashes; order does not matter.

    Sums combine before the shuffle, so a cluster with a third of all rows is never in one list. Null members are
    left out; a repeated member counts again.
    """
    digest = F.sha2(F.col(member).cast("string"), 256)
    part = lambda start: F.sum(F.conv(F.substring(digest, start, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    known = members.where(F.col(member).isNotNull())
    sums = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), part(1).alias("_a"), part(13).alias("_b"))
    return sums.select(key, F.sha2(F.concat_ws(":", F.col("n").cast("string"), "_a", "_b"), 256).alias(name), "n")


def with_cluster_id(members: DataFrame, key: str, member: str) -> DataFrame:
    """key, cluster_id, n: an id that only the members decide."""
    return set_digest(members, key, member, "cluster_id")


def entity_summary(members: DataFrame, key: str, cover: Column) -> DataFrame:
    """key, n and the member with the smallest `cover`, largest clusters first, then by key."""
    return members.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(cover).alias("cover")).orderBy(F.desc("n"), key)


def evidence_mismatch(stored: DataFrame, evidence: DataFrame) -> DataFrame:
    """cluster_id, missing, foreign: clusters whose stored members differ from those of their evidence."""
    both = stored.select("cluster_id", "member", F.lit(1).alias("s")).distinct().join(evidence.select("cluster_id", "member", F.lit(1).alias("e")).distinct(), ["cluster_id", "member"], "full")
    counted = both.groupBy("cluster_id").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("foreign"))
    return counted.where("missing > 0 or foreign > 0")


def invalidate_labels(labels: DataFrame, members: DataFrame, changed: DataFrame) -> DataFrame:
    """labels with those of every cluster that holds a changed member reset for review, one revision on."""
    hit = members.join(changed.select("member").distinct(), "member", "left_semi").select("cluster_id").distinct().withColumn("_hit", F.lit(True))
    touched = F.col("_hit").isNotNull()
    return labels.join(hit, "cluster_id", "left").select(
        "cluster_id", F.when(touched, UNNAMED).otherwise(F.col("label")).alias("label"), F.when(touched, "needs_review").otherwise(F.col("status")).alias("status"),
        (F.col("revision") + touched.cast("int")).alias("revision"),
    )


def reconcile_labels(old: DataFrame, old_members: DataFrame, new_members: DataFrame, recomputed: DataFrame, history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels of the new clusters, events to append).

    old: cluster_id, label, status, revision; members: cluster_id, member; recomputed: member; history:
    cluster_id, revision. A label stays only where the same cluster has the very same members and none was
    computed anew. Any other cluster is unnamed: to review if a named or pending old cluster shares a member or
    it has a history, else unlabeled; its revision moves on from the highest known. Old clusters that do not
    stay leave an event for review.
    """
    before = set_digest(old_members, "cluster_id", "member", "was").select("cluster_id", "was")
    known = old.join(before, "cluster_id", "left")
    moved = new_members.join(recomputed.select("member").distinct(), "member", "left_semi").select("cluster_id").distinct().withColumn("moved", F.lit(True))
    pending = old.where((F.col("label") != UNNAMED) | (F.col("status") == "needs_review")).select("cluster_id")
    heirs = old_members.join(pending, "cluster_id", "left_semi").select("member").distinct()
    named = new_members.join(heirs, "member", "left_semi").select("cluster_id").distinct().withColumn("named", F.lit(True))
    past = history.groupBy("cluster_id").agg(F.max("revision").alias("past"))
    rows = set_digest(new_members, "cluster_id", "member", "now").join(known, "cluster_id", "left").join(moved, "cluster_id", "left").join(named, "cluster_id", "left").join(past, "cluster_id", "left")
    safe = F.coalesce(F.col("was") == F.col("now"), F.lit(False)) & F.col("moved").isNull()
    seen = F.col("named").isNotNull() | F.col("past").isNotNull()
    again = F.col("revision").isNotNull() | seen
    revision = F.greatest(F.coalesce("past", F.lit(0)), F.coalesce("revision", F.lit(0))) + again.cast("int")
    labels = rows.select(
        "cluster_id", F.when(safe, F.col("label")).otherwise(UNNAMED).alias("label"),
        F.when(safe, F.col("status")).when(seen, "needs_review").otherwise("unlabeled").alias("status"),
        F.when(safe, F.col("revision")).otherwise(revision).cast("int").alias("revision"), safe.alias("kept"),
        F.when(again, "evidence_changed").otherwise("indexed").alias("reason"),
    )
    fresh = labels.where("not kept").select("cluster_id", "label", "status", "revision", "reason")
    lost = old.join(labels.where("kept"), "cluster_id", "left_anti").select("cluster_id", "label", F.lit("needs_review").alias("status"), (F.col("revision") + 1).cast("int").alias("revision"), F.lit("invalidated").alias("reason"))
    return labels.drop("reason"), fresh.unionByName(lost)
