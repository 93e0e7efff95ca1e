"""Time-segmented complete-linkage clusters with forced burst groups."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.images import meta_sim
from tessera.functions.scalars import gps_sim, hash_sim, hist_sim, name_sim
from tessera.functions.shared import materialize
from tessera.functions.signals import hash_combined_sim, pair_base_sim, pair_final_sim, quality_penalty
from tessera.operators.graph import connected_components
from tessera.operators.logs import segment_by_gap

#: Distance, size and gap.
THRESHOLD, MAX_SIZE, GAP_SECONDS = 0.38, 25, 1800
#: Components with more items or pairs are linked in rounds over tables; items of the components of a grouped task, about.
MAX_MEMBERS, MAX_PAIRS, BUCKET_MEMBERS = 5_000, 200_000, 10_000


def complete_linkage(start: dict[int, set[int]], pairs: dict[tuple[int, int], float], threshold: float) -> list[set[int]]:
    """Clusters after merging, again and again, the two whose furthest members are nearest, up to the threshold.

    start: clusters by name; pairs: distances of members, a missing one is too far. Equal distances go to the
    smallest members. Only clusters of which every pair is known can merge, so the work follows the pairs.
    """
    of = {m: c for c, members in start.items() for m in members}
    near: dict[int, dict[int, tuple[float, int]]] = {c: {} for c in start}  # furthest known distance, known pairs
    for (a, b), d in pairs.items():
        x, y = of[a], of[b]
        if x != y:
            far, n = near[x].get(y, (0.0, 0))
            near[x][y] = near[y][x] = (max(far, d), n + 1)
    clusters = {c: set(members) for c, members in start.items()}
    least = {c: min(members) for c, members in clusters.items()}
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(x: int, y: int) -> None:
        far, n = near[x][y]
        if far <= threshold and n == len(clusters[x]) * len(clusters[y]):
            a, b = sorted((x, y), key=least.__getitem__)
            heapq.heappush(heap, (far, least[a], least[b], a, b))

    for x in near:
        for y in near[x]:
            if x < y:
                offer(x, y)
    name = max(clusters, default=0) + 1
    while heap:
        *_, a, b = heapq.heappop(heap)
        if a not in clusters or b not in clusters:
            continue
        merged = clusters.pop(a) | clusters.pop(b)
        sides = near.pop(a), near.pop(b)
        clusters[name], least[name], near[name] = merged, min(least[a], least[b]), {}
        for other in (sides[0].keys() | sides[1].keys()) - {a, b}:
            known = [s[other] for s in sides if other in s]
            near[name][other] = near[other][name] = (max(d for d, _ in known), sum(n for _, n in known))
            near[other].pop(a, None)
            near[other].pop(b, None)
            offer(name, other)
        name += 1
    return list(clusters.values())


def split_oversized(timed: list[tuple[float, int]], limit: int) -> Iterator[list[tuple[float, int]]]:
    """Parts of at most `limit` of the (time, member) rows, cut at the first largest gap, again and again."""
    stack = [sorted(timed)]
    while stack:
        group = stack.pop()
        if len(group) <= limit:
            yield group
            continue
        at = max(range(1, len(group)), key=lambda k: (group[k][0] - group[k - 1][0], -k))
        stack += [group[:at], group[at:]]


def final_distances(items: DataFrame, inliers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """left_no, right_no, distance of all pairs that can be within the threshold: 1 less the final similarity.

    items: collection_id, item_no, ts, file_name, ph, dh, wh, ah (64-bit hashes), color (histogram), camera, lens, focal,
    aperture, lat, lon, auto_reject, quality_score; any may be null. inliers: left_no, right_no, inliers (matched
    points). A pair with under 5 matched points has a final similarity of 0.55 at most, so below a threshold of 0.45
    the rows of the inlier table are all that can be near, and no pair is made up; other thresholds are refused.
    """
    if threshold >= 1 - 0.55:
        raise ValueError("from a threshold of 0.45 on any two items can be near")
    asked = inliers.where(F.col("inliers") >= 5).groupBy(F.least("left_no", "right_no").alias("left_no"), F.greatest("left_no", "right_no").alias("right_no")).agg(F.max("inliers").alias("inliers"))
    side = lambda key: items.select(F.col("item_no").alias(f"{key}_no"), F.struct(*(c for c in items.columns if c != "item_no")).alias(key))
    both = asked.join(side("left"), "left_no").join(side("right"), "right_no").where("left.collection_id <=> right.collection_id and left_no <> right_no")
    of = lambda name: (F.col(f"left.{name}"), F.col(f"right.{name}"))
    hashes = hash_combined_sim(*(hash_sim(*of(h)) for h in ("ph", "dh", "wh", "ah")))
    seconds = (F.unix_micros(of("ts")[0]) - F.unix_micros(of("ts")[1])) / 1e6
    meta = F.coalesce(meta_sim(*({n: F.col(f"{k}.{n}") for n in ("camera", "lens", "focal", "aperture")} for k in ("left", "right"))), F.lit(0.0))
    placed = gps_sim(*(F.col(f"{k}.{n}") for k in ("left", "right") for n in ("lat", "lon")))
    penalty = F.coalesce(quality_penalty(*of("auto_reject"), *of("quality_score")), F.lit(0.0))
    base = pair_base_sim(hashes, hist_sim(*of("color")), F.coalesce(F.exp(-F.abs(seconds) / 60), F.lit(0.0)), meta, F.coalesce(name_sim(*of("file_name")), F.lit(0.0)), placed, penalty)
    scored = both.withColumns({"_hash": hashes, "_base": base, "_seconds": F.coalesce(seconds, F.lit(0.0))})
    final = pair_final_sim(F.col("_base"), F.col("_hash"), F.col("_seconds"), F.col("inliers"))
    return scored.select("left_no", "right_no", F.round(1 - final, 12).alias("distance")).where(F.col("distance") <= threshold)


def _linked_in_rounds(members: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """item_no, cluster by complete linkage in rounds over tables, for components too large for a task.

    A round merges all clusters that are each other's nearest. The distance of a merged cluster to a third is never less
    than that of both its parts, so the order in which such pairs merge does not matter.
    """
    first = members.groupBy("start").agg(F.min("item_no").alias("least"), F.count(F.lit(1)).alias("size"))
    clusters = materialize(first.select(F.col("start").alias("c"), "least", "size"), "linkage")
    labels = materialize(members.select("item_no", F.col("start").alias("c")), "linkage")
    of = lambda end: members.select(F.col("item_no").alias(f"{end}_no"), F.col("start").alias(end))
    known = edges.join(of("left"), "left_no").join(of("right"), "right_no").where("left <> right")
    fold = lambda t: t.groupBy(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right")).agg(F.max("far").alias("far"), F.sum("n").alias("n"))
    pairs = materialize(fold(known.select("left", "right", F.col("distance").alias("far"), F.lit(1).cast("long").alias("n"))), "linkage")
    while True:
        end = lambda key: clusters.select(F.col("c").alias(key), F.col("least").alias(f"{key}_least"), F.col("size").alias(f"{key}_size"))
        ready = pairs.where(F.col("far") <= threshold).join(end("left"), "left").join(end("right"), "right").where("n = left_size * right_size")
        ready = ready.select("left", "right", "left_least", "right_least", F.struct("far", F.least("left_least", "right_least").alias("a"), F.greatest("left_least", "right_least").alias("b")).alias("rank"))
        ready = materialize(ready, "linkage")
        best = ready.select(F.col("left").alias("c"), "rank").unionByName(ready.select(F.col("right").alias("c"), "rank")).groupBy("c").agg(F.min("rank").alias("at"))
        merges = ready.join(best.withColumnRenamed("c", "left").withColumnRenamed("at", "l"), "left").join(best.withColumnRenamed("c", "right").withColumnRenamed("at", "r"), "right").where("rank = l and rank = r")
        keep = F.col("left_least") < F.col("right_least")
        to = materialize(merges.select(F.when(keep, F.col("right")).otherwise(F.col("left")).alias("c"), F.when(keep, F.col("left")).otherwise(F.col("right")).alias("into")), "linkage")
        if to.isEmpty():
            return labels.withColumnRenamed("c", "cluster")
        for key in ("left", "right"):
            pairs = pairs.join(to.select(F.col("c").alias(key), F.col("into").alias(f"_{key}")), key, "left").withColumn(key, F.coalesce(f"_{key}", key)).drop(f"_{key}")
        pairs = materialize(fold(pairs.where("left <> right")), "linkage")
        joined = clusters.join(to, "c", "left").withColumn("c", F.coalesce("into", "c"))
        clusters = materialize(joined.groupBy("c").agg(F.min("least").alias("least"), F.sum("size").alias("size")), "linkage")
        labels = materialize(labels.join(to, "c", "left").select("item_no", F.coalesce("into", "c").alias("c")), "linkage")


def cluster_bursts(
    items: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, limit: int = MAX_SIZE, gap_seconds: int = GAP_SECONDS, max_members: int = MAX_MEMBERS, max_pairs: int = MAX_PAIRS
) -> DataFrame:
    """collection_id, item_no, group_no (smallest member), place (in the group, by time), group_place (in the collection, by time).

    items: collection_id, item_no, ts (null allowed), burst (a forced group of the collection, or null); pairs:
    left_no, right_no, distance, a row for every pair that can be within the threshold. Items of one collection
    are cut into segments where the time since the item before is over the gap; bursts hold within a segment. The
    linkage runs for each connected component of near pairs and bursts: clusters never reach over components. A
    component with more than max_members items or max_pairs pairs is linked in rounds over tables, the others in tasks that
    take some buckets of components; both give the same. A missing time is 0 in sizes and comes first. Items without a near pair are groups of their own.
    """
    rows = segment_by_gap(items.select("collection_id", "item_no", "ts", "burst"), "collection_id", "ts", [F.col("ts").asc_nulls_last(), "item_no"], gap_seconds)
    place = rows.select("item_no", F.struct("collection_id", "segment").alias("segment"))
    a, b = (place.select(F.col("item_no").alias(n), F.col("segment").alias(s)) for n, s in (("left_no", "ls"), ("right_no", "rs")))
    close = pairs.where((F.col("distance") <= threshold) & (F.col("left_no") != F.col("right_no"))).join(a, "left_no").join(b, "right_no").where("ls = rs")
    close = close.groupBy(F.least("left_no", "right_no").alias("left_no"), F.greatest("left_no", "right_no").alias("right_no")).agg(F.max("distance").alias("distance"))
    forced = Window.partitionBy("collection_id", "segment", "burst")
    started = rows.withColumn("start", F.when(F.col("burst").isNotNull(), F.min("item_no").over(forced)).otherwise(F.col("item_no")))
    linked = close.select("left_no", "right_no").unionByName(started.where("start <> item_no").select(F.col("start").alias("left_no"), F.col("item_no").alias("right_no")))
    part = connected_components(linked, "left_no", "right_no")
    time = F.coalesce(F.unix_micros("ts") / 1e6, F.lit(0.0))
    members = materialize(started.join(part.withColumnRenamed("id", "item_no"), "item_no").select("component", F.col("item_no").cast("long").alias("item_no"), F.col("start").cast("long").alias("start"), time.alias("t")), "burst-members")
    edges = materialize(close.join(part.select(F.col("id").alias("left_no"), "component"), "left_no").select("component", "left_no", "right_no", "distance"), "burst-pairs")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(edges.groupBy("component").agg(F.count(F.lit(1)).alias("e")), "component", "left")
    large = materialize(sizes.where((F.col("n") > max_members) | (F.col("e") > max_pairs)).select("component"), "burst-components")
    buckets = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-members.count() // BUCKET_MEMBERS)))).alias("bucket")

    def link(own: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out, of = [], {c: p for c, p in near.groupby("component")}
        for component, mine in own.groupby("component"):
            start: dict[int, set[int]] = {}
            for item, first in zip(mine["item_no"].tolist(), mine["start"].tolist(), strict=True):
                start.setdefault(first, set()).add(item)
            e = of.get(component, near.iloc[:0])
            known = dict(zip(zip(e["left_no"].tolist(), e["right_no"].tolist(), strict=True), e["distance"].tolist(), strict=True))
            out += [(m, min(c)) for c in complete_linkage(start, known, threshold) for m in c]
        return pd.DataFrame(out, columns=["item_no", "cluster"])

    small = lambda t: materialize(t.join(large, "component", "left_anti").select("*", buckets), "burst-buckets").groupBy("bucket")
    clusters = small(members).cogroup(small(edges)).applyInPandas(link, "item_no long, cluster long")
    if not large.isEmpty():
        clusters = clusters.unionByName(_linked_in_rounds(members.join(large, "component", "left_semi"), edges.join(large, "component", "left_semi"), threshold))
    sized = members.join(clusters, "item_no").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cluster")))

    def split(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(m, min(x for _, x in g)) for g in split_oversized(list(zip(own["t"].tolist(), own["item_no"].tolist(), strict=True)), limit) for _, m in g], columns=["item_no", "group_no"])

    # all pairs of a linked cluster are known, so it is small; only a forced burst can be long, and it is one sequence of times
    cut = sized.where(F.col("_n") > limit).groupBy("cluster").applyInPandas(split, "item_no long, group_no long")
    whole = sized.where(F.col("_n") <= limit).select("item_no", F.min("item_no").over(Window.partitionBy("cluster")).alias("group_no"))
    grouped = whole.unionByName(cut)
    found = rows.select("collection_id", "item_no", time.alias("t")).join(grouped, "item_no", "left").withColumn("group_no", F.coalesce("group_no", "item_no"))
    first = found.groupBy("collection_id", "group_no").agg(F.min("t").alias("first"))
    order = first.select("collection_id", "group_no", F.row_number().over(Window.partitionBy("collection_id").orderBy("first", "group_no")).alias("group_place"))
    within = Window.partitionBy("collection_id", "group_no").orderBy("t", "item_no")
    return found.withColumn("place", F.row_number().over(within)).join(order, ["collection_id", "group_no"]).select("collection_id", "item_no", "group_no", "place", "group_place")
