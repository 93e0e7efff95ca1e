import itertools
import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tessera.functions.scalars import normalize_label
from tessera.operators import bursts, catalog, selection
from tessera.operators import similarity as M
from tessera.plans import further, registry

NEW = ["g4_select_constrained", "c7_pool_pairs", "j3_budget_violations", "d15_quota_plan", "i30_normalize_label", "j7_rejected_cases"]


@pytest.mark.parametrize("name", NEW)
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "conversations", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = getattr(further, name)(spark, f"{DATA}/sf0.01").toPandas()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    plain = lambda x: None if x is None or x is pd.NA or x != x else float(x) if isinstance(x, (int, float)) else x
    rows = lambda df: sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


def test_constrained_selection_equals_brute_force(spark):
    rng = random.Random(5)
    rows, edges, want = [], [], {}
    k, cap, quotas, minimums = 3, 2, {"x": 1}, {"ann": 1}
    for p in range(40):
        n = rng.randrange(2, 9)
        own = [(p, i, rng.choice("ab"), rng.choice("xyz"), rng.randrange(0, 5) / 5, [w for w in ("ann", "bob") if rng.random() < 0.4], rng.random() < 0.1) for i in range(n)]
        near = [(p, a, b, rng.random() < 0.3, rng.choice([0.0, 0.3])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3]
        best = None
        for chosen in itertools.combinations(range(n), k):
            c = [own[i] for i in chosen]
            held = [x for x in near if x[1] in chosen and x[2] in chosen]
            if any(sum(x[2] == g for x in c) > cap for g in "ab") or sum(x[3] == "x" for x in c) != 1 or not any("ann" in x[5] for x in c) or any(x[3] for x in held) or any(x[6] and x[1] not in chosen for x in own):
                continue
            value = sum(round(x[4] * 10**6) * (n + 1) + n - x[1] for x in c) - sum(round(x[4] * 10**6) * (n + 1) for x in held)
            best = max(best or (value, [-i for i in chosen]), (value, [-i for i in chosen]))
        want[p] = (best[0], [-i for i in best[1]]) if best else (None, [])
        rows += own
        edges += near
    c = spark.createDataFrame(rows, "problem long, item_id long, grp string, category string, score double, labels array<string>, pinned boolean")
    e = spark.createDataFrame(edges, "problem long, left_id long, right_id long, conflict boolean, penalty double")
    got = {r["problem"]: (r["objective"], r["selected"]) for r in selection.select_constrained(c, e, k, cap, quotas, minimums).collect()}
    assert got == want and sum(v[0] is not None for v in want.values()) > 5
    assert selection.select_constrained(c.limit(0), e, k, cap).count() == 0


def test_pool_pairs_refuse_a_large_pool(spark):
    pool = spark.range(10).select(F.lit(1).alias("problem"), F.col("id").alias("item_id"))
    none = spark.createDataFrame([], "problem int, left_id long, right_id long")
    assert selection.pool_pairs(pool, none).count() == 45
    with pytest.raises(Exception, match="over 5 members"):
        selection.pool_pairs(pool, none, 5).collect()


def naive(start, pairs, threshold):
    clusters = [set(c) for c in start.values()]
    far = lambda a, b: max(pairs.get((min(x, y), max(x, y)), 9.0) for x in a for y in b)
    while len(clusters) > 1:
        d, _, a, b = min((far(a, b), sorted((min(a), min(b))), i, j) for (i, a), (j, b) in itertools.combinations(enumerate(clusters), 2))
        if d > threshold:
            break
        clusters[a] |= clusters.pop(b)
    return {frozenset(c) for c in clusters}


def test_complete_linkage_equals_the_plain_loop():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(2, 12)
        pairs = {(a, b): rng.randrange(0, 8) / 10 for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.7}
        start = {}
        for m in range(n):
            start.setdefault(m if rng.random() < 0.8 else rng.choice([m, *start]), set()).add(m)
        assert {frozenset(c) for c in bursts.complete_linkage(start, pairs, 0.38)} == naive(start, pairs, 0.38)


def test_split_oversized_cuts_at_the_first_largest_gap():
    assert sorted(bursts.split_oversized([(t, t) for t in (0, 1, 2, 10, 11, 19)], 2)) == [[(0, 0)], [(1, 1), (2, 2)], [(10, 10), (11, 11)], [(19, 19)]]


def test_bursts_keep_to_segments_and_caps(spark):
    rows = [("c", i, i * 10 if i < 30 else 90_000 + i, 1 if i in (2, 3, 40) else None) for i in range(42)] + [("c", 50, None, None), ("d", 60, 5, None)]
    items = spark.createDataFrame(rows, "collection_id string, item_no long, s long, burst int").withColumn("ts", F.timestamp_seconds("s"))
    pairs = spark.createDataFrame([(a, b, 0.1) for a, b in itertools.combinations(range(30), 2) if 2 not in (a, b)] + [(29, 30, 0.0), (30, 31, 0.9)], "left_no long, right_no long, distance double")
    got = bursts.cluster_bursts(items, pairs, limit=25).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["group_no"], []).append((r["place"], r["item_no"]))
    sets = {frozenset(i for _, i in g) for g in groups.values()}
    assert len(got) == 44 and frozenset({2, 3}) in sets and frozenset({40}) in sets and frozenset({50}) in sets
    assert max(len(s) for s in sets) <= 25 and not any({29, 30} <= s for s in sets)
    assert all([i for _, i in sorted(g)] == sorted(i for _, i in g) for g in groups.values())
    assert bursts.cluster_bursts(items.limit(0), pairs).count() == 0


def test_linkage_in_rounds_equals_tasks(spark):
    rng = random.Random(7)
    rows = [(f"c{i % 3}", i, rng.randrange(40_000), rng.choice([None, None, i // 5])) for i in range(120)]
    items = spark.createDataFrame(rows, "collection_id string, item_no long, s long, burst int").withColumn("ts", F.timestamp_seconds("s"))
    near = [(a, b, rng.randrange(0, 10) / 20) for a in range(120) for b in range(a + 3, min(a + 19, 120), 3) if rng.random() < 0.8]
    pairs = spark.createDataFrame(near, "left_no long, right_no long, distance double")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(bursts.cluster_bursts(items, pairs, limit=4, gap_seconds=90_000))
    assert max(sum(r[2] == g for r in want) for g in {r[2] for r in want}) > 2
    assert key(bursts.cluster_bursts(items, pairs, limit=4, gap_seconds=90_000, max_members=2)) == want


def test_final_distances(spark):
    kinds = "collection_id string, item_no long, s double, file_name string, ph long, dh long, wh long, ah long, color array<double>, camera string, lens string, focal string, aperture string, lat double, lon double, auto_reject boolean, quality_score double"
    full = (-1, -1, -1, -1, [1.0], "A", "L", "50mm", "f/2", 48.0, 9.0, False, 50.0)
    rows = [("c", 0, 0.0, "IMG_1.jpg", *full), ("c", 1, 1.0, "IMG_2.jpg", -2, *full[1:]), ("c", 2, 3900.0, "IMG_3.jpg", *full), ("c", 3, 2.0, "x", 0, 0, 0, 0, None, "B", None, None, None, None, None, True, 90.0), ("d", 4, 0.0, "IMG_1.jpg", *full), ("c", 5, None, None, *[None] * 13)]
    items = spark.createDataFrame(rows, kinds).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    matched = [(1, 0, 12), (0, 2, 95), (0, 3, 40), (3, 1, 100), (0, 4, 99), (0, 5, 5), (2, 1, 4), (0, 1, 3)]
    got = {(r["left_no"], r["right_no"]): r["distance"] for r in bursts.final_distances(items, spark.createDataFrame(matched, "left_no long, right_no long, inliers long")).collect()}
    hashes, time, name = 0.4 * 63 / 64 + 0.6, math.exp(-1 / 60), 29 / 30
    assert set(got) == {(0, 1), (0, 3), (1, 3)} - {(0, 3), (1, 3)}  # no hash in common and no color: the base decides there
    assert abs(got[0, 1] - (1 - (0.32 * hashes + 0.22 + 0.18 * time + 0.12 + 0.10 * name + 0.06))) < 1e-9
    medium = spark.createDataFrame([(0, 1, 30), (0, 2, 90)], "left_no long, right_no long, inliers long")
    assert {(r[0], r[1]) for r in bursts.final_distances(items, medium).collect()} == {(0, 1)}
    with pytest.raises(ValueError):
        bursts.final_distances(items, medium, 0.45)


def test_ordered_exclusion_equals_the_scan(spark):
    rng = random.Random(9)
    rows, base = [], [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(12)]
    for i in range(150):
        ph, dh = rng.choice(base)
        for _ in range(rng.randrange(0, 6)):
            ph ^= 1 << rng.randrange(63)
        rows.append(("c", i, ph, dh))
    items = spark.createDataFrame(rows, "collection_id string, item_no long, ph long, dh long")
    kept, near = [r for r in rows if r[1] % 10 == 1], []
    for r in rows:
        if r[1] % 10 != 1 and not any(bin(r[2] ^ o[2]).count("1") <= 7 and bin(r[3] ^ o[3]).count("1") <= 9 for o in kept):
            kept.append(r)
            near.append(r[1])
    assert sorted(r["item_no"] for r in M.exclude_near_in_order(items, F.col("item_no") % 10 == 1).collect()) == near


def test_labels_and_blind_cases(spark):
    labels = ["  Ann ", "é", "UNKNOWN", "mE", "", "x" * 81, "a​b", "a\nb", None]
    df = spark.createDataFrame(pd.DataFrame({"l": labels}), "l string")
    assert [r[0] for r in df.select(normalize_label("l")).collect()] == ["Ann", "é", "Unknown", "Me", None, None, None, None, None]
    cases = spark.createDataFrame([(1, "q", 1, 2), (2, "r", 2, 1), (3, "q", 2, 1)], "id int, query string, left int, right int")
    assert sorted(r["id"] for r in catalog.blind_cases(cases, 1).collect()) == [1, 2]
    assert [r["id"] for r in catalog.rejected_cases(cases).collect()] == [3]
