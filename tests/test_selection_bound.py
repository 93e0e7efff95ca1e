import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tessera.operators import selection
from tessera.plans import further

CANDIDATES = "problem long, item_id long, grp string, category string, score double, labels array<string>, pinned boolean"
EDGES = "problem long, left_id long, right_id long, conflict boolean, penalty double"


def problem(rng, n, groups, pins=0, edges=0, scores=None):
    rows = []
    for i in range(n):
        kind = rng.choice("abc")
        weight = rng.choice(scores) if scores else rng.random() * (0.2 if kind == "a" else 1)
        rows.append({"item_id": 3 * i, "grp": f"g{rng.randrange(groups)}", "category": kind, "labels": [x for x in "xy" if rng.random() < 0.25], "pinned": i < pins, "weight": round(weight * 1e6) * (n + 1) + n - i})
    ends = [rng.sample(range(n), 2) for _ in range(edges)]
    return rows, [{"left_id": 3 * a, "right_id": 3 * b, "conflict": rng.random() < 0.4, "penalty": round(rng.random() * 350_000) * (n + 1)} for a, b in ends]


def plain(rows, edges, k, cap, quotas, minimums):
    cost, best = {frozenset((e["left_id"], e["right_id"])): None if e["conflict"] else e["penalty"] for e in edges}, None
    for s in combinations(rows, k):
        ids = tuple(r["item_id"] for r in s)
        groups, kinds, labels = Counter(r["grp"] for r in s), Counter(r["category"] for r in s), Counter(x for r in s for x in r["labels"])
        near = [cost[f] for f in map(frozenset, combinations(ids, 2)) if f in cost]
        if any(r["pinned"] and r["item_id"] not in ids for r in rows) or max(groups.values()) > cap or None in near:
            continue
        if all(kinds[c] == n for c, n in quotas.items()) and all(labels[x] >= n for x, n in minimums.items()):
            found = sum(r["weight"] for r in s) - sum(near), ids
            best = min(best or found, found, key=lambda f: (-f[0], f[1]))
    return best


def test_search_equals_all_subsets():
    rng = random.Random(1)
    for _ in range(300):
        k, cap = rng.randint(1, 5), rng.randint(1, 3)
        quotas, minimums = rng.choice([{}, {"a": 1}, {"a": 2, "b": 1}]), rng.choice([{}, {"x": 1}, {"x": 2, "y": 1}])
        if sum(quotas.values()) > k:
            continue
        rows, edges = problem(rng, rng.randint(5, 11), rng.randint(2, 6), rng.choice([0, 0, 1, 2]), rng.choice([0, 3, 10]), rng.choice([None, [0.5], [0.1, 0.2]]))
        search = selection._Search(rows, edges, k, cap, quotas, minimums)
        search.run()
        assert search.best == plain(rows, edges, k, cap, quotas, minimums)


def test_large_problems_end_in_few_steps():
    cases = [(60, 30, 10, {"a": 5}, {}, 0, 0), (60, 30, 8, {}, {"x": 3}, 0, 0), (30, 15, 10, {"a": 3}, {}, 0, 0), (200, 60, 12, {"a": 5, "b": 2}, {"x": 3, "y": 2}, 2, 400), (400, 100, 20, {"a": 6}, {"x": 5}, 3, 4000)]
    for n, groups, k, quotas, minimums, pins, edges in cases:
        search = selection._Search(*problem(random.Random(n), n, groups, pins, edges), k, 2, quotas, minimums)
        search.run()
        assert search.best and search.steps < 3000


def test_statuses_of_large_problems(spark):
    rng = random.Random(4)
    rows = [(p, i, f"g{rng.randrange(30)}", kind := rng.choice("abc"), rng.random() * (0.2 if kind == "a" else 1), [x for x in "xy" if rng.random() < 0.3], False) for p in range(6) for i in range(60)]
    found = selection.select_constrained(spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame([], EDGES), 10, 2, {"a": 5}, {"x": 3}).collect()
    assert len(found) == 6 and all(r["status"] == "optimal" and len(r["selected"]) == 10 for r in found)


def test_rules_query_keeps_its_rules(spark):
    d = "/root/testdata/sf0.01"
    found = further.g4_select_rules(spark, d)
    assert {r["status"] for r in found.select("status").distinct().collect()} <= {"optimal", "category_quota_infeasible", "infeasible"}
    part = spark.read.parquet(f"{d}/part.parquet")
    picked = found.where("status = 'optimal'").select("problem", F.explode("selected").alias("p_partkey")).join(part, "p_partkey").collect()
    by = {}
    for r in picked:
        by.setdefault(r["problem"], []).append(r)
    assert len(by) > 10
    for own in by.values():
        assert len(own) == 6 and max(Counter(r["p_type"] for r in own).values()) <= 2
        assert sum(r["p_name"].startswith("red ") for r in own) == 2 and sum(r["p_name"].endswith(" ring") for r in own) >= 2
        assert any(r["p_partkey"] % 80 == 0 for r in own)
        size = {r["p_partkey"]: r["p_size"] for r in own}
        assert all(size[i] + size.get(i + 1, 0) <= 80 for i in size if i + 1 in size)
