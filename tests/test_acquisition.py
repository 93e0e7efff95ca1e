import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import acquisition
from tessera.operators.acquisition import after_answer, best_sets, posterior_draws, standard_normals, suggest_pairs

CANDIDATES = "problem long, item_id long, grp string, base double, features array<double>, value double, ids array<long>"
MODELS = "problem long, mean array<double>, covariance array<double>"
PAIRS = "problem long, left_id long, right_id long"


def chance(m):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, m))))


def value(us, chosen):
    return sum(round(us[i] * 1e6) / 1e6 for i in chosen)


def best(us, groups, k, cap):
    """By trying all sets; of equally good ones the one with the earlier items."""
    sets = [s for s in combinations(range(len(us)), k) if all(sum(groups[i] == g for i in s) <= cap for g in set(groups))]
    return max(sets, key=lambda s: sum(round(us[i] * 1e6) * (len(us) + 1) + len(us) - i for i in s))


def root_of(covariance):
    values, vectors = np.linalg.eigh(covariance)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T


def plain(pool, mean, covariance, normals, k, cap, excluded):
    """Loss and value of every pair, with loops; rows of (left, right, value, raw, loss if left, loss if right)."""
    pool = sorted(pool)
    groups, mean, covariance = [p[1] for p in pool], np.array(mean), np.array(covariance)
    use = lambda m, root: [[float((m + z @ root) @ np.array(p[3])) + p[2] for p in pool] for z in normals]
    at = lambda m: [float(m @ np.array(p[3])) + p[2] for p in pool]
    us = use(mean, root_of(covariance))
    loss = lambda us, now, w: max(0.0, sum(x * (value(u, best(u, groups, k, cap)) - value(u, now)) for x, u in zip(w, us, strict=True)))
    even = [1 / len(us)] * len(us)
    present = best(at(mean), groups, k, cap)
    now = loss(us, present, even)
    rows = []
    for i, j in combinations(range(len(pool)), 2):
        if (pool[i][0], pool[j][0]) in excluded:
            continue
        p = [chance(u[i] - u[j]) for u in us]
        after = []
        for wins in (True, False):
            w = [x if wins else 1 - x for x in p]
            w = [x / sum(w) for x in w]
            if 1 / sum(x * x for x in w) >= min(len(w) / 4, 16):
                mixed = [sum(x * u[c] for x, u in zip(w, us, strict=True)) for c in range(len(pool))]
                after.append(loss(us, best(mixed, groups, k, cap), w))
            else:
                m, s = after_answer(mean, covariance, np.array(pool[i][3]) - np.array(pool[j][3]), pool[i][2] - pool[j][2], wins)
                after.append(loss(use(m, root_of(s)), best(at(m), groups, k, cap), even))
        q = sum(p) / len(p)
        raw = now - q * after[0] - (1 - q) * after[1]
        rows.append((pool[i][0], pool[j][0], max(0.0, raw), raw, *after))
    return [pool[c][0] for c in present], now, rows


def problem(rng, name, n, dim, spread, groups=3):
    pool = [(10 * i + name, f"g{rng.integers(groups)}", float(rng.normal()), rng.normal(size=dim).tolist()) for i in range(n)]
    a = rng.normal(size=(dim, dim - 1))
    return pool, rng.normal(size=dim).tolist(), spread * (a @ a.T)


def frames(spark, problems):
    c = [(k, *row, 0.0, [1]) for k, (pool, _, _) in problems.items() for row in pool]
    m = [(k, mean, np.asarray(s).ravel().tolist()) for k, (_, mean, s) in problems.items()]
    return spark.createDataFrame(c, CANDIDATES), spark.createDataFrame(m, MODELS)


def key_hash(spark, k):
    return spark.range(1).select(F.xxhash64(F.lit(str(k)))).first()[0]


def test_equals_trying_every_pair(spark):
    rng = np.random.default_rng(4)
    problems = {1: problem(rng, 1, 6, 3, 0.3), 2: problem(rng, 2, 5, 4, 40.0), 3: problem(rng, 3, 7, 3, 0.05, 2)}
    gone = [(2, 22, 2), (3, 3, 13), (1, 999, 1)]
    candidates, models = frames(spark, problems)
    excluded = spark.createDataFrame(gone, PAIRS)
    found = {r["problem"]: r for r in suggest_pairs(candidates, models, excluded, 3, 2, samples=32, seed=5, shortlist=None).collect()}
    for k, (pool, mean, s) in problems.items():
        pairs = {tuple(sorted(g[1:])) for g in gone if g[0] == k}
        present, now, rows = plain(pool, mean, s, standard_normals(5, key_hash(spark, k), 0, 32, len(mean)), 3, 2, pairs)
        rows = [r for r in rows if r[3] >= -1e-8]
        want = min(rows, key=lambda r: (-round(r[2], 12), -round(r[3], 12), r[0], r[1]))
        r = found[k]
        assert r["status"] == "suggested" and sorted(r["present"]) == sorted(present)
        assert (r["left_id"], r["right_id"]) == want[:2]
        assert np.allclose([r["value"], r["raw_value"], r["regret_left"], r["regret_right"], r["present_regret"]], [*want[2:], now], atol=1e-9)
        assert r["eligible"] == r["evaluated"] == len(pool) * (len(pool) - 1) // 2 - len(pairs & {(a[0], b[0]) for a, b in combinations(sorted(pool), 2)})


def test_few_effective_draws_are_made_anew(spark):
    rng = np.random.default_rng(6)
    pool = [(1, "a", 5.0, rng.normal(size=3).tolist()), (2, "b", 0.0, rng.normal(size=3).tolist())]
    mean, s = [0.1, 0.0, -0.1], 0.8 * np.eye(3)
    candidates, models = frames(spark, {1: (pool, mean, s)})
    r = suggest_pairs(candidates, models, spark.createDataFrame([], PAIRS), 1, 1, samples=40, seed=2).first()
    _, now, [want] = plain(pool, mean, s, standard_normals(2, key_hash(spark, 1), 0, 40, 3), 1, 1, set())
    assert r["redrawn_left"] or r["redrawn_right"]
    assert np.allclose([r["raw_value"], r["regret_left"], r["regret_right"], r["present_regret"]], [*want[3:], now], atol=1e-9)


def test_order_partitions_and_full_shortlist_do_not_matter(spark):
    rng = np.random.default_rng(8)
    candidates, models = frames(spark, {k: problem(rng, k, 12, 4, 0.2) for k in range(4)})
    none = spark.createDataFrame([], PAIRS)
    run = lambda c, n: sorted(tuple(map(str, r)) for r in suggest_pairs(c, models, none, 4, 2, samples=48, seed=17, shortlist=n).collect())
    whole = run(candidates, None)
    assert run(candidates.orderBy(F.desc("item_id")).repartition(5), 66) == whole
    short = suggest_pairs(candidates, models, none, 4, 2, samples=48, seed=17, shortlist=5).collect()
    assert all(r["evaluated"] == 5 and r["eligible"] == 66 and r["value"] >= 0 for r in short)


def test_shown_pairs_are_not_suggested_again(spark):
    candidates = spark.createDataFrame([(1, i, g, b, [s, -s], 0.0, [1]) for i, g, b, s in ((1, "a", 0.7, 0.6), (2, "b", 0.7, -0.6), (3, "c", 0.6, 0.0))], CANDIDATES)
    models = spark.createDataFrame([(1, [0.0, 0.0], [0.2, 0.0, 0.0, 0.2])], MODELS)
    seen = []
    for _ in range(3):
        r = suggest_pairs(candidates, models, spark.createDataFrame(seen, PAIRS), 1, 1, samples=32, seed=3).first()
        assert (r["left_id"], r["right_id"]) not in [s[1:] for s in seen]
        seen += [(1, r["left_id"], r["right_id"]), (1, r["right_id"], r["left_id"])]
    assert suggest_pairs(candidates, models, spark.createDataFrame(seen, PAIRS), 1, 1).first()["status"] == "no_pair"


def test_statuses_and_odd_rows(spark):
    f = [1.0, 0.0]
    rows = [(1, 1, "a", 0.1, f), (1, 2, "a", 0.2, f), (2, 1, "a", 0.1, f), (2, 2, "b", 0.2, f), (3, 1, "a", 0.3, f), (4, 1, "a", 0.1, None), (4, None, "a", 0.1, f), (None, 1, "a", 0.1, f), (5, 1, "a", 0.1, f), (5, 1, "a", 0.1, f), (5, 2, "b", 0.1, f)]
    rows += [(6, i, f"g{i}", 0.1, f) for i in range(6)]
    candidates = spark.createDataFrame([(*r, 0.0, [1]) for r in rows], CANDIDATES)
    models = spark.createDataFrame([(k, f, [1.0, 0.0, 0.0, 1.0]) for k in (1, 3, 4, 5, 6)] + [(2, f, [1.0, 0.0, 0.0, -1.0])], MODELS)
    none = spark.createDataFrame([], PAIRS)
    found = {r["problem"]: r["status"] for r in suggest_pairs(candidates, models, none, 1, 1, limit=5).collect()}
    assert found == {1: "suggested", 2: "no_model", 3: "no_pair", 4: "infeasible", 5: "suggested", 6: "too_large"}
    assert {r["problem"]: r["status"] for r in suggest_pairs(candidates, models, none, 2, 1, limit=9).collect()}[1] == "infeasible"
    assert suggest_pairs(candidates.limit(0), models, none, 1, 1).count() == 0


def test_failed_invariants_are_tried_with_more_samples(spark, monkeypatch):
    rng = np.random.default_rng(1)
    candidates, models = frames(spark, {1: problem(rng, 1, 5, 3, 0.2)})
    monkeypatch.setattr(acquisition, "TOLERANCE", -1e9)
    r = suggest_pairs(candidates, models, spark.createDataFrame([], PAIRS), 2, 2, samples=16).first()
    assert (r["status"], r["samples"]) == ("numerical_error", 32)


def test_best_sets_are_best():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(4, 9))
        us, groups = np.round(rng.normal(size=(3, n)), 1), rng.integers(0, 3, n)
        k, cap = int(rng.integers(1, 4)), 2
        if sum(min(cap, int((groups == g).sum())) for g in set(groups)) < k:
            continue
        found = best_sets(us, groups, k, cap)
        assert [tuple(np.flatnonzero(r)) for r in found] == [best(u, groups.tolist(), k, cap) for u in us]


def test_answer_update_is_the_mode():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(4, 4))
    mean, s, gap = rng.normal(size=4), a @ a.T + np.eye(4), rng.normal(size=4)
    for wins in (True, False):
        m, c = after_answer(mean, s, gap, 0.3, wins)
        p = chance(0.3 + float(m @ gap))
        assert np.allclose(np.linalg.solve(s, m - mean) + (p - wins) * gap, 0, atol=1e-9)
        assert np.allclose(np.linalg.inv(c), np.linalg.inv(s) + p * (1 - p) * np.outer(gap, gap))


def test_draws(spark):
    a = np.array([[1.0, 0.5, 0.0], [0.5, 2.0, 0.3], [0.0, 0.3, 0.5]])
    flat = np.outer([1.0, 2.0, -1.0], [1.0, 2.0, -1.0])
    rows = [(1, [1.0, -2.0, 0.5], a.ravel().tolist()), (2, [0.0, 0.0, 0.0], flat.ravel().tolist()), (3, [0.0, 0.0, 0.0], (-a).ravel().tolist()), (4, [0.0, 0.0], a.ravel().tolist()), (5, None, None), (6, [math.nan], [1.0]), (7, [1.0], [None]), (None, [1.0], [1.0])]
    models = spark.createDataFrame(rows, MODELS)
    found = posterior_draws(models, "problem", 6000, seed=9).toPandas().sort_values(["problem", "draw"])
    assert found.groupby("problem").size().to_dict() == {1: 6000, 2: 6000}
    x = np.stack(found[found["problem"] == 1]["theta"].to_numpy())
    assert np.allclose(x.mean(axis=0), rows[0][1], atol=0.08) and np.allclose(np.cov(x.T), a, atol=0.12)
    y = np.stack(found[found["problem"] == 2]["theta"].to_numpy())
    assert np.linalg.matrix_rank(y, tol=1e-3) == 1 and np.allclose(np.cov(y.T), flat, atol=0.3)
    few = posterior_draws(models.repartition(3), "problem", 50, seed=9).toPandas().sort_values(["problem", "draw"])
    assert np.array_equal(np.stack(few["theta"].to_numpy()), np.stack(found[found["draw"] < 50]["theta"].to_numpy()))
    assert posterior_draws(models, "problem", 0).count() == 0 and posterior_draws(models.limit(0), "problem", 3).count() == 0
