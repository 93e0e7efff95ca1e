import os
import random

from pyspark.sql import functions as F

from conftest import DATA
from tessera.operators import curation, evaluation, logs, similarity
from tessera.operators.graph import connected_components
from tessera.plans import registry


def test_components_of_random_graph_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(None, 1), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_fold_equals_sequential_scan(spark):
    rng = random.Random(4)
    score = {i: rng.randrange(10) * 1.0 for i in range(40)}
    edges = {(a, b): rng.random() for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.1}
    order = sorted(score, key=lambda i: (-score[i], i))
    kept, want = [], {}
    for i in order:
        near = [(edges.get((min(i, j), max(i, j)), 0), -j) for j in kept if (min(i, j), max(i, j)) in edges]
        want[i] = -max(near)[1] if near else None
        if not near:
            kept.append(i)
    got = similarity.fold_similar(
        spark.createDataFrame(list(score.items()), "item_no long, score double"), spark.createDataFrame([(*k, v) for k, v in edges.items()], "left_no long, right_no long, cosine double")
    )
    assert {r["item_no"]: r["folded_onto"] for r in got.collect()} == want


def test_retrieval_metrics_golden(spark):
    ranked = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcd")], "query_id string, item_id string, rank int")
    grades = spark.createDataFrame(list(zip("qqqq", "abcd", (3, 0, 1, 0), strict=True)), "query_id string, item_id string, grade int")
    m = evaluation.retrieval_metrics(ranked, grades, [1, 2, 4]).first()
    assert (m["rr"], m["p_1"], m["p_2"], m["p_4"], m["r_1"], m["r_2"], m["r_4"], m["ndcg_1"]) == (1.0, 1.0, 0.5, 0.5, 0.5, 0.5, 1.0, 1.0)


def test_bootstrap_is_stable_and_brackets_the_mean(spark):
    rows = spark.createDataFrame([(i % 7, float(i % 3)) for i in range(70)], "g long, v double")
    a, b = (evaluation.bootstrap_ci(rows.repartition(n), "g", "v", 300).first() for n in (1, 5))
    assert a == b and a["low"] <= a["mean"] <= a["high"]
    one = evaluation.bootstrap_ci(rows.where("g = 1"), "g", "v", 50).first()
    assert one["low"] is None


def test_digest_ignores_order(spark):
    rows = spark.createDataFrame([("g", i, i * 2) for i in range(50)], "g string, id long, x long")
    a, b = (logs.snapshot_digest(df, "g", "id", ["x"]).first()["digest"] for df in (rows, rows.orderBy(F.desc("id")).repartition(7)))
    assert a == b


def test_infeasible_selection_is_empty(spark):
    c = spark.createDataFrame([("p", f"i{k}", "g", 1.0) for k in range(5)], "problem string, item_id string, grp string, score double")
    assert curation.select_capped(c, "problem", "grp", 3, 2).count() == 0


def test_search_uses_no_cartesian_product(spark):
    plan = registry.QUERIES["c1_search"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_temporary_tables_are_deleted_but_for_kept_ones(spark):
    from tessera.functions.shared import materialize, temporary_tables

    with temporary_tables(spark) as keep:
        gone = materialize(spark.range(5).toDF("id"), "gone")
        kept = keep(materialize(gone.where("id > 1"), "kept"))
    assert kept.count() == 3
    assert all(not os.path.exists(f.removeprefix("file://")) for f in gone.inputFiles())
