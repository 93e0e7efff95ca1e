import random

from pyspark.sql import functions as F

from tessera.functions import signals
from tessera.operators import catalog, preferences, similarity


def test_exclude_near_equals_brute_force(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(62) for _ in range(6)]
    rows = [("c", i, rng.choice(base) ^ (1 << rng.randrange(60) if rng.random() < 0.5 else 0), 0) for i in range(60)]
    rows += [("c", 60 + i, rows[i][2], 0) for i in range(10)]
    known = {i for _, i, *_ in rows if i % 13 == 5}
    want = {i for _, i, p, _ in rows if i not in known and all((p ^ q).bit_count() > 7 for _, j, q, _ in rows if j in known)}
    got = similarity.exclude_near(spark.createDataFrame(rows, "collection_id string, item_no long, ph long, dh long"), F.col("item_no") % 13 == 5)
    assert {r["item_no"] for r in got.collect()} == want and want


def test_memory_moves_candidates_within_the_limit(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_no long, vec array<double>")
    event = lambda n, choice, q: ("u", n, n, choice, 1, 2, q, [1.0, 0.0] if q else [0.0, 1.0])
    events = spark.createDataFrame([event(1, "preferred", 1), event(2, "preferred", 1), event(3, "preferred", 0), event(4, "tie", 1)], "user_id string, event_id long, ts long, choice string, preferred_no long, rejected_no long, query_no long, query_vec array<double>")
    cases = preferences.memory_cases(events, spark.createDataFrame([("u", [1.0, 0.0])], "user_id string, current_vec array<double>"))
    assert {r["event_id"]: r["skipped"] for r in cases.collect()} == {1: "duplicate_case", 2: None, 3: "irrelevant_query"}
    shown = spark.createDataFrame([("u", "a", [1.0, 0.0]), ("u", "b", [-1.0, 1.0]), ("v", "a", [1.0, 0.0])], "user_id string, item_id string, vec array<double>")
    assert {(r["user_id"], r["item_id"]): round(r["delta"], 9) for r in preferences.memory_rerank(cases, items, shown).collect()} == {("u", "a"): 0.075, ("u", "b"): -0.15}
    assert preferences.memory_rerank(cases.where("false"), items, shown).count() == 0


def test_final_similarity_edges(spark):
    rows = [(0.44, 0.6, 0, 99, 0.44), (0.7, 0.9, 1801, 99, 0.35), (0.7, 0.9, 1800, 80, 0.95), (0.7, 0.9, 0, 30, 0.85), (0.9, 0.9, 0, 30, 0.9), (0.7, 0.9, 0, 4, 0.55), (0.7, 0.9, 0, 5, 0.7), (0.5, 0.9, 0, None, 0.5)]
    df = spark.createDataFrame([(float(a), float(b), float(c), n, w) for a, b, c, n, w in rows], "base double, h double, sec double, n int, want double")
    assert df.where(signals.pair_final_sim(F.col("base"), F.col("h"), F.col("sec"), F.col("n")) != F.col("want")).count() == 0


def test_judgements_of_a_batch(spark):
    schema = "query_id string, item_id long, grade int"
    old, new = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], schema), spark.createDataFrame([("q", 1, 3), ("q", 2, 2), ("q", 2, 3), ("q", 9, 1)], schema)
    merged, refused = catalog.merge_judgments(old, new, spark.createDataFrame([(1,), (2,)], "item_id long"))
    assert sorted(map(tuple, merged.collect())) == [("q", 1, 3), ("q", 2, 1)]
    assert sorted((r["item_id"], r["reason"]) for r in refused.collect()) == [(2, "duplicate"), (2, "duplicate"), (9, "foreign")]


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "m", "f" * 64), (2, "m", "zz")], "id long, provider string, digest string")
    fresh = catalog.is_fresh("m", [("id", "id")], "digest")
    current, stale = catalog.split_stale(rows, fresh)
    assert [r["id"] for r in current.collect()] == [1] and stale.count() == 2
    cases = spark.createDataFrame([(3, 1, 2), (1, 2, 1), (2, None, 1)], "id long, left long, right long")
    blind = catalog.blind_cases(cases, 1)
    assert {r["id"] for r in blind.collect()} == {1, 2} and catalog.blind_cases(cases.where("false"), 1).count() == 0
    claims = spark.createDataFrame([("r", "c1", None), ("r", "c2", "ok")], "run_id string, claim_id string, text string")
    cites = spark.createDataFrame([("r", "c2", 5)], "run_id string, claim_id string, item_id long")
    found = {(r["claim_id"], r["violation"]) for r in catalog.validate_citations(claims, cites, cites.select("run_id", "item_id")).collect()}
    assert found == {("c1", "text"), ("c1", "uncited")}
