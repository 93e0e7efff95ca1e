import pytest
from pyspark.sql import functions as F

from tessera.functions.requests import extract_constraints, has_semantic_content, normalized_request, numeral

GOOD = [  # text, count, quality, per group, rejects excluded, people, categories
    ("选 8 张夜景，质量至少 65，相似组最多 2 张", 8, 65.0, 2, True, {}, {}),
    ("Pick 5 photos of night, quality at least 70, maximum 3 per similarity group, include blurry", 5, 70.0, 3, False, {}, {}),
    ("选3张，至少2张有我", 3, 0.0, 1, True, {"me": 2}, {}),
    ("选3张，至少2张有“Alex”", 3, 0.0, 1, True, {"alex": 2}, {}),
    ('pick 3 photos, at least 2 photos with "Alex"', 3, 0.0, 1, True, {"alex": 2}, {}),
    ("pick 3 photos, at least 2 photos with me", 3, 0.0, 1, True, {"me": 2}, {}),
    ("at least 2 photos with me, select 5 photos", 5, 0.0, 1, True, {"me": 2}, {}),
    ("选5张，0张人5张风景", 5, 0.0, 1, True, {}, {"portrait": 0, "landscape": 5}),
    ("选6张，一张人物和五张风景", 6, 0.0, 1, True, {}, {"portrait": 1, "landscape": 5}),
    ("十二张风景", 12, 0.0, 1, True, {}, {"landscape": 12}),
    ("sunset over the sea", 12, 0.0, 1, True, {}, {}),
    ("选３张　质量>=７０.５", 3, 70.5, 1, True, {}, {}),
    ('选9张，至少2张有“Ann”，至少3张有“ann”，至少1张有“Bob”', 9, 0.0, 1, True, {"ann": 3, "bob": 1}, {}),
    ("选4张 允许模糊 质量不低于 8 相似照片不超过 4 张", 4, 8.0, 4, False, {}, {}),
]
BAD = [
    ("", "empty"), (" \n ", "empty"), (None, "empty"), ("选3张不同的人", "different_people"), ("选6张，至少1张人5张风景", "inexact_category"), ("选6张，不要1张人5张风景", "inexact_category"),
    ("不超过12张人像", "inexact_category"), ("十二三张人像", "category_number"), ("2三张人", "category_number"), ("60张风景", "category_number"), ("选6张，1张人2张人5张风景", "category_conflict"),
    ("选9张，至少0张有我", "person_minimum"), ("选9张，至少51张有我", "person_minimum"), ("选6张，一张人5张建筑", "unknown_category"), ("选9张，至少2张夜景", "unknown_condition"),
    ("选9张，不要自拍", "unknown_condition"), ("选9张，至少2张有Alex", "unknown_condition"), ("pick 9 photos, at least 2 photos of night", "unknown_condition"),
    ("pick 9 photos, no selfies", "unknown_condition"), ("选9张，最多2张有我", "unknown_condition"), ("选9张，至少两张有我", "unknown_condition"), ("选9张，不要有自拍", "unknown_condition"),
    ("选6张，选9张", "total_conflict"), ("选0张", "total"), ("选51张", "total"), ("选99999999999999999999张", "total"), ("选6张，2张人5张风景", "quotas"), ("选6张，1张人4张风景", "quotas"),
    ("选3张，质量至少 101", "min_quality"), ("选3张，相似组最多 0 张", "max_per_group"), ("选3张，相似组最多 11 张", "max_per_group"),
]


def test_golden_requests(spark):
    df = spark.createDataFrame([(i, t[0], "x") for i, t in enumerate(GOOD)], "n int, text string, _text string")
    found = {r["n"]: r for r in extract_constraints(df).collect()}
    for i, want in enumerate(GOOD):
        r = found[i]
        assert (r["error"], r["_text"]) == (None, "x"), want
        assert (r["target_count"], r["min_quality"], r["max_per_group"], r["exclude_rejects"], r["person_minimums"], r["category_counts"]) == want[1:], want


def test_conflicts_are_errors(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BAD)], "n int, text string")
    found = {r["n"]: r for r in extract_constraints(df).collect()}
    assert [(t, found[i]["error"]) for i, (t, _) in enumerate(BAD)] == BAD
    assert all(r["target_count"] is None and r["category_counts"] is None for r in found.values())
    assert extract_constraints(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        extract_constraints(df.withColumn("error", F.lit(1)))


def test_no_python_in_the_plan(spark):
    df = extract_constraints(spark.createDataFrame([("选3张",)], "text string"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_normalized(spark):
    cases = [
        ("挑出最有代表性的6张照片，一张人5张风景", 6, {"portrait": 1, "landscape": 5}), ("挑出最有代表性的6张照片，1张人像、五张风景", 6, {"portrait": 1, "landscape": 5}),
        ("选六张，一张人物和五张风景", 6, {"portrait": 1, "landscape": 5}), ("一张人5张风景", 6, {"portrait": 1, "landscape": 5}), ("挑4张风景", 4, {"landscape": 4}),
        ("选 8长 夜景", 8, {}), ("选出 7 张", 7, {}), ("挑二十一张", 21, {}), ("找出十张", 10, {}),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, text string").withColumn("text", normalized_request(F.col("text")))
    assert [(r["error"], r["target_count"], r["category_counts"]) for r in extract_constraints(df).orderBy("n").collect()] == [(None, *c[1:]) for c in cases]
    clash = spark.createDataFrame([("挑出最有代表性的6张照片，选9张",), ("选六张，选九张",)], "text string").withColumn("text", normalized_request(F.col("text")))
    assert {r["error"] for r in extract_constraints(clash).collect()} <= {"total_conflict", None}


def test_numerals_and_content(spark):
    words = {"0": 0, "零": 0, "两": 2, "十": 10, "十二": 12, "二十": 20, "九十九": 99, "二二": None, "": None, "十十": 10, "007": 7}
    rows = spark.createDataFrame(list(words.items()), "t string, n int").select("t", numeral(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == words
    texts = {t[0]: False for t in GOOD[2:6]} | {"选 8 张夜景": True, "please pick 5 photos of night": True, "!!": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", has_semantic_content(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts
