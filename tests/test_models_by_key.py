"""Models of every key at once, in batch and refreshed by a stream."""

import random

import numpy as np
import pytest

from tessera.operators import learning
from tessera.streaming import streams

SCHEMA = "user_id string, features array<double>, margin double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    users = ["hot"] * 60 + ["a"] * 25 + ["b"] * 3 + ["far"] * 12
    return [(u, [rng.gauss(0, 9 if u == "far" else 1) for _ in range(3)], rng.gauss(0, 1)) for u in users]


def check(got, rows, spark):
    assert len({r["user_id"] for r in got}) == len(got)
    for r in got:
        own = [x for x in rows if x[0] == r["user_id"]]
        mean, covariance, told = learning.fit_preference(spark.createDataFrame(own, SCHEMA), 3)
        assert np.allclose(r["mean"], mean, atol=1e-6), r["user_id"]
        assert np.allclose(np.reshape(r["covariance"], (3, 3)), covariance, atol=1e-6)
        assert np.isclose(r["value"], told["final"]) and r["converged"]


def test_every_key_has_the_model_of_its_own_events(spark, rows):
    odd = [("a", None, 1.0), ("b", [1.0, 2.0], 0.0), ("b", [1.0, None, 2.0], 0.0), (None, [1.0, 1.0, 1.0], 0.0), ("a", [1.0, 1.0, 1.0], None), ("none", None, None)]
    got = learning.fit_by_key(spark.createDataFrame([*rows, *odd], SCHEMA).selectExpr("*", "1 AS theta", "2 AS _keys").repartition(5), "user_id", 3).collect()
    assert {r["user_id"] for r in got} == {"hot", "a", "b", "far"}
    check(got, rows, spark)
    assert learning.fit_by_key(spark.createDataFrame([], SCHEMA), "user_id", 3).count() == 0


def test_hot_keys_are_dealt_into_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(learning, "PART_EVENTS", 10)
    check(learning.fit_by_key(spark.createDataFrame([*rows, *rows[:5]], SCHEMA).repartition(3), "user_id", 3).collect(), [*rows, *rows[:5]], spark)


def test_a_key_stops_at_its_round_limit(spark, rows):
    got = learning.fit_by_key(spark.createDataFrame(rows, SCHEMA), "user_id", 3, rounds=1).collect()
    assert {r["rounds"] for r in got} == {1} and not all(r["converged"] for r in got)


def test_the_stream_refits_the_keys_it_touches(spark, rows, tmp_path):
    for k, own in enumerate((rows[:40], rows[40:70], rows[70:])):  # "hot" in the first two, "a" in the last two
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.refresh_models(stream, "user_id", 3, "models").collect()
    check(got, rows, spark)
    assert {r["user_id"]: r["version"] for r in got} == {"hot": 1, "a": 2, "b": 2, "far": 2}
    none = tmp_path / "none"
    none.mkdir()
    assert streams.refresh_models(spark.readStream.schema(SCHEMA).parquet(str(none)), "user_id", 3, "models").count() == 0
