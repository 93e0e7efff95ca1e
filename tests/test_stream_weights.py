import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators.learning import online_weights
from tessera.streaming.weights import WeightLog

SCHEMA = "user_id long, ts timestamp, event_id long, features array<double>"
START = datetime(2024, 3, 1)


def events(n, seed=1):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), START + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(10**6)), i, [rng.randint(-9, 9) / 10 for _ in range(7)]) for i in range(n)]
    rows += [(1, START + timedelta(seconds=100), 9001, [0.5] * 7), (1, START + timedelta(seconds=100), 9000, [-0.3] * 7), (None, START, 9002, [1.0] * 7), (2, START, 9003, None)]
    return rows


def put(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def known(df):
    return {r["user_id"]: (r["n"], r["weights"]) for r in df.collect()}


def batch(spark, rows):
    return known(online_weights(spark.createDataFrame(rows, SCHEMA)))


def log_of(spark, tmp_path, **more):
    return WeightLog(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "root"), late="30 minutes", files_at_once=1, **more)


def test_unordered_batches_restart_and_late_rows(spark, tmp_path):
    rows = events(300)
    rng = random.Random(5)
    rows.sort(key=lambda r: r[1] + timedelta(seconds=rng.randrange(1700)))  # out of order by less than the watermark's delay
    third = len(rows) // 3
    for part in (rows[:third], rows[third : 2 * third]):
        put(spark, part, tmp_path / "in")
    log = log_of(spark, tmp_path)
    assert log.run() == 0
    begun = known(log.weights())
    assert begun and sum(n for n, _ in begun.values()) < 2 * third
    put(spark, rows[2 * third :], tmp_path / "in")
    again = log_of(spark, tmp_path)  # another object on the same folders goes on from the checkpoint
    assert again.run() == 0
    late = [(3, START + timedelta(seconds=5), 9100, [0.9] * 7), (4, START + timedelta(seconds=6), 9101, [0.9] * 7)]
    put(spark, late, tmp_path / "in")
    assert again.run() + again.close() == len(late)
    assert known(again.weights()) == batch(spark, rows)
    assert known(again.weights())[1][0] == sum(r[0] == 1 and r[3] is not None for r in rows)


def test_one_file_equals_many(spark, tmp_path):
    rows = events(120, 7)
    put(spark, rows, tmp_path / "in")
    log = log_of(spark, tmp_path)
    log.run()
    log.close()
    assert known(log.weights()) == batch(spark, rows)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    assert log.weights().where(F.col("user_id").isNull()).count() == 0
