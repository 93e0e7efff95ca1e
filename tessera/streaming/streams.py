"""Event streams; each run takes what is available and leaves its result as a table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.shared import shared_dir
from tessera.operators.learning import fit_by_key
from tessera.operators.logs import activate_models


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def unique_events(stream: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    """One event for each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def segments(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: sessions that end after a gap; 30 minutes apart is still one session."""
    session = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", session.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def counts(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """user_id, start, n of tumbling or sliding windows."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def run_available(result: DataFrame, label: str, mode: str = "complete") -> DataFrame:
    """Run the stream over the available input to its end and read the result back."""
    spark = result.sparkSession
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out")

    query = result.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{root}/out")


#: Partitions of the event log, by a hash of the key.
LOG_BUCKETS = 64


def refresh_models(stream: DataFrame, key: str, dim: int, label: str) -> DataFrame:
    """The active model of every key after the available input: key, mean, covariance, value, rounds, converged, version.

    stream: key, features, margin. Each micro-batch joins the log of events, which is partitioned by a hash of the key, and
    the keys it touches are fitted again over all their events; only their partitions of the log are read. version is the
    number of the batch. A batch that is run again after a failure
    replaces what it wrote, so no event counts twice. An empty input, or one without a usable event, gives no rows.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows = stream.select(key, "features", "margin")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    logged = ", ".join(f"{n} {k}" for n, k in kinds.items()) + ", bucket int"
    ran: list[int] = []

    def refresh(batch: DataFrame, number: int) -> None:
        ran.append(number)
        hashed = batch.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(LOG_BUCKETS)).cast("int"))
        hashed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/log/batch={number}")
        new = spark.read.schema(logged).parquet(f"{root}/log/batch={number}")
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # LOG_BUCKETS at most
        log = spark.read.schema(f"{logged}, batch int").parquet(f"{root}/log").where(F.col("bucket").isin(buckets)).drop("bucket", "batch")
        fit_by_key(log.join(new.select(key).distinct(), key, "left_semi"), key, dim).write.mode("overwrite").parquet(f"{root}/models/version={number}")

    query = rows.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(refresh).start()
    query.awaitTermination()
    columns = f"{key} {kinds[key]}, mean array<double>, covariance array<double>, value double, rounds int, converged boolean, version int"
    models = spark.read.schema(columns).parquet(f"{root}/models") if ran else spark.createDataFrame([], columns)
    dated = models.withColumns({"created_at": F.col("version"), "model_id": F.col("version")})
    return activate_models(dated, [key]).where("active").drop("created_at", "model_id", "active")
