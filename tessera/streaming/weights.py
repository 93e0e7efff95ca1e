"""Online preference weights as a stream: state, event-time timers, late events and a restart."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.shared import shared_dir
from tessera.operators.learning import next_weights

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE_METRIC = "numRowsDroppedByWatermark"


class OrderedWeights(StatefulProcessor):
    """Holds a user's events until the watermark is past them, then applies them in the order of (ts, event_id).

    The update depends on the order and micro-batches are not sorted. What the watermark has passed is complete:
    later rows of that time do not reach the state. One timer at the earliest waiting event is enough.
    """

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.weights = handle.getValueState("weights", "n long, weights array<double>")
        self.waiting = handle.getListState("waiting", "micros long, event_id long, features array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = [(int(m), int(e), [float(v) for v in x]) for b in rows for m, e, x in zip(b["micros"], b["event_id"], b["features"], strict=True) if x is not None]
        if new and not pd.isna(key[0]):
            self.waiting.appendList(new)
            self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((r[0], r[1], list(r[2])) for r in self.waiting.get())
        due, rest = [r for r in waiting if r[0] <= passed], [r for r in waiting if r[0] > passed]
        if due:
            n, now = self.weights.get() if self.weights.exists() else (0, [0.0] * self.dim)
            now = np.asarray(now, float)
            for _, _, x in due:
                now, n = next_weights(now, n, np.asarray(x, float)), n + 1
            self.weights.update((n, now.tolist()))
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            else:
                self.waiting.clear()
            yield pd.DataFrame({"user_id": [key[0]], "n": [n], "weights": [now.tolist()]})

    def close(self) -> None:
        pass


def stream_weights(stream: DataFrame, dim: int = 7, late: str = "1 hour") -> DataFrame:
    """user_id, n, weights, a row whenever the watermark lets a user's weights move; the one with the largest n holds.

    stream: user_id, ts, event_id, features. Events may come in any order within `late`; later ones are dropped and
    counted by the query. Rows with a null user or null features move the watermark and change no weights. A
    user's events within the watermark's delay wait in that user's state.
    """
    kind = stream.schema["user_id"].dataType.simpleString()
    rows = stream.select("user_id", "ts", F.unix_micros("ts").alias("micros"), F.col("event_id").cast("long").alias("event_id"), F.col("features").cast("array<double>").alias("features"))
    return rows.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(OrderedWeights(dim), f"user_id {kind}, n long, weights array<double>", "Update", "EventTime")


@dataclass
class WeightLog:
    """A folder of event files and the weights learned from it; each run takes the files that are new.

    root holds the stream's state and what each micro-batch gave, so that a run after a failure or on another
    driver goes on where the last one ended: a batch that is run again replaces its own output.
    """

    spark: SparkSession
    folder: str
    schema: str
    root: str
    dim: int = 7
    late: str = "1 hour"
    files_at_once: int = 1000

    def run(self) -> int:
        """Take all new files; how many rows came too late."""
        before = self.spark.conf.get(PROVIDER_CONF, None)
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_at_once).parquet(self.folder)

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.root}/out/batch={number}")

        self.spark.conf.set(PROVIDER_CONF, PROVIDER)
        try:
            query = stream_weights(stream, self.dim, self.late).writeStream.outputMode("update").option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).foreachBatch(put).start()
        finally:
            self.spark.conf.set(PROVIDER_CONF, before) if before else self.spark.conf.unset(PROVIDER_CONF)
        query.awaitTermination()
        return sum(int(o[LATE_METRIC]) for p in query.recentProgress for o in p["stateOperators"])

    def close(self) -> int:
        """Move the watermark past all events by a row without a user, so that none waits; run, and count late rows."""
        last = self.spark.read.schema(self.schema).parquet(self.folder).agg(F.max("ts").alias("ts"))
        end = last.select(F.lit(None).alias("user_id"), (F.col("ts") + F.expr(f"interval {self.late}") + F.expr("interval 1 second")).alias("ts"), F.lit(None).alias("event_id"), F.lit(None).alias("features"))
        names = {f.name: f.dataType for f in self.spark.read.schema(self.schema).parquet(self.folder).schema}
        end.select(*(F.col(c).cast(names[c]).alias(c) for c in names)).coalesce(1).write.mode("append").parquet(self.folder)
        return self.run()

    def weights(self) -> DataFrame:
        """user_id, n, weights as of the last run."""
        kind = next(p.split()[1] for p in self.schema.split(", ") if p.split()[0] == "user_id")
        out = self.spark.read.schema(f"user_id {kind}, n long, weights array<double>, batch int").parquet(f"{self.root}/out")
        return out.groupBy("user_id").agg(F.max_by(F.struct("n", "weights"), "n").alias("r")).select("user_id", "r.*")


def weights_of(events: DataFrame, label: str, batches: int, dim: int = 7, late: str = "1 hour") -> DataFrame:
    """The weights of a whole log, written to the shared folder by ranges of time and streamed file by file."""
    spark = events.sparkSession
    root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows = events.select("user_id", "ts", "event_id", "features")
    rows.repartitionByRange(batches, "ts").write.parquet(f"{root}/events")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    log = WeightLog(spark, f"{root}/events", schema, root, dim, late, 2)
    log.run()
    log.close()
    return log.weights()
