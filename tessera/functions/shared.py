"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Tables written inside each open temporary_tables(), with their folders; a table that is held keeps its id.
_open: list[dict[int, tuple[DataFrame, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set (tests)."""
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_CONF) or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1][id(table)] = table, path
    return table


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes inside are deleted at the end, but for those given to the function it yields.

    Nothing that is used later may still have to be read from the others.
    """
    _open.append({})
    kept: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(_open[-1][id(table)][1])
        return table

    try:
        yield keep
    finally:
        for _, path in _open.pop().values():
            if path not in kept:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete a table that materialize() wrote inside the open temporary_tables(); nothing may still have to be read from it."""
    _delete(table.sparkSession, _open[-1].pop(id(table))[1])


def with_positions(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with each row's place, from 0, in an order over all rows: a range sort, then one count a partition at the driver."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "positions")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _start long")
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + row).drop("_at", "_part", "_start")
