"""Reading the tables and the common shape of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space, as a regular expression.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, doc_id as long and a null text as the empty one."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32(doc_id as text) mod divisor."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts: sizes partitions, chunks and shards in proportion to the input."""
    return int(df.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
