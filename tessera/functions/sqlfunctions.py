"""The library's functions under SQL names for one session.

Functions of columns become SQL functions whose bodies are the columns' own expressions, so there is one definition
of each and the optimizer sees through it. What needs Python is an Arrow UDF, and what gives many rows for one is a
table function for LATERAL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import images, scalars, signals, text

FUNCTIONS = {
    "hamming64(a BIGINT, b BIGINT) RETURNS INT": "bit_count(a ^ b)",
    "cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": (
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"
    ),
    "hash_similarity(a BIGINT, b BIGINT) RETURNS DOUBLE": "1 - bit_count(a ^ b) / 64D",
    "time_similarity(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "exp(-abs(a - b) / 60D)",
    "average_hash(luma ARRAY<INT>) RETURNS ARRAY<INT>": "transform(luma, x -> CAST(x > aggregate(luma, 0D, (s, y) -> s + y) / size(luma) AS INT))",
    "difference_hash(luma ARRAY<INT>, width INT) RETURNS ARRAY<INT>": (
        "transform(filter(sequence(1, size(luma) - 1), i -> i % width <> 0), i -> CAST(get(luma, i) > get(luma, i - 1) AS INT))"
    ),
    "bits_to_hex(bits ARRAY<INT>) RETURNS STRING": "lower(lpad(conv(array_join(transform(bits, x -> CAST(x AS STRING)), ''), 2, 16), CAST(size(bits) / 4 AS INT), '0'))",
}

V1_SIGNALS = ("blur", "light", "contrast", "entropy", "side")
V2_SIGNALS = (
    "blur_combined", "brightness_mean", "overexposed_ratio", "underexposed_ratio", "contrast_score", "entropy", "salient_sharpness", "motion_anisotropy", "edge_width_pix", "focus_ratio",
    "horizon_tilt_deg", "composition", "worst_clip_dark", "worst_clip_bright", "color_noise", "color_cast", "dynamic_range", "width", "height", "file_size",
)


def expression_sql(spark: SparkSession, column: Column, names: Iterable[str]) -> str:
    """SQL text of a column over double columns of these names."""
    empty = spark.createDataFrame([], ", ".join(f"{n} double" for n in names))
    return empty.select(column.alias("r"))._jdf.queryExecution().analyzed().expressions().head().child().sql()


def _quality_v2(profile: str) -> Column:
    flags = images.quality_flags_v2(profile)
    return F.struct(flags.alias("flags"), *(c.alias(n) for n, c in images.quality_v2_of(flags, profile).items()))


def _arrow() -> dict[str, Callable]:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def wavelet_hash(luma: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series([images.block_means_bits(v, int(n)) for v, n in zip(luma, size, strict=True)], dtype=object)

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())]))
    def redact_paths(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else text.redacted(t, text.MARK) for t in texts], columns=["text", "n"])

    return {"perceptual_hash": images.perceptual_hash, "wavelet_hash": wavelet_hash, "redact_paths": redact_paths, "median_hash": scalars.median_hash, "step_hash": scalars.step_hash}


def register(spark: SparkSession) -> None:
    """Make all functions known to the session's SQL.

    hamming64, hash_similarity, time_similarity, cosine; average_hash, difference_hash, perceptual_hash,
    wavelet_hash, median_hash, step_hash, bits_to_hex; quality_v1 and quality_v2(profile, signals), a struct of flags,
    quality_score, auto_reject and reject_reason; redact_paths, a struct of text and n. Null arguments give null (a
    text of no paths is itself), a zero vector has no cosine.
    """
    quality = {
        "quality_v1": (V1_SIGNALS, "DOUBLE", expression_sql(spark, signals.quality_v1(*map(F.col, V1_SIGNALS)), V1_SIGNALS), ""),
        "quality_v2": (
            V2_SIGNALS, "STRUCT<flags: ARRAY<STRING>, quality_score: DOUBLE, auto_reject: BOOLEAN, reject_reason: STRING>",
            f"CASE WHEN profile IN ('advanced', 'aggressive') THEN {expression_sql(spark, _quality_v2('advanced'), V2_SIGNALS)} ELSE {expression_sql(spark, _quality_v2('standard'), V2_SIGNALS)} END",
            "profile STRING, ",
        ),
    }
    own = {f"{n}({first}{', '.join(f'{p} DOUBLE' for p in names)}) RETURNS {kind}": body for n, (names, kind, body, first) in quality.items()}
    for head, body in (FUNCTIONS | own).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for name, function in _arrow().items():
        spark.udf.register(name, function)


def register_detector(spark: SparkSession, name: str, detect: Callable[[object], Iterable[tuple]], schema: str) -> None:
    """Make detect, which gives any number of rows for one value, a table function: FROM t, LATERAL name(t.column).

    A null value has no rows.
    """

    class Detector:
        def eval(self, value: object) -> Iterable[tuple]:
            if value is not None:
                yield from detect(value)

    spark.udtf.register(name, F.udtf(Detector, returnType=schema, useArrow=True))
