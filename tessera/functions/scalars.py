"""Scalar functions on columns: the JVM's own expressions, and Arrow batches for whole vectors."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Any = Column | str


def _c(x: Any) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Any, b: Any) -> Column:
    """Inner product in double precision; null if either is null."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Any) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unit(vectors: pd.Series) -> pd.Series:
    """The vector divided by its length, an Arrow batch at a time; null stays null, a zero vector stays itself."""

    def of(v):
        x = np.asarray(v, float)
        return x / (np.sqrt(x @ x) or 1.0)

    return vectors.map(lambda v: None if v is None else of(v))


def bits_to_hex(bits: Any) -> Column:
    """Bits, first one highest, as lower-case hex, a digit for each 4."""
    b = _c(bits)
    return F.lower(F.lpad(F.conv(F.array_join(F.transform(b, lambda x: x.cast("string")), ""), 2, 16), (F.size(b) / 4).cast("int"), "0"))


def bits_to_long(bits: Any) -> Column:
    return F.conv(F.array_join(F.transform(_c(bits), lambda x: x.cast("string")), ""), 2, -10).cast("long")


def hex_to_long(h: Any) -> Column:
    return F.conv(_c(h), 16, -10).cast("long")


def hamming64(a: Any, b: Any) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def hash_sim(a: Any, b: Any) -> Column:
    return 1 - hamming64(a, b) / 64.0


def average_hash(luma: Any) -> Column:
    """Bits of the samples above their mean."""
    l = _c(luma)  # noqa: E741
    mean = F.aggregate(l, F.lit(0.0), lambda s, x: s + x) / F.size(l)
    return F.transform(l, lambda x: (x > mean).cast("int"))


def difference_hash(samples: Any) -> Column:
    """Bits of the samples above the one before."""
    s = _c(samples)
    return F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: (F.get(s, i) > F.get(s, i - 1)).cast("int"))


def _as_long(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes().ljust(8, b"\0")[:8], "little", signed=True)


@F.pandas_udf(T.LongType())
def median_hash(vectors: pd.Series) -> pd.Series:
    """Bit k: component k is above the vector's median; vectors of up to 64 components."""
    return vectors.map(lambda v: None if v is None else _as_long(np.asarray(v) > np.median(v))).astype("Int64")


@F.pandas_udf(T.LongType())
def step_hash(vectors: pd.Series) -> pd.Series:
    """Bit k: component k + 1 is above component k."""
    return vectors.map(lambda v: None if v is None else _as_long(np.diff(v) > 0)).astype("Int64")


def time_sim(t1: Any, t2: Any, half_life: float = 60.0) -> Column:
    """exp(-|seconds apart| / half_life)."""
    return F.exp(-F.abs(_c(t1) - _c(t2)) / half_life)


def gps_sim(lat1: Any, lon1: Any, lat2: Any, lon2: Any, scale: float = 0.0009) -> Column:
    """exp(-distance / scale) in degrees, longitudes shortened by the mean latitude."""
    dlon = (_c(lon1) - _c(lon2)) * F.cos(F.radians((_c(lat1) + _c(lat2)) / 2))
    return F.exp(-F.sqrt((_c(lat1) - _c(lat2)) ** 2 + dlon**2) / scale)


def hist_sim(a: Any, b: Any) -> Column:
    """Inner product clamped to 0 .. 1; null if the lengths differ."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0)))


def name_parts(name: Any) -> tuple[Column, Column]:
    """(prefix, number) of a file name without its extension; number is null if it ends in no digit."""
    stem = F.regexp_replace(_c(name), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)$", 1)
    return F.regexp_replace(stem, r"\d+$", ""), F.when(digits != "", digits.cast("long"))


def name_sim(a: Any, b: Any) -> Column:
    """max(0, 1 - difference / 30) for names of one prefix, else 0."""
    (pa, na), (pb, nb) = name_parts(a), name_parts(b)
    return F.when((pa == pb) & na.isNotNull() & nb.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(na - nb) / 30.0)).otherwise(0.0)


def curation_utility(aesthetic: Any, technical: Any) -> Column:
    """0.65 of the clamped aesthetic score (1 to 10) and 0.35 of the clamped technical score (0 to 100)."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return 0.65 * clip((_c(aesthetic) - 1) / 9.0) + 0.35 * clip(_c(technical) / 100.0)


def learned_score(semantic: Any, aesthetic: Any, technical: Any) -> Column:
    """0.72 semantic + 0.18 aesthetic + 0.10 technical, all clamped; 0.65 and 0.35 without a semantic score."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    a, t = clip((_c(aesthetic) - 1) / 9.0), clip(_c(technical) / 100.0)
    return F.when(_c(semantic).isNull(), 0.65 * a + 0.35 * t).otherwise(0.72 * clip(_c(semantic)) + 0.18 * a + 0.10 * t)


def logistic(x: Any) -> Column:
    """1 / (1 + exp(-x)) with x clipped to -20 .. 20."""
    return 1 / (1 + F.exp(-F.least(F.greatest(_c(x), F.lit(-20.0)), F.lit(20.0))))


def binary_entropy(p: Any, epsilon: float = 1e-12) -> Column:
    q = F.least(F.greatest(_c(p), F.lit(epsilon)), F.lit(1 - epsilon))
    return -(q * F.log(q) + (1 - q) * F.log(1 - q))


def normalize_text(text: Any) -> Column:
    """White space runs as one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), r"[ \t\n\r\f\x0B]+", " ")))


#: Characters of a label at most.
MAX_LABEL = 80


def normalize_label(label: Any, limit: int = MAX_LABEL) -> Column:
    """The trimmed label in composed form; null if it is empty, too long, or holds control or invisible characters.

    "unknown" and "me" are written Unknown and Me, whatever their case.
    """

    @F.pandas_udf("string")
    def compose(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    plain = F.when(~_c(label).rlike(r"\p{C}"), F.regexp_replace(compose(_c(label)), r"(?U)^\s+|\s+$", ""))
    fits = F.when((F.length(plain) > 0) & (F.length(plain) <= limit), plain)
    return F.when(F.lower(fits) == "unknown", "Unknown").when(F.lower(fits) == "me", "Me").otherwise(fits)


def stable_uniform(*keys: Any) -> Column:
    """A number in [0, 1) that only the keys decide: 13 hex digits of their SHA-256."""
    joined = F.concat_ws("|", *(_c(k).cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def canonical_pair(a: Any, b: Any) -> Column:
    return F.struct(F.least(_c(a), _c(b)).alias("low"), F.greatest(_c(a), _c(b)).alias("high"))


def distinct_in_order(values: Any) -> Column:
    return F.array_distinct(_c(values))


def event_time(exif: Any, stamp: Any, modified: Any) -> Column:
    """The first that parses: exif text, ISO text, modification time."""
    return F.coalesce(F.try_to_timestamp(_c(exif), F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(_c(stamp)), _c(modified))
