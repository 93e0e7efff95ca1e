"""Hashes, signals and quality of gray images, given as arrays of luma values (0 to 255) row by row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_difference_hash(luma: Column, width: int) -> Column:
    """Bits of the values above their left neighbour, row by row."""
    places = F.filter(F.sequence(F.lit(1), F.size(luma) - 1), lambda i: i % width != 0)
    return F.transform(places, lambda i: (F.get(luma, i) > F.get(luma, i - 1)).cast("int"))


def _bits(values: np.ndarray) -> list[int]:
    return (values > np.median(values)).astype(int).ravel().tolist()


def _side(luma: np.ndarray | None) -> int:
    """The side of a square image; 0 if it is none."""
    side = 0 if luma is None else int(len(luma) ** 0.5)
    return side if side and side * side == len(luma) else 0


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def perceptual_hash(luma: pd.Series) -> pd.Series:
    """Bits of the lowest quarter of frequencies a side above their median; null if the image isn't square with a side of 4 n, n >= 2."""
    waves: dict[int, np.ndarray] = {}

    def of(v):
        side = _side(v)
        if side < 8 or side % 4:
            return None
        if side not in waves:
            waves[side] = 2 * np.cos(np.pi * np.outer(np.arange(side // 4), np.arange(side) + 0.5) / side)
        w = waves[side]
        return _bits(w @ np.asarray(v, float).reshape(side, side) @ w.T)

    return luma.map(of)


def block_means_bits(luma: np.ndarray | None, size: int) -> list[int] | None:
    """Bits of the size x size block means of one image; None unless side and size are powers of two, 2 <= size <= side."""
    side = _side(luma)
    if size < 2 or size & (size - 1) or side < size or side & (side - 1):
        return None
    # sums of whole numbers are exact; removing the mean and scaling would not change their order
    return _bits(np.asarray(luma, float).reshape(size, side // size, size, side // size).sum(axis=(1, 3)))


def wavelet_hash(luma: Column, size: int) -> Column:
    """Bits of the size x size block means above their median; null unless side and size are powers of two, size <= side."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pooled(values: pd.Series) -> pd.Series:
        return values.map(lambda v: block_means_bits(v, size))

    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    return pooled(luma)


def pixel_signals(luma: Column, width: int) -> Column:
    """struct(blur, brightness, contrast, over, under, entropy) of each image; null for an image with no whole row.

    blur: variance of the four-neighbour Laplacian, borders mirrored; over and under: shares at 250 and more, 5 and less.
    """
    names = ["blur", "brightness", "contrast", "over", "under", "entropy"]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def measured(values: pd.Series) -> pd.DataFrame:
        def of(v):
            if v is None or not len(v) or len(v) % width:
                return [None] * len(names)
            gray = np.asarray(v, float).reshape(-1, width)
            p = np.pad(gray, [(int(n > 1),) * 2 for n in gray.shape], mode="reflect")
            p = np.pad(p, [(int(n == 1),) * 2 for n in gray.shape], mode="edge")
            edges = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * gray
            share = np.unique(gray, return_counts=True)[1] / gray.size
            return [edges.var(), gray.mean(), gray.std(), (gray >= 250).mean(), (gray <= 5).mean(), -(share * np.log2(share)).sum() + 0.0]

        return pd.DataFrame([of(v) for v in values], columns=names)

    return measured(luma)


#: Thresholds of the two profiles, standard and advanced.
THRESHOLDS = {
    "subject_sharp": (750.0, 1100.0), "very_subject_sharp": (550.0, 650.0), "very_blur_combined": (0.28, 0.35), "motion_anisotropy": (0.62, 0.55),
    "edge_width_pix": (5.0, 4.0), "dark_mean": (22.0, 28.0), "bright_mean": (235.0, 228.0), "dead_shadow": (0.82, 0.70), "dead_highlight": (0.82, 0.70),
    "low_contrast": (10.0, 14.0), "low_entropy": (0.85, 1.20), "min_long_side": (640, 900), "min_file_size": (25_000, 40_000), "horizon_tilt_deg": (4.5, 3.0),
    "horizon_severe_deg": (15.0, 12.0), "score_adjust": (0.0, -6.0), "score_floor": (35.0, 45.0), "color_noise_high": (0.75, 0.60), "color_cast_high": (28.0, 22.0),
    "dynamic_range_low": (30.0, 40.0),
}
#: Points off for each flag, in the order in which a flag gives the reason, and the flags that reject.
PENALTIES = {
    "motion_blur": 22, "very_blurry": 22, "subject_blurry": 12, "horizon_severe": 22, "underexposed": 22, "overexposed": 22, "low_information": 22, "too_small": 6,
    "tiny_file": 6, "horizon_tilt": 12, "low_contrast": 12, "color_noise": 8, "color_cast": 8, "flat_tone": 8,
}
HARD = ("motion_blur", "very_blurry", "horizon_severe", "underexposed", "overexposed", "low_information", "too_small", "tiny_file")


def quality_flags_v2(profile: str) -> Column:
    """Faults of an image by the columns of its signals, in the order of PENALTIES; an unknown signal is no fault."""
    at = 1 if profile in ("advanced", "aggressive") else 0
    c, t = F.col, {k: v[at] for k, v in THRESHOLDS.items()}
    soft = c("salient_sharpness") < t["subject_sharp"]
    very = F.coalesce(c("salient_sharpness") < t["very_subject_sharp"], F.lit(False)) | F.coalesce(c("blur_combined") < t["very_blur_combined"], F.lit(False))
    moving = F.coalesce(
        (c("motion_anisotropy") > t["motion_anisotropy"]) & (c("edge_width_pix") > t["edge_width_pix"]) & soft & F.coalesce(c("focus_ratio") < 5, F.lit(True)), F.lit(False)
    )
    dark = (c("brightness_mean") < t["dark_mean"]) | (c("underexposed_ratio") >= t["dead_shadow"]) | ((c("worst_clip_dark") >= t["dead_shadow"]) & (c("brightness_mean") < 3 * t["dark_mean"]))
    light = (c("brightness_mean") > t["bright_mean"]) | (c("overexposed_ratio") >= t["dead_highlight"]) | ((c("worst_clip_bright") >= t["dead_highlight"]) & (c("brightness_mean") > t["bright_mean"] - 20))
    severe = c("horizon_tilt_deg") > t["horizon_severe_deg"]
    faults = {
        "motion_blur": moving & ~very, "very_blurry": very, "subject_blurry": soft & ~very & ~moving, "horizon_severe": severe, "underexposed": dark, "overexposed": light,
        "low_information": c("entropy") < t["low_entropy"], "too_small": F.greatest("width", "height") < t["min_long_side"],
        "tiny_file": (c("file_size") > 0) & (c("file_size") < t["min_file_size"]), "horizon_tilt": (c("horizon_tilt_deg") > t["horizon_tilt_deg"]) & ~severe,
        "low_contrast": c("contrast_score") < t["low_contrast"], "color_noise": c("color_noise") > t["color_noise_high"], "color_cast": c("color_cast") > t["color_cast_high"],
        "flat_tone": c("dynamic_range") < t["dynamic_range_low"],
    }
    return F.array_compact(F.array(*(F.when(faults[name], name) for name in PENALTIES)))


def quality_v2_of(flags: Column, profile: str) -> dict[str, Column]:
    """quality_score (0 to 100, 3 decimals), auto_reject and reject_reason from the flags and the columns of the signals.

    The reason is the first flag where one rejects, low_quality where the score alone does.
    """
    at = 1 if profile in ("advanced", "aggressive") else 0
    parts = (
        F.col("blur_combined") * 35 + F.greatest(25 - F.abs(F.col("brightness_mean") - 128) / 128 * 25, F.lit(0.0)) + F.least(F.col("contrast_score") / 64 * 20, F.lit(20.0))
        + F.least(F.col("entropy") / 7 * 10, F.lit(10.0)) + F.coalesce("composition", F.lit(0.5)) * 10 + THRESHOLDS["score_adjust"][at]
    )
    off = sum((F.when(F.array_contains(flags, name), float(points)).otherwise(0.0) for name, points in PENALTIES.items()), F.lit(0.0))
    hard = F.arrays_overlap(flags, F.array(*map(F.lit, HARD)))
    score = F.least(F.greatest(parts - off, F.lit(0.0)), F.lit(100.0))
    low = score < THRESHOLDS["score_floor"][at]
    return {"quality_score": F.round(score, 3), "auto_reject": hard | low, "reject_reason": F.when(hard, F.get(flags, F.lit(0))).when(low, "low_quality")}


def quality_v2(images: DataFrame, profile: str) -> DataFrame:
    """images with flags, quality_score, auto_reject and reject_reason."""
    return images.withColumn("flags", quality_flags_v2(profile)).withColumns(quality_v2_of(F.col("flags"), profile))


def meta_sim(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Mean of what both images know of camera and lens (equal: 1), focal length (within 25 mm) and aperture (within 4 stops); 0 if nothing."""
    number = lambda x, cut: F.when(F.trim(x).rlike(r"^\S+$"), F.regexp_replace(F.trim(x), cut, "").try_cast("double"))
    near = lambda name, cut, reach: F.greatest(1 - F.abs(number(a[name], cut) - number(b[name], cut)) / reach, F.when(number(a[name], cut).isNotNull() & number(b[name], cut).isNotNull(), 0.0))
    parts = [(a["camera"] == b["camera"]).cast("double"), (a["lens"] == b["lens"]).cast("double"), near("focal", "(mm)+$", 25.0), near("aperture", "^f/", 4.0)]
    known = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(known > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / known).otherwise(0.0)


def item_features(semantic: Column, quality: Column, blur: Column, metadata: Column, width: Column, height: Column) -> Column:
    """The seven features of an item, each 0 to 1 where its input is: meaning, quality, sharpness, brightness, contrast, landscape, portrait."""
    told = lambda key, other: F.coalesce(F.get_json_object(metadata, f"$.{key}").try_cast("double"), F.lit(other))
    cap = lambda x: F.least(x, F.lit(1.0))
    wide, high = (F.greatest(F.coalesce(x, F.lit(1)), F.lit(1)) for x in (width, height))
    return F.array(
        F.greatest(F.coalesce(semantic, F.lit(0.0)), F.lit(0.0)), F.coalesce(quality, F.lit(0.0)) / 100,
        cap(F.log1p(F.greatest(F.coalesce(blur, F.lit(0.0)), F.lit(0.0))) / F.log1p(F.lit(900.0))), cap(F.greatest(told("brightness", 127.5) / 255, F.lit(0.0))),
        cap(told("contrast", 0.0) / 64), (wide > high * 1.08).cast("double"), (high > wide * 1.08).cast("double"),
    )
