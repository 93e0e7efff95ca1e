"""Scores of single items and of pairs, as column expressions of their signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the four hashes, and of hash, color, time, metadata, name and position.
HASH_WEIGHTS = (0.40, 0.30, 0.20, 0.10)
PAIR_WEIGHTS = {"hash": 0.32, "color": 0.22, "time": 0.18, "meta": 0.12, "name": 0.10, "gps": 0.06}


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def hash_combined_sim(*sims: Column) -> Column:
    """Weighted mean of the hash similarities that are known; 0 if none is."""
    pairs = list(zip(HASH_WEIGHTS, sims, strict=False))
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in pairs), F.lit(0.0))
    got = sum((F.coalesce(w * s, F.lit(0.0)) for w, s in pairs), F.lit(0.0))
    return F.when(total > 1e-6, got / total).otherwise(0.0)


def quality_penalty(reject_a: Column, reject_b: Column, quality_a: Column, quality_b: Column) -> Column:
    """0.08 where one of two is rejected, else 0.002 a point of quality apart above 25."""
    gap = F.abs(quality_a - quality_b)
    return F.when(F.coalesce(reject_a, F.lit(False)) != F.coalesce(reject_b, F.lit(False)), 0.08).when(gap > 25, (gap - 25) * 0.002).otherwise(0.0)


def pair_base_sim(hash: Column, color: Column, time: Column, meta: Column, name: Column, gps: Column, penalty: Column) -> Column:  # noqa: A002
    """Weighted sum less the penalty, not under 0; an unknown color adds its weight to the hash, an unknown position to the metadata."""
    w = PAIR_WEIGHTS
    by_hash = F.when(color.isNull(), w["hash"] + w["color"]).otherwise(w["hash"]) * hash + F.coalesce(w["color"] * color, F.lit(0.0))
    by_meta = F.when(gps.isNull(), w["meta"] + w["gps"]).otherwise(w["meta"]) * meta + F.coalesce(w["gps"] * gps, F.lit(0.0))
    return F.greatest(by_hash + by_meta + w["time"] * time + w["name"] * name - penalty, F.lit(0.0))


def pair_final_sim(base: Column, hash: Column, seconds: Column, inliers: Column) -> Column:  # noqa: A002
    """base corrected by matched points: halved over 30 minutes apart, raised by many points, held at 0.55 by few."""
    n = F.coalesce(inliers, F.lit(0))
    return (
        F.when((base < 0.45) & (hash < 0.65), base).when(F.abs(seconds) > 1800, base * 0.5).when(n >= 80, 0.95).when(n >= 30, F.greatest(base, F.lit(0.85)))
        .when((n < 5) & (base > 0.55), 0.55).otherwise(base)
    )


def quality_flags(blur: Column, light: Column, contrast: Column, over: Column, under: Column, entropy: Column, side: Column) -> Column:
    """Names of all faults of an image, the gravest first."""
    return F.array_compact(F.array(
        F.when(blur < 18, "very_blurry").when(blur < 45, "blurry"),
        F.when((under >= 0.72) | (light < 18), "underexposed"),
        F.when((over >= 0.72) | (light > 240), "overexposed"),
        F.when(contrast < 12, "low_contrast"),
        F.when(entropy < 2.5, "low_information"),
        F.when(side < 480, "too_small"),
    ))


def reject_reason(flags: Column) -> Column:
    """The first flag that rejects; null if none does."""
    return F.get(F.filter(flags, lambda f: f.isin("very_blurry", "underexposed", "overexposed", "low_information")), F.lit(0))


def quality_v1(blur: Column, light: Column, contrast: Column, entropy: Column, side: Column) -> Column:
    """0 to 100 from sharpness, exposure, contrast, entropy and resolution, to 3 decimals."""
    sharp = F.least(F.log1p(blur) / F.log1p(F.lit(900.0)), F.lit(1.0))
    exposure = F.greatest(1 - F.abs(light - 127.5) / 127.5, F.lit(0.0))
    cap = lambda x, top: F.least(x / top, F.lit(1.0))
    return F.round(100 * (0.36 * sharp + 0.23 * exposure + 0.17 * cap(contrast, 64.0) + 0.14 * cap(entropy, 7.5) + 0.10 * cap(side, 2200.0)), 3)


def fused_score(semantic: Column, quality: Column, preference: Column, comparisons: Column) -> Column:
    """Meaning, quality (0 to 100) and preference in one score; what is unknown leaves its weight to the others."""
    q, known = F.coalesce(quality, F.lit(0.0)) / 100.0, comparisons > 0
    with_meaning = F.when(known, 0.62 * semantic + 0.25 * q + 0.13 * preference).otherwise(0.72 * semantic + 0.28 * q)
    return F.when(semantic.isNull(), F.when(known, 0.87 * q + 0.13 * preference).otherwise(q)).otherwise(with_meaning)


def reasons(semantic: Column, aesthetic: Column, technical: Column) -> Column:
    """Sentences for the scores that are known."""
    said = lambda text, x: F.when(x.isNotNull(), F.format_string(text, F.round(x).cast("long")))
    return F.array_compact(F.array(said("meaning %d", semantic), said("aesthetic %d", aesthetic), said("technical %d", technical)))


def grounded_reasons(semantic: Column, quality: Column, preference: Column, comparisons: Column, contextual: bool = False) -> Column:
    """Why an item was taken, in sentences that only state its scores; an unknown meaning is not mentioned.

    Fixed values: the sentences. With `contextual`, preference is the residual of a learned model.
    """
    learned = F.format_string("learned contextual utility residual %+.3f from %d comparisons" if contextual else "personal preference fit %.3f from %d comparisons", preference, comparisons)
    return F.array_compact(F.array(
        F.when(semantic.isNotNull(), F.format_string("semantic similarity %.3f", semantic)), F.format_string("quality %.1f/100", F.coalesce(quality, F.lit(0.0))),
        F.lit("passes reject and collection constraints"), F.when(comparisons > 0, learned),
    ))
