"""Posterior draws of many models, and the pair of items whose comparison is worth most.

A problem is a pool of candidates with a model; what its selection loses against the best one is known only up to
the draws of the model. A pair is worth the part of that loss which its answer is expected to remove. Problems are
prepared in parallel, their pairs are scored in parallel whatever problem they belong to, and only the short list of
each is worked out in full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, temporary_tables
from tessera.operators.selection import MAX_POOL, pool_pairs

# Samples, short list, the share and number of effective draws below which draws are made anew, the
# tolerance of a negative value, the scale of the objective and the limits of the logistic function and of entropy.
SAMPLES, SHORTLIST, RETRY_SAMPLES = 64, 16, 4096
ESS_SHARE, ESS_MOST = 0.25, 16.0
TOLERANCE, SCALE, CLIP, LEAST_CHANCE = 1e-8, 1_000_000, 40.0, 1e-12
NEGATIVE = -1e-10
#: Pairs that share a grouped task, about, and draws that a task makes at a time.
BUCKET_PAIRS, DRAW_BLOCK = 20_000, 4_096


def standard_normals(seed: int, key: int, first: int, count: int, dim: int) -> np.ndarray:
    """Rows first to first + count of the table of normals that (seed, key) stands for; each has a counter of its own."""
    words = np.array([seed & (1 << 64) - 1, key & (1 << 64) - 1], np.uint64)
    rows = [np.random.Generator(np.random.Philox(key=words, counter=[0, 0, i, 0])).standard_normal(dim) for i in range(first, first + count)]
    return np.array(rows).reshape(count, dim)


def symmetric_root(covariance: np.ndarray) -> np.ndarray | None:
    """The symmetric square root; None unless finite and positive semidefinite but for rounding."""
    if not np.isfinite(covariance).all():
        return None
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return None if values[0] < NEGATIVE else (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T


def posterior_draws(models: DataFrame, key: str, draws: int, seed: int = 0) -> DataFrame:
    """key, draw, theta: draws 0, 1, ... of each model's normal distribution.

    models: key, mean, covariance (dim * dim values by rows). A draw depends on seed, key and its number only, so
    more draws extend fewer ones and partitions do not matter; many draws of one model are spread over tasks. A
    covariance of lower rank is fine; a model with a null, another length, a value that is not finite or a
    negative eigenvalue has no draws.
    """
    kind = models.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                mean = np.asarray(r.mean, float)
                root = symmetric_root(np.asarray(r.covariance, float).reshape(len(mean), -1)) if np.isfinite(mean).all() else None
                if root is not None:
                    count = min(DRAW_BLOCK, draws - r.first)
                    theta = mean + standard_normals(seed, r.hash, r.first, count, len(mean)) @ root
                    yield pd.DataFrame({key: [r.name] * count, "draw": np.arange(r.first, r.first + count), "theta": list(theta)})

    known = models.select(F.col(key).alias("name"), F.xxhash64(F.col(key).cast("string")).alias("hash"), F.col("mean").cast("array<double>").alias("mean"), F.col("covariance").cast("array<double>").alias("covariance"))
    complete = [~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(True)) for c in ("mean", "covariance")]
    known = known.where(F.col("name").isNotNull() & (F.size("mean") > 0) & (F.size("covariance") == F.size("mean") * F.size("mean")) & complete[0] & complete[1])
    blocks = known.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(max(draws, 1) - 1), F.lit(DRAW_BLOCK)))).where(F.lit(draws > 0))
    return blocks.repartition("name", "first").mapInPandas(run, f"`{key}` {kind}, draw int, theta array<double>")


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -CLIP, CLIP)))


def _objective(utilities: np.ndarray) -> np.ndarray:
    return np.rint(utilities * SCALE) / SCALE


def best_sets(utilities: np.ndarray, groups: np.ndarray, k: int, cap: int) -> np.ndarray:
    """For each row of utilities the best k items with at most cap of a group, as booleans; ties to the earlier item.

    Items are taken by falling utility as long as their group has room, which is the best choice under group caps.
    """
    n = utilities.shape[1]
    rank = np.argsort(-(np.rint(utilities * SCALE) * (n + 1) + (n - np.arange(n))), axis=1, kind="stable")
    of, fits = groups[rank], np.zeros(utilities.shape, bool)
    for g in np.unique(groups):
        own = of == g
        fits |= own & (np.cumsum(own, axis=1) <= cap)
    fits &= np.cumsum(fits, axis=1) <= k
    found = np.zeros(utilities.shape, bool)
    np.put_along_axis(found, rank, fits, axis=1)
    return found


def after_answer(mean: np.ndarray, covariance: np.ndarray, gap: np.ndarray, base: float, first_wins: bool) -> tuple[np.ndarray, np.ndarray]:
    """Laplace's normal distribution after one answer to a pair whose features differ by gap.

    The answer moves the mean along covariance . gap only; how far is the root of a monotone function of one number.
    """
    along = covariance @ gap
    spread, prior = max(0.0, float(gap @ along)), base + float(mean @ gap)
    low, high = (0.0, 1.0) if first_wins else (-1.0, 0.0)
    for _ in range(200):
        at = (low + high) / 2
        if at + float(_chance(np.array(prior + spread * at))) > first_wins:
            high = at
        else:
            low = at
    at = (low + high) / 2
    p = float(_chance(np.array(prior + spread * at)))
    bend = p * (1 - p)
    updated = covariance - bend / (1 + bend * spread) * np.outer(along, along)
    return mean + at * along, (updated + updated.T) / 2


class _Problem:
    """A prepared problem: utilities of every draw, the best set of every draw, the present set."""

    def __init__(self, row: object, k: int, cap: int, seed: int, samples: int) -> None:
        self.ids, self.k, self.cap = np.asarray(row.ids), k, cap
        self.groups = np.unique(np.asarray(row.groups, str), return_inverse=True)[1]
        self.x, self.base = np.stack([np.asarray(v, float) for v in row.features]), np.asarray(row.base, float)
        self.mean = np.asarray(row.mean, float)
        self.covariance = np.asarray(row.covariance, float).reshape(len(self.mean), -1)
        self.normals = standard_normals(seed, row.hash, 0, samples, len(self.mean))
        self.utilities = self.of(self.mean + self.normals @ symmetric_root(self.covariance))
        self.best = best_sets(self.utilities, self.groups, k, cap)
        self.best_values = (_objective(self.utilities) * self.best).sum(axis=1)
        self.present = self.choice(self.of(self.mean[None]))
        self.regret = max(0.0, float((self.best_values - self.values(self.utilities, self.present)).mean()))

    def of(self, theta: np.ndarray) -> np.ndarray:
        return theta @ self.x.T + self.base

    def choice(self, utilities: np.ndarray) -> np.ndarray:
        return np.flatnonzero(best_sets(utilities, self.groups, self.k, self.cap)[0])

    @staticmethod
    def values(utilities: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        return _objective(utilities[:, chosen]).sum(axis=1)

    def promise(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs: the chance of the left item, its entropy, and how much the draws disagree on their membership."""
        p = _chance(self.utilities[:, left] - self.utilities[:, right]).mean(axis=0)
        q = np.clip(p, LEAST_CHANCE, 1 - LEAST_CHANCE)
        best = self.best.astype(float)
        return p, -q * np.log(q) - (1 - q) * np.log(1 - q), (best[:, left] - best[:, right]).var(axis=0)

    def regret_after(self, left: int, right: int, first_wins: bool) -> tuple[float, float, bool]:
        """(expected loss after the answer, effective draws, drawn anew): reweighted draws, or new ones where few would count."""
        chance = _chance(self.utilities[:, left] - self.utilities[:, right])
        weights = chance if first_wins else 1 - chance
        weights = weights / weights.sum()
        effective = float(1 / (weights @ weights))
        if effective >= min(len(weights) * ESS_SHARE, ESS_MOST):
            chosen = self.choice((weights @ self.utilities)[None])
            return max(0.0, float(weights @ (self.best_values - self.values(self.utilities, chosen)))), effective, False
        mean, covariance = after_answer(self.mean, self.covariance, self.x[left] - self.x[right], float(self.base[left] - self.base[right]), first_wins)
        utilities = self.of(mean + self.normals @ symmetric_root(covariance))
        best = (_objective(utilities) * best_sets(utilities, self.groups, self.k, self.cap)).sum(axis=1)
        return max(0.0, float((best - self.values(utilities, self.choice(self.of(mean[None])))).mean())), effective, True


def _over_pairs(pairs: DataFrame, problems: DataFrame, prepare: Callable, work: Callable, schema: str) -> DataFrame:
    """work(problem, left, right, pairs) over the pairs of every (problem, part), some of which share a task."""
    buckets = max(1, -(-pairs.count() // BUCKET_PAIRS))
    bucket = F.pmod(F.xxhash64("problem", "part"), F.lit(buckets)).alias("bucket")

    def run(own: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        found, of = [], {r.problem: r for r in states.itertuples(index=False)}
        for name, rows in own.groupby("problem"):
            problem = prepare(of[name])
            at = {i: n for n, i in enumerate(problem.ids)}
            left, right = (rows[c].map(at).to_numpy(np.int64) for c in ("left_id", "right_id"))
            found.append(work(problem, left, right, rows))
        return pd.concat(found)

    states = problems.join(pairs.select("problem", bucket).distinct(), "problem")
    both = pairs.select("*", bucket).groupBy("bucket").cogroup(states.toDF(*states.columns).groupBy("bucket"))
    return both.applyInPandas(lambda a, b: run(a, b) if len(a) else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}), schema)


def suggest_pairs(
    candidates: DataFrame, models: DataFrame, excluded: DataFrame, k: int, cap: int, samples: int = SAMPLES, seed: int = 0, shortlist: int | None = SHORTLIST, limit: int = MAX_POOL
) -> DataFrame:
    """One row a problem: the pair whose answer is expected to remove most of the loss of the present selection.

    candidates: problem, item_id, grp, base, features; models: problem, mean, covariance (by rows); excluded: problem,
    left_id, right_id. The selection is the k best by base + mean . features with at most cap of a group. Pairs are
    listed by entropy times membership variance; the first `shortlist` of a problem (None: all) are worked out.
    A pair whose value is negative beyond rounding is passed over; a problem with no other is tried again with
    twice the samples. status: suggested, too_large (over `limit` candidates: pairs grow with the square),
    no_model, infeasible, no_pair or numerical_error. Rows with a null are left out, repeated items count once,
    ties go to smaller ids, and neither order nor partitions change a result; no candidates give no rows.
    """
    pair_schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in candidates.select("problem", F.col("item_id").cast("long").alias("left_id"), F.col("item_id").cast("long").alias("right_id")).schema)
    with temporary_tables(candidates.sparkSession) as keep:
        vector = F.col("features").cast("array<double>")
        c = candidates.select("problem", F.col("item_id").cast("long").alias("item_id"), F.col("grp").cast("string").alias("grp"), F.col("base").cast("double").alias("base"), vector.alias("features"))
        c = c.where("problem is not null and item_id is not null and grp is not null and base is not null").where(~F.coalesce(F.exists("features", lambda x: x.isNull()), F.lit(True)))
        c = materialize(c.dropDuplicates(["problem", "item_id"]), "pool")
        sizes = c.groupBy("problem", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("problem").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.lit(cap))).alias("room"))
        usable = posterior_draws(models, "problem", 1).select("problem", F.lit(True).alias("usable"))
        all_problems = candidates.select("problem").where("problem is not null").distinct().join(sizes, "problem", "left").join(usable, "problem", "left")
        early = F.when(F.col("n") > limit, "too_large").when(F.col("usable").isNull(), "no_model").when(F.coalesce(F.col("room"), F.lit(0)) < k, "infeasible").when(F.col("n") < 2, "no_pair")
        told = materialize(all_problems.select("problem", "n", early.alias("early")), "problems")
        live = told.where("early is null").select("problem", "n")
        in_pool = c.join(live, "problem", "left_semi")
        pool = in_pool.groupBy("problem").agg(F.sort_array(F.collect_list(F.struct("item_id", "grp", "base", "features"))).alias("rows"))  # `limit` at most
        fields = {"ids": "item_id", "groups": "grp", "base": "base", "features": "features"}
        problems = pool.join(models.select("problem", F.col("mean").cast("array<double>").alias("mean"), F.col("covariance").cast("array<double>").alias("covariance")).dropDuplicates(["problem"]), "problem")
        problems = materialize(problems.select("problem", F.xxhash64(F.col("problem").cast("string")).alias("hash"), "mean", "covariance", *(F.col(f"rows.{f}").alias(n) for n, f in fields.items())), "problems")
        parts = F.ceil(F.col("n") * (F.col("n") - 1) / 2 / BUCKET_PAIRS)
        pairs = pool_pairs(in_pool, excluded, limit).join(live, "problem").withColumn("part", F.pmod(F.xxhash64("left_id", "right_id"), parts)).drop("n")
        pairs = materialize(pairs, "pairs")

        def tried(todo: DataFrame, draws: int) -> DataFrame:
            prepare = lambda row: _Problem(row, k, cap, seed, draws)

            def list_them(problem: _Problem, left: np.ndarray, right: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
                p, entropy, variance = problem.promise(left, right)
                return rows[["problem", "left_id", "right_id"]].assign(part=rows["part"], probability_left=p, entropy=entropy, member_variance=variance)

            def work_out(problem: _Problem, left: np.ndarray, right: np.ndarray, rows: pd.DataFrame) -> pd.DataFrame:
                found = []
                for a, b, p in zip(left, right, rows["probability_left"], strict=True):
                    (won, ess_won, new_won), (lost, ess_lost, new_lost) = (problem.regret_after(a, b, first) for first in (True, False))
                    raw = problem.regret - (p * won + (1 - p) * lost)
                    found.append((won, lost, ess_won, ess_lost, new_won, new_lost, raw, max(0.0, raw), raw >= -TOLERANCE, problem.regret, problem.ids[problem.present]))
                names = ("regret_left", "regret_right", "ess_left", "ess_right", "redrawn_left", "redrawn_right", "raw_value", "value", "ok", "present_regret", "present")
                return rows.drop(columns=["bucket", "part"]).assign(**dict(zip(names, zip(*found, strict=True), strict=True)))

            promise = "probability_left double, entropy double, member_variance double"
            listed = _over_pairs(todo, problems, prepare, list_them, f"{pair_schema}, part long, {promise}")
            score = F.round(F.col("entropy") * F.col("member_variance"), 15)
            listed = listed.withColumn("_rank", F.row_number().over(Window.partitionBy("problem").orderBy(score.desc(), "left_id", "right_id")))
            chosen = materialize((listed.where(F.col("_rank") <= shortlist) if shortlist else listed).drop("_rank"), "shortlist")
            more = "regret_left double, regret_right double, ess_left double, ess_right double, redrawn_left boolean, redrawn_right boolean, raw_value double, value double, ok boolean, present_regret double, present array<long>"
            scored = _over_pairs(chosen, problems, prepare, work_out, f"{pair_schema}, {promise}, {more}")
            near = [F.round(v, 12) for v in ("value", "raw_value")]
            order = F.struct((~F.col("ok")).alias("a"), (-near[0]).alias("b"), (-near[1]).alias("c"), F.col("left_id"), F.col("right_id"))
            best = scored.groupBy("problem").agg(F.min_by(F.struct(*[x for x in scored.columns if x != "problem"]), order).alias("r"), F.count(F.lit(1)).alias("evaluated"))
            return materialize(best.select("problem", "r.*", "evaluated", F.lit(draws).alias("samples")), "suggestions")

        first = tried(pairs, samples)
        again = min(RETRY_SAMPLES, 2 * samples)
        failed = first.where("not ok").select("problem")
        if again > samples and not failed.isEmpty():
            first = first.where("ok").unionByName(tried(pairs.join(failed, "problem", "left_semi"), again))
        eligible = pairs.groupBy("problem").agg(F.count(F.lit(1)).alias("eligible"))
        status = F.coalesce("early", F.when(F.col("ok"), "suggested").when(F.col("ok").isNull(), "no_pair").otherwise("numerical_error"))
        result = told.join(first, "problem", "left").join(eligible, "problem", "left").withColumn("status", status).drop("early", "n", "ok")
        return keep(materialize(result, "suggestions"))
