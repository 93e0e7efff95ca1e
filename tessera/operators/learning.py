"""Features of pairs, models of preference and own models over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalars import binary_entropy, logistic
from tessera.functions.shared import discard, materialize, temporary_tables

_VEC = T.ArrayType(T.DoubleType())
#: Events of a key that are fitted in one task, in parts of about so many if it has more, and hot keys that may be broadcast.
PART_EVENTS, HOT_KEYS = 50_000, 100_000


def projection_matrix(dim: int, rank: int) -> np.ndarray:
    """rank x dim: rows 37 r + 11 of the Hadamard matrix, columns signed by a mixed counter; dim is a power of two."""
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")

    def sign(k: int) -> int:
        # fixed values: the constants of the mix; Python's integers do not wrap at 64 bits, and these must not
        x = k * 0x9E3779B97F4A7C15
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> shift)) * factor
        return 1 - 2 * ((x ^ (x >> 31)) & 1)

    rows, columns = (37 * np.arange(rank) + 11) % dim, np.arange(dim)
    signs = np.array([sign(k + 1) for k in range(dim)], float)
    return (1.0 - 2.0 * (np.bitwise_count(rows[:, None] & columns) & 1)) * signs / rank**0.5


def project(vector: Column, dim: int, rank: int) -> Column:
    """The signed Hadamard projection, a product of matrices an Arrow batch; null for null and other lengths."""
    matrix = projection_matrix(dim, rank).T

    @F.pandas_udf(_VEC)
    def projected(vectors: pd.Series) -> pd.Series:
        fits = vectors.map(lambda v: v is not None and len(v) == dim).to_numpy(bool)
        done = iter(np.stack(vectors[fits].to_numpy()).astype(float) @ matrix if fits.any() else ())
        return pd.Series([next(done) if ok else None for ok in fits], dtype=object)

    return projected(vector)


def contextual_features(item: Column, asked: Column, cosine: Column, flags: list[Column]) -> Column:
    """The projected item, its product with the projected query, their cosine and the flags, as one vector."""
    return F.concat(item, F.zip_with(item, asked, lambda x, y: x * y), F.array(cosine, *(F.coalesce(f.cast("double"), F.lit(0.0)) for f in flags)))


def pair_events(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs (event_id, preferred_no, rejected_no) with features, preferred less rejected, and margin, the gap of cosines.

    items: item_no, features, cosine. Pairs that name an unknown item go.
    """
    side = lambda key: items.select(F.col("item_no").alias(f"{key}_no"), F.col("features").alias(f"_{key}"), F.col("cosine").alias(f"_{key}_cos"))
    both = pairs.join(side("preferred"), "preferred_no").join(side("rejected"), "rejected_no")
    return both.select(*pairs.columns, F.zip_with("_preferred", "_rejected", lambda x, y: x - y).alias("features"), (F.col("_preferred_cos") - F.col("_rejected_cos")).alias("margin"))


def _sums(x: np.ndarray, margin: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of some events at theta, as 1 + d + d * d numbers."""
    m = margin + x @ theta
    p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
    return np.concatenate([[np.logaddexp(0, -m).sum()], x.T @ (p - 1), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


def _pass(events: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian at theta: partial sums of each task, summed by Spark; d * d + d + 1 numbers come back."""
    d = len(theta)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + d + d * d)
        for batch in batches:
            if len(batch):
                total += _sums(np.stack(batch["features"].to_numpy()), batch["margin"].to_numpy(float), theta)
        yield pd.DataFrame({"k": np.arange(len(total)), "v": total})

    sums = events.select("features", "margin").mapInPandas(partial, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + d + d * d)
    for row in sums:
        flat[row["k"]] = row["v"]
    return float(flat[0]), flat[1 : 1 + d], flat[1 + d :].reshape(d, d)


def fit_preference(events: DataFrame, dim: int, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, dict]:
    """(mean, covariance, diagnostics) of a Bayesian logistic model: damped Newton, then Laplace's covariance.

    events: features (array of dim doubles), margin. A round is one pass over events, whatever their number;
    the driver solves dim x dim systems only. Events with a null are left out; without events the prior stays.
    """
    known = events.where("features is not null and margin is not null").where(F.size("features") == dim)
    theta, done, used = np.zeros(dim), False, 0

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, slope, bend = _pass(known, x)
        return loss + ridge / 2 * x @ x, slope + ridge * x, bend + ridge * np.eye(dim)

    first = value, slope, bend = at(theta)
    while used < rounds and not done:
        step = -np.linalg.solve(bend, slope)
        if np.linalg.norm(slope) <= 1e-8 or np.linalg.norm(step) <= 1e-10 * (1 + np.linalg.norm(theta)):
            done = True
            break
        size, moved = 1.0, None
        while size > 1e-12 and moved is None:
            tried = at(theta + size * step)
            moved = tried if tried[0] <= value + 1e-4 * size * slope @ step else None
            size *= 1.0 if moved else 0.5
        if moved is None:
            break
        theta, before, (value, slope, bend) = theta + size * step, value, moved
        used += 1
        done = abs(before - value) <= 1e-12 * (1 + abs(before))
    inverse = np.linalg.inv(bend)
    told = {"initial": first[0], "final": value, "rounds": used, "converged": done, "gradient": float(np.linalg.norm(slope)), "condition": float(np.linalg.cond(bend))}
    return theta, (inverse + inverse.T) / 2, told


def _newton_move(row: dict, sums: np.ndarray, dim: int, ridge: float, rounds: int) -> dict:
    """The state of one key after its sums at the point tried: take the point or halve the step."""
    at = np.asarray(row["trial"], float)
    loss = sums[0] + ridge / 2 * at @ at
    if row["rounds"] >= 0 and loss > row["value"] + 1e-4 * row["size"] * row["gain"]:
        size = row["size"] / 2
        return row | {"size": size, "trial": np.asarray(row["theta"], float) + size * np.asarray(row["step"], float), "done": size <= 1e-12}
    slope, bend = sums[1 : 1 + dim] + ridge * at, sums[1 + dim :].reshape(dim, dim) + ridge * np.eye(dim)
    step, used = -np.linalg.solve(bend, slope), row["rounds"] + 1
    settled = np.linalg.norm(slope) <= 1e-8 or np.linalg.norm(step) <= 1e-10 * (1 + np.linalg.norm(at)) or (used > 0 and abs(row["value"] - loss) <= 1e-12 * (1 + abs(loss)))
    # a last step that promises less than the rounding of the loss is taken untested
    last = not settled and -(slope @ step) <= 1e-13 * (1 + abs(loss))
    settled = settled or last
    moved = {"theta": at + step if last else at, "value": loss, "bend": bend.ravel(), "step": step, "gain": slope @ step, "size": 1.0, "trial": at + step}
    return row | moved | {"rounds": used, "converged": bool(settled), "done": bool(settled) or used >= rounds}


def _small(hot: DataFrame) -> DataFrame:
    """Keys with over PART_EVENTS events each: sent to all tasks if they are as few as they should be."""
    return F.broadcast(hot) if hot.count() <= HOT_KEYS else hot


def fit_by_key(events: DataFrame, key: str, dim: int, ridge: float = 1.0, rounds: int = 50) -> DataFrame:
    """key, mean, covariance (dim * dim values by rows), value, rounds, converged: fit_preference() for every key at once.

    events: key, features (array of dim doubles), margin. A key with up to PART_EVENTS events is fitted in one grouped task,
    which makes all its rounds over the rows it holds; events meet in one shuffle and nothing is written between rounds.
    A hot key is never one group: its events are dealt into parts, its point is sent to each, and a round over the tables adds
    up their partial sums; only hot keys are rows of the state table, of which the last one is kept. Rows with a null, or features of another
    length, are left out, and so are keys that have no others; repeated rows count as often as they occur; an empty
    table gives no rows.
    """
    vectors, spark = "array<double>", events.sparkSession
    kind = events.schema[key].dataType.simpleString()
    state_schema = f"_key {kind}, theta {vectors}, value double, bend {vectors}, step {vectors}, gain double, size double, trial {vectors}, rounds int, converged boolean, done boolean"
    names = [part.split()[0] for part in state_schema.split(", ")]
    schema = f"_key {kind}, theta {vectors}, covariance {vectors}, value double, rounds int, converged boolean"

    def model(row: dict) -> list:
        inverse = np.linalg.inv(np.asarray(row["bend"], float).reshape(dim, dim))
        return [row["_key"], row["theta"], ((inverse + inverse.T) / 2).ravel(), row["value"], row["rounds"], row["converged"]]

    def fit(who: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, margin = np.stack(own["features"].to_numpy()).astype(float), own["margin"].to_numpy(float)
        row = {"_key": who[0], "trial": np.zeros(dim), "theta": np.zeros(dim), "value": 0.0, "rounds": -1, "converged": False, "done": False}
        while not row["done"]:
            row = _newton_move(row, _sums(x, margin, np.asarray(row["trial"], float)), dim, ridge, rounds)
        return pd.DataFrame([model(row)], columns=["_key", "theta", "covariance", "value", "rounds", "converged"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (who, _sums(np.stack(own["features"].to_numpy()).astype(float), own["margin"].to_numpy(float), np.asarray(own["trial"].iloc[0], float)))
                for who, own in batch.groupby("_key", sort=False)
            ]
            yield pd.DataFrame(out, columns=["_key", "sums"])

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_newton_move(r, np.asarray(r["sums"], float), dim, ridge, rounds) if r["sums"] is not None else r for r in batch.to_dict("records")]
            yield pd.DataFrame([[r[n] for n in names] for r in rows], columns=names)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model(r) for r in batch.to_dict("records")], columns=["_key", "theta", "covariance", "value", "rounds", "converged"])

    with temporary_tables(spark) as keep:
        known = events.select(F.col(key).alias("_key"), "features", F.col("margin").cast("double").alias("margin"))
        known = known.where(F.col("_key").isNotNull() & F.col("margin").isNotNull() & (F.size("features") == dim) & ~F.exists("features", lambda x: x.isNull()))
        parts = known.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / PART_EVENTS).cast("int").alias("_parts"))
        hot = materialize(parts.where("_parts > 1"), "hot-keys")
        if hot.isEmpty():
            return keep(materialize(known.groupBy("_key").applyInPandas(fit, schema).withColumnsRenamed({"_key": key, "theta": "mean"}), "models"))
        dealt = known.join(_small(hot), "_key").withColumn("_part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "_parts").cast("int"))
        dealt = materialize(dealt.drop("_parts"), "events")
        zeros = F.array_repeat(F.lit(0.0), dim)
        first = {"theta": zeros, "value": F.lit(0.0), "bend": zeros, "step": zeros, "gain": F.lit(0.0), "size": F.lit(1.0), "trial": zeros, "rounds": F.lit(-1), "converged": F.lit(False), "done": F.lit(False)}
        state = materialize(hot.select("_key").withColumns(first), "state")
        while not state.where("not done").isEmpty():
            points = state.where("not done").select("_key", "trial").join(_small(hot), "_key")
            points = points.select("_key", "trial", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
            tried = dealt.join(points, ["_key", "_part"]).mapInPandas(partial, f"_key {kind}, sums {vectors}")
            summed = tried.select("_key", F.posexplode("sums")).groupBy("_key", "pos").agg(F.sum("col").alias("col"))
            whole = summed.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "col"))), lambda e: e["col"]).alias("sums"))  # 1 + dim + dim * dim values
            before, state = state, materialize(state.join(whole, "_key", "left").mapInPandas(move, state_schema), "state")
            discard(before)
        fitted = known.join(_small(hot), "_key", "left_anti").groupBy("_key").applyInPandas(fit, schema).unionByName(state.mapInPandas(finish, schema))
        return keep(materialize(fitted.withColumnsRenamed({"_key": key, "theta": "mean"}), "models"))


def next_weights(weights: np.ndarray, n: int, x: np.ndarray) -> np.ndarray:
    """The weights after event number n (from 0). Rate, decay, bounds and digits."""
    gain = 1 - 1 / (1 + np.exp(-np.clip(weights @ x, -20, 20)))
    return np.round(np.clip(weights + 0.35 / np.sqrt(n + 1) * gain * x - 0.002 * weights, -2, 2), 8)


def online_weights(events: DataFrame, dim: int = 7) -> DataFrame:
    """user_id, n, weights after each user's events (user_id, ts, event_id, features) in order of (ts, event_id).

    The update depends on the order, so a user's events are one sequence: they arrive sorted in one task, which holds
    one batch and one vector, whatever the number of events. Null features are left out.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, n, w, seen = None, 0, np.zeros(dim), False
        row = lambda: pd.DataFrame({"user_id": [user], "n": [n], "weights": [w.tolist()]})
        for batch in batches:
            for who, x in zip(batch["user_id"], batch["features"], strict=True):
                if seen and who != user:
                    yield row()
                if not seen or who != user:
                    user, n, w, seen = who, 0, np.zeros(dim), True
                w = next_weights(w, n, np.asarray(x, float))
                n += 1
        if seen:
            yield row()

    kind = events.schema["user_id"].dataType.simpleString()
    known = events.where("features is not null and user_id is not null").select("user_id", "ts", "event_id", "features")
    return known.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(fold, f"user_id {kind}, n long, weights array<double>")


def most_uncertain(pairs: DataFrame, by: str, margin: Column, variance: Column) -> DataFrame:
    """The pair of each problem with the largest entropy of logistic(margin / sqrt(1 + pi variance / 8)), ties to smaller ids."""
    spread = pairs.withColumn("entropy", binary_entropy(logistic(margin / F.sqrt(1 + F.lit(np.pi) * variance / 8))))
    order = Window.partitionBy(by).orderBy(F.desc("entropy"), "left_no", "right_no")
    return spread.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def shortlist(pairs: DataFrame, by: str, n: int = 16) -> DataFrame:
    """The n pairs of each problem with the largest entropy times membership variance, with their rank; ties to smaller ids."""
    order = Window.partitionBy(by).orderBy(F.desc(F.col("entropy") * F.col("member_variance")), "left_no", "right_no")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hash_shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in an order that only seed and key decide, a range sort by shuffle_key."""
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return rows.withColumn("shuffle_key", mixed).orderBy("shuffle_key", key)


def gram(rows: DataFrame, vec: str, dim: int) -> DataFrame:
    """i, j, value: sums of products of components, partial in each task; dim * dim rows, null vectors left out."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vec].to_numpy()).astype(float)
                total += x.T @ x
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "value": total.ravel()})

    known = rows.select(vec).where(F.size(vec) == dim)
    return known.mapInPandas(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def apply_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, name: str, batch: int = 64) -> DataFrame:
    """A model over batches of at most `batch` rows, loaded once a task; it may return any number of rows for one.

    load() gives a function from a frame of rows to a frame with the columns of schema; model holds its name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            for at in range(0, len(frame), batch):
                yield model(frame.iloc[at : at + batch])

    return rows.mapInPandas(run, schema).withColumn("model", F.lit(name))
