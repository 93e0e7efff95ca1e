"""Selections under constraints, and the pairs of small pools."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a problem, after pruning, and search steps beyond which its status is too_large or step_limit.
MAX_CANDIDATES, MAX_STEPS = 2_000, 50_000
#: Subgradient steps for the prices of the bound.
PRICE_STEPS = 80
#: Candidates up to which a problem is searched without prices.
SMALL = 24
#: Members of a pool beyond which pool_pairs() refuses it: pairs grow with the square.
MAX_POOL = 500
SCALE = 1_000_000


@dataclass(frozen=True)
class _State:
    """Chosen candidates, their value, those that may still join by falling worth, and what is left of every limit."""

    chosen: tuple[int, ...]
    value: int
    free: list[int]
    due: dict[int, int]
    room: list[int]
    slots: list[int]
    short: list[int]


class _Search:
    """Branch and bound for the best k candidates.

    The bound drops the pairs and gives every wanted category, and all others together, the best candidates for its
    own slots, at most the room of a group in each. Caps of groups over several categories and the minimums of labels
    have prices (Lagrange multipliers, found once by subgradient steps), so a quota on a low-scored category or a rare
    label does not loosen it. Penalties and conflicts with chosen candidates count in full. A branch goes only if its
    bound is below the best value, so of equal selections the one with the smaller ids is found.
    """

    def __init__(self, rows: list[dict], edges: list[dict], k: int, cap: int, quotas: dict, minimums: dict) -> None:
        rows = sorted(rows, key=lambda r: r["item_id"])
        self.ids, self.weight = [r["item_id"] for r in rows], [int(r["weight"]) for r in rows]
        self.pins = [i for i, r in enumerate(rows) if r["pinned"]]
        self.k, self.cap = k, cap
        groups = {g: n for n, g in enumerate(dict.fromkeys(r["grp"] for r in rows))}
        self.group, self.groups = [groups[r["grp"]] for r in rows], len(groups)
        wanted = {c: n for n, c in enumerate(quotas)}
        self.kind = [wanted.get(r["category"], len(wanted)) for r in rows]
        self.slots, self.least = [*quotas.values(), k - sum(quotas.values())], list(minimums.values())
        self.labels = [[n for n, x in enumerate(minimums) if r["labels"] is not None and x in r["labels"]] for r in rows]
        at = {i: p for p, i in enumerate(self.ids)}
        self.cost: dict[int, dict[int, int | None]] = {}
        for e in edges:
            if e["left_id"] in at and e["right_id"] in at:
                x, y = at[e["left_id"]], at[e["right_id"]]
                self.cost.setdefault(x, {})[y] = self.cost.setdefault(y, {})[x] = None if e["conflict"] else int(e["penalty"])
        self.best: tuple[int, tuple[int, ...]] | None = None
        self.steps = 0

    def _fill(self, order: list[int], room: list[int], slots: list[int]) -> list[int] | None:
        """The first of these for the slots of each kind, at most `room` of a group in each kind; None if some stay empty."""
        found, taken, left, open_ = [], {}, list(slots), sum(slots)
        for i in order:
            if not open_:
                break
            kind, g = self.kind[i], self.group[i]
            if left[kind] and taken.get((kind, g), 0) < room[g]:
                taken[kind, g] = taken.get((kind, g), 0) + 1
                left[kind] -= 1
                open_ -= 1
                found.append(i)
        return None if open_ else found

    def _worth(self, price: list[float], pay: list[float]) -> list[float]:
        return [w - price[g] + sum(pay[x] for x in own) for w, g, own in zip(self.weight, self.group, self.labels, strict=True)]

    def _prices(self) -> tuple[list[float], list[float]]:
        """Prices of groups and labels that make the bound of the whole problem small; none where nothing is short."""
        price, pay = [0.0] * self.groups, [0.0] * len(self.least)
        best, kept = math.inf, (price, pay)
        scale = (max(self.weight, default=0) - min(self.weight, default=0)) / 4
        for step in range(PRICE_STEPS if len(self.ids) > SMALL else 0):
            worth = self._worth(price, pay)
            found = self._fill(sorted(range(len(worth)), key=lambda i: -worth[i]), [self.cap] * self.groups, self.slots)
            if found is None:
                break
            over, short = [-self.cap] * self.groups, list(self.least)
            for i in found:
                over[self.group[i]] += 1
                for x in self.labels[i]:
                    short[x] -= 1
            bound = sum(worth[i] for i in found) + self.cap * sum(price) - sum(p * n for p, n in zip(pay, self.least, strict=True))
            if bound < best:
                best, kept = bound, (price, pay)
            if not step and max(over) <= 0 and max(short, default=0) <= 0:
                break
            rate = scale / (1 + step / 4)
            price, pay = [max(0.0, p + rate * n) for p, n in zip(price, over, strict=True)], [max(0.0, p + rate * n) for p, n in zip(pay, short, strict=True)]
        return kept

    def run(self) -> None:
        price, pay = self._prices()
        worth = self._worth(price, pay)
        order = sorted(range(len(worth)), key=lambda i: -worth[i])
        stack = [self._with(_State((), 0, order, {}, [self.cap] * self.groups, self.slots, self.least), self.pins)]
        while stack:
            state = stack.pop()
            if state is None:
                continue
            self.steps += 1
            if self.steps > MAX_STEPS:
                return
            left = self.k - len(state.chosen)
            if not left:
                self._settle(state)
                continue
            if max(state.short, default=0) > left:
                continue
            due = state.due
            free = sorted(state.free, key=lambda i: due.get(i, 0) - worth[i]) if due else state.free
            found = self._fill(free, state.room, state.slots)
            if found is None:
                continue
            bound = state.value + sum(worth[i] - due.get(i, 0) for i in found) + sum(p * n for p, n in zip(price, state.room, strict=True)) - sum(p * n for p, n in zip(pay, state.short, strict=True))
            if self.best and math.floor(bound + 0.01) < self.best[0]:
                continue
            whole = self._with(state, found)
            if whole is not None:
                self._settle(whole)
            pick = max(found, key=lambda i: (worth[i] - due.get(i, 0), -i))
            stack.append(replace(state, free=[i for i in state.free if i != pick]))
            stack.append(self._with(state, [pick]))

    def _with(self, state: _State, more: list[int]) -> _State | None:
        """The state after more candidates join; None if they may not."""
        value, due, room, slots, short = state.value, dict(state.due), list(state.room), list(state.slots), list(state.short)
        gone: set[int] = set()
        for i in more:
            g, kind = self.group[i], self.kind[i]
            if i in gone or not room[g] or not slots[kind]:
                return None
            room[g] -= 1
            slots[kind] -= 1
            value += self.weight[i] - due.get(i, 0)
            gone.add(i)
            for x in self.labels[i]:
                short[x] -= 1
            for j, cost in self.cost.get(i, {}).items():
                if cost is None:
                    gone.add(j)
                elif cost:
                    due[j] = due.get(j, 0) + cost
        return _State((*state.chosen, *more), value, [i for i in state.free if i not in gone and room[self.group[i]]], due, room, slots, short)

    def _settle(self, state: _State) -> None:
        if len(state.chosen) < self.k or max(state.short, default=0) > 0:
            return
        ids = tuple(sorted(self.ids[c] for c in state.chosen))
        if self.best is None or (-state.value, ids) < (-self.best[0], self.best[1]):
            self.best = state.value, ids


def select_constrained(
    candidates: DataFrame, edges: DataFrame, k: int, cap: int, quotas: dict[str, int] | None = None, minimums: dict[str, int] | None = None
) -> DataFrame:
    """problem, status, selected (sorted item_ids), objective: the best k candidates of every problem.

    candidates: problem, item_id, grp, category, score, labels (array), pinned; edges: problem, left_id, right_id,
    conflict, penalty. At most cap of a group, exactly quotas of a category, minimums of a label at least, all
    pinned ones, no conflicting pair. The objective is the sum of round(score * 10^6) * (n + 1) + n - place less
    round(penalty * 10^6) * (n + 1) for each pair, n being the problem's candidates and place their order by
    item_id; equal ones go to the smaller ids. Of rows that repeat an item the one with the largest score counts, of
    repeated edges the largest penalty. Nulls: an unknown score counts as 0, unknown labels as none.

    What cannot be met by counts is told beforehand (required_photos_infeasible, category_quota_infeasible,
    infeasible). Of candidates without pin and edge that have group, category and labels in common only the best
    min(k, cap) can be chosen, so the others go before the search. Problems that are still too large are not
    searched to the end: their status is too_large or step_limit, with the best selection found, if any.
    """
    quotas, minimums = quotas or {}, minimums or {}
    whole = Window.partitionBy("problem")
    c = candidates.select(
        "problem", F.col("item_id").cast("long").alias("item_id"), "grp", "category", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.array_sort(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"), F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )
    best = F.max_by(F.struct("grp", "category", "score", "labels", "pinned"), F.struct("score", "pinned", "grp", "category"))
    c = c.groupBy("problem", "item_id").agg(best.alias("r")).select("problem", "item_id", "r.*")
    c = c.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("place", F.row_number().over(whole.orderBy("item_id")) - 1)
    c = c.withColumn("weight", F.round(F.col("score") * SCALE).cast("long") * (F.col("n") + 1) + F.col("n") - F.col("place"))
    room = c.groupBy("problem", "grp").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("room")).groupBy("problem").agg(F.sum("room").alias("room"))
    counts = [F.count_if(F.col("category") == q).alias(f"_q{j}") for j, q in enumerate(quotas)] + [F.count_if(F.array_contains("labels", m)).alias(f"_m{j}") for j, m in enumerate(minimums)]
    told = c.groupBy("problem").agg(F.count_if("pinned").alias("_pins"), *counts).join(room, "problem")
    short = F.lit(sum(quotas.values()) > k)
    for j, least in enumerate(quotas.values()):
        short = short | (F.col(f"_q{j}") < least)
    few = F.col("room") < k
    for j, least in enumerate(minimums.values()):
        few = few | F.lit(least > k) | (F.col(f"_m{j}") < least)
    early = F.when(F.col("_pins") > k, "required_photos_infeasible").when(short, "category_quota_infeasible").when(few, "infeasible")
    told = told.select("problem", early.alias("early"))
    e = edges.select("problem", F.col("left_id").cast("long").alias("left_id"), F.col("right_id").cast("long").alias("right_id"), F.coalesce("conflict", F.lit(False)).alias("conflict"), F.coalesce("penalty", F.lit(0.0)).alias("penalty"))
    tied = e.select("problem", F.explode(F.array("left_id", "right_id")).alias("item_id")).distinct().withColumn("tied", F.lit(True))
    same = Window.partitionBy("problem", "grp", "category", "labels", "free").orderBy(F.col("weight").desc())
    free = ~F.col("pinned") & F.col("tied").isNull()
    kept = c.join(tied, ["problem", "item_id"], "left").withColumn("free", free).withColumn("rank", F.row_number().over(same)).where(~F.col("free") | (F.col("rank") <= min(k, cap)))
    kept = kept.join(told, "problem").withColumn("left", F.count(F.lit(1)).over(whole))
    kept = kept.withColumn("early", F.coalesce("early", F.when(F.col("left") > MAX_CANDIDATES, "too_large")))
    rows = kept.where("early is null").groupBy("problem").agg(F.collect_list(F.struct("item_id", "grp", "category", "labels", "pinned", "weight")).alias("rows"))  # MAX_CANDIDATES at most
    ends = [c.select("problem", F.col("item_id").alias(x), *more) for x, more in (("left_id", ["n"]), ("right_id", []))]
    scaled = e.join(ends[0], ["problem", "left_id"]).join(ends[1], ["problem", "right_id"]).withColumn("penalty", F.round(F.col("penalty") * SCALE).cast("long") * (F.col("n") + 1))
    scaled = scaled.groupBy("problem", "left_id", "right_id").agg(F.bool_or("conflict").alias("conflict"), F.max("penalty").alias("penalty"))
    pairs = scaled.join(rows.select("problem"), "problem", "left_semi").groupBy("problem").agg(F.collect_list(F.struct("left_id", "right_id", "conflict", "penalty")).alias("pairs"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, near in zip(batch["rows"], batch["pairs"], strict=True):
                search = _Search(list(own), [] if near is None else list(near), k, cap, quotas, minimums)
                search.run()
                best = search.best
                out.append(("step_limit" if search.steps > MAX_STEPS else "optimal" if best else "infeasible", list(best[1]) if best else [], best[0] if best else None))
            found = pd.DataFrame(out, columns=["status", "selected", "objective"], index=batch.index)
            yield pd.concat([batch[["problem"]], found], axis=1).astype({"objective": "Int64"})

    kind = candidates.schema["problem"].dataType.simpleString()
    solved = rows.join(pairs, "problem", "left").select("problem", "rows", "pairs").mapInPandas(solve, f"problem {kind}, status string, selected array<long>, objective long")
    rest = kept.where("early is not null").select("problem", F.col("early").alias("status"), F.array().cast("array<long>").alias("selected"), F.lit(None).cast("long").alias("objective")).distinct()
    return solved.unionByName(rest)


def pool_pairs(members: DataFrame, excluded: DataFrame, limit: int = MAX_POOL) -> DataFrame:
    """problem, left_id, right_id: all pairs of each small pool but the excluded ones, whichever way round.

    members: problem, item_id; repeated members count once and nulls have no pairs. A pool with more than
    `limit` members makes the job fail, so the number of pairs is bounded by the number of members.
    """
    own = members.select("problem", "item_id").where("problem is not null and item_id is not null").distinct()
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("problem")))
    own = own.where(F.when(F.col("_n") > limit, F.raise_error(F.lit(f"a pool has over {limit} members")).cast("boolean")).otherwise(True)).drop("_n")
    left, right = (own.withColumnRenamed("item_id", n) for n in ("left_id", "right_id"))
    known = excluded.select("problem", F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    return left.join(right, "problem").where("left_id < right_id").join(known, ["problem", "left_id", "right_id"], "left_anti")
