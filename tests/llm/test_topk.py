"""Exact search against brute force: ties, repeated rows, odd vectors, an empty table, several blocks."""

import numpy as np

from tessera.llm import topk


def brute(rows, every, k):
    out = {}
    for q, v in sorted((i, v) for i, v in rows if i % every == 0):
        if q not in out:  # the smallest vector of a repeated query
            best = sorted((-int(sum(a * b for a, b in zip(v, x))), i) for i, x in rows if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def check(spark, rows, every=10, k=7, scale=1024.0, **more):
    df = spark.createDataFrame([(i, [float(a) / scale for a in v], "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int")
    assert got(topk.top_k(df, every, k, **more)) == {q: v for q, v in brute(rows, every, k).items() if v}
    return df


def test_equals_brute_force_with_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "FILE_ROWS", 100)
    monkeypatch.setattr(topk, "RUN", 16)
    rng = np.random.default_rng(3)
    centres = rng.integers(-3000, 3000, (6, 5))
    rows = [(i, (centres[i % 6] + rng.integers(-40, 40, 5)).tolist()) for i in range(600)]
    rows += [(i, [7, 7, 7, 7, 7]) for i in range(600, 660)] + rows[:30] + [(20, [1, 2, 3, 4, 5])]
    df = check(spark, rows)
    assert topk.evaluated_share(df, 10, 7) < 0.5  # rows in clusters: most pairs are passed over
    monkeypatch.setattr(topk, "BLOCK", 3)
    check(spark, rows[:200])


def test_few_rows_short_vectors_and_large_numbers(spark):
    check(spark, [(0, [1, 2]), (10, [3]), (11, [])])
    check(spark, [(0, [5])])
    check(spark, [(i, [2**30 - i, -(2**29) + 3 * i]) for i in range(40)])


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0]), (100, [float("inf")])], "vec_id long, embedding array<double>")
    assert topk.top_k(df).count() == 0 and topk.top_k(df.limit(0)).count() == 0
