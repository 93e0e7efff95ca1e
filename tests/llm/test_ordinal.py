"""Cumulative-link regression: gradient, ordered tails, held-out ranking, odd rows."""

import numpy as np

from tessera.llm import ordinal

TEXTS = [b"", b"one", b"Two words here", "é 12 !!".encode(), b"two two words " * 50]


def test_gradient_equals_finite_differences():
    rows, dims, values = ordinal.vectors(TEXTS)
    grades, rng = np.array([0, 1, 2, 0, 2]), np.random.default_rng(1)
    w, t = rng.normal(0, 0.5, ordinal.DIMENSIONS), np.array([-0.4, 0.7])
    loss = lambda w, t: ordinal.gradient(rows, dims, values, grades, w, t)[0]
    _, by_w, by_t = ordinal.gradient(rows, dims, values, grades, w, t)
    for d in np.unique(dims)[:12]:
        step = np.zeros_like(w)
        step[d] = 1e-5
        assert np.isclose((loss(w + step, t) - loss(w - step, t)) / 2e-5, by_w[d], atol=1e-5)
    for k in (0, 1):
        step = np.eye(2)[k] * 1e-5
        assert np.isclose((loss(w, t + step) - loss(w, t - step)) / 2e-5, by_t[k], atol=1e-5)


def test_grades_of_held_out_rows(spark):
    rows = [(i, " ".join([("bad", "fair", "good")[i % 3]] * 2 + [f"w{(i * 7) % 31}", f"v{i % 17}"])) for i in range(600)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, tail_1 int")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(400)] + [(None, 1), (5, None), (7, 9)], "doc_id long, grade int")
    got = ordinal.grade(docs, ratings).toPandas().set_index("doc_id")
    held = got.loc[400:]
    assert (got.tail_1 >= got.tail_2).all() and np.allclose(got.expected_grade, got.tail_1 + got.tail_2)
    means = [held.expected_grade[[i % 3 == g for i in held.index]].mean() for g in range(3)]
    assert means[0] + 0.3 < means[1] < means[2] - 0.3
    assert (got.selected == (got.tail_1 >= 0.5)).all()


def test_odd_rows_and_no_ratings(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "x"), (2, "long " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, grade int")
    got = ordinal.grade(docs, none).toPandas()
    assert len(got) == 4 and np.allclose(got.tail_1, 2 / 3) and np.allclose(got.tail_2, 1 / 3)
    assert ordinal.grade(docs.limit(0), none).count() == 0
