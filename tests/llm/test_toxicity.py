"""Features, calibration and long texts of the toxicity operator."""

import math
import time

from tessera.llm import toxicity


def named(text, words=None, stems=None):
    return dict(zip(toxicity.FEATURES, toxicity.features(text, words or {}, stems or {}), strict=True))


def test_features_by_hand():
    f = named("You are a STUPID st0pid s.t.u.p.i.d moron!", {"stupid": 2.0, "moron": 1.0}, {"stup": 0.5})
    assert f["word_hits"] == 2 and f["stem_hits"] == 1
    assert f["weight"] == 3.0 and f["near_second"] >= 1 and f["shouts"] > 0
    assert math.isclose(f["log_words"], math.log1p(len(toxicity.WORD.findall("You are a STUPID st0pid s.t.u.p.i.d moron!"))))
    assert f["mixed"] > 0 and f["hidden"] >= 1
    assert f["capitals"] == 7 / len("You are a STUPID st0pid s.t.u.p.i.d moron!")
    assert not any(toxicity.features("", {}, {}))


def test_long_words_take_time_in_proportion():
    began = time.time()
    for text in ("a" * 1_000_000, "a-" * 500_000, "a" + "-" * 1_000_000, "a b " * 250_000, "x." * 500_000 + "yy"):
        toxicity.features(text, {"stupid": 1.0}, {})
    assert time.time() - began < 20


def test_calibration_is_out_of_fold(spark):
    # labels by a coin: an in-sample calibration would call many of them toxic
    rows = [(i, f"text number {i} with word{i % 97} and word{i % 89} and stupid{i % 7}", i % 13 % 2) for i in range(3_000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i * 2654435761 >> 7) % 5 == 0) for i, _, _ in rows], "doc_id long, toxic boolean").selectExpr("doc_id", "1 AS quality", "CAST(toxic AS int) AS toxic")
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == 3_000 and got.score.between(0, 1).all()
    assert got.predicted.mean() < 0.01 and abs(got.score.mean() - 0.2) < 0.05
