import json
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import images, sqlfunctions, text
from tessera.operators import entities, evidence, learning
from tessera.sources import files
from tessera.streaming import streams


def test_cluster_ids_do_not_depend_on_order(spark):
    rows = [("a", 1), ("a", 2), ("b", 2), ("b", 1), ("c", 1), ("d", 1), ("d", 1), ("e", None)]
    got = {r["k"]: r["cluster_id"] for r in entities.with_cluster_id(spark.createDataFrame(rows, "k string, m long"), "k", "m").collect()}
    assert set(got) == set("abcd") and got["a"] == got["b"] and len(set(got.values())) == 3


def test_label_life(spark):
    label = "cluster_id string, label string, status string, revision int"
    member = "cluster_id string, member long"
    old = spark.createDataFrame([("a", "Ann", "confirmed", 2), ("b", "Bo", "confirmed", 1), ("c", "Unknown", "unlabeled", 0)], label)
    before = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], member)
    now = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3), ("c", 4), ("y", 9)], member)
    changed = spark.createDataFrame([(4,)], "member long")
    labels, events = entities.reconcile_labels(old, before, now, changed, spark.createDataFrame([("y", 7)], "cluster_id string, revision int"))
    assert {r["cluster_id"]: (r["label"], r["status"], r["revision"], r["kept"]) for r in labels.collect()} == {
        "a": ("Ann", "confirmed", 2, True), "b": ("Unknown", "needs_review", 2, False), "x": ("Unknown", "needs_review", 1, False),
        "c": ("Unknown", "unlabeled", 1, False), "y": ("Unknown", "needs_review", 8, False),
    }
    assert {(r["cluster_id"], r["reason"]) for r in events.collect()} == {("b", "evidence_changed"), ("x", "evidence_changed"), ("c", "evidence_changed"), ("y", "evidence_changed"), ("b", "invalidated"), ("c", "invalidated")}
    reset = {r["cluster_id"]: r["revision"] for r in entities.invalidate_labels(old, before, changed).collect()}
    assert reset == {"a": 2, "b": 1, "c": 1}
    assert {tuple(r) for r in entities.evidence_mismatch(before, now).collect()} == {("b", 0, 1), ("x", 1, 0), ("y", 1, 0)}
    assert entities.reconcile_labels(old.where("false"), before.where("false"), now.where("false"), changed, labels.select("cluster_id", "revision").where("false"))[0].count() == 0


def test_redaction(spark):
    rows = [
        ("see C:\\Users\\me\\a.txt", 1), ("at /home/me/x y/z.jpg now", 1), ("on 12/31/2024 or 1/2", 0), ("https://a.example/home/me/x", 0), ("owner/repository", 0), ("", 0), (None, 0),
        ("plain", 0), ("~/notes \"and\" ../up/one", 2), ("x" * 20000, 0),
    ]
    got = spark.createDataFrame(rows, "t string, n int").select("t", "n", text.redact_paths(F.col("t")).alias("r")).collect()
    for r in got:
        assert r["r"]["n"] == r["n"], r["t"]
        assert (r["r"]["text"] == r["t"]) == (r["n"] == 0)
    assert [r["r"]["text"] for r in got][:2] == ["see [path]", "at [path]"]


def test_concepts_and_escapes(spark):
    rows = spark.createDataFrame([("A Night, dark   sky",), ("nightly",), ("夜景",), ("",), (None,), ("<a>&",)], "t string")
    got = [r["c"] for r in rows.select(text.concept_counts(F.col("t")).alias("c")).collect()]
    names = list(text.CONCEPTS)
    assert [sum(c) for c in got] == [3, 0, 1, 0, 0, 0] and got[0][names.index("night")] == 2 and got[0][names.index("sky")] == 1
    vectors = [r["v"] for r in rows.select(text.concept_vector(F.col("t")).alias("v")).collect()]
    assert vectors[1] is None and abs(sum(x * x for x in vectors[0]) - 1) < 1e-12
    assert rows.select(text.escaped(F.col("t"))).collect()[5][0] == "\\u003ca\\u003e\\u0026"


def test_image_functions_with_odd_input(spark):
    flat, noisy = [7] * 64, [(i * 37) % 256 for i in range(64)]
    rows = spark.createDataFrame([(flat,), (noisy,), ([1, 2, 3],), ([],), (None,)], "l array<int>")
    hashes = rows.select(images.perceptual_hash("l").alias("p"), images.wavelet_hash(F.col("l"), 4).alias("w"), images.pixel_signals(F.col("l"), 8).alias("s")).collect()
    assert [h["p"] is None for h in hashes] == [False, False, True, True, True] == [h["w"] is None for h in hashes]
    assert hashes[0]["s"]["entropy"] == 0 and hashes[0]["s"]["blur"] == 0 and hashes[2]["s"]["blur"] is None
    assert sum(hashes[0]["w"]) == 0 and 0 < sum(hashes[1]["w"]) < 16


def test_projection_follows_unbounded_integers(spark):
    def sign(k):
        x = (k + 1) * 0x9E3779B97F4A7C15
        x ^= x >> 30
        x *= 0xBF58476D1CE4E5B9
        x ^= x >> 27
        x *= 0x94D049BB133111EB
        return -1 if (x ^ (x >> 31)) & 1 else 1

    want = np.array([[sign(c) * (-1) ** bin((37 * r + 11) % 64 & c).count("1") for c in range(64)] for r in range(8)]) / 8**0.5
    assert np.allclose(learning.projection_matrix(64, 8), want)
    vec = [float(i % 5) for i in range(64)]
    rows = spark.createDataFrame([(vec,), (None,), ([1.0],)], "v array<double>")
    got = [r[0] for r in rows.select(learning.project(F.col("v"), 64, 8)).collect()]
    assert np.allclose(got[0], want @ vec) and got[1] is None and got[2] is None


def test_fit_equals_gradient_descent(spark):
    rng = np.random.default_rng(3)
    x, m = rng.normal(size=(80, 3)), rng.normal(size=80) * 0.2
    rows = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, m, strict=True)] + [(None, 1.0), ([1.0], 0.0)], "features array<double>, margin double")
    mean, covariance, told = learning.fit_preference(rows, 3)
    w = np.zeros(3)
    for _ in range(4000):
        w -= 0.02 * (x.T @ (1 / (1 + np.exp(-(m + x @ w))) - 1) + w)
    p = 1 / (1 + np.exp(-(m + x @ mean)))
    assert np.allclose(mean, w, atol=1e-6) and told["converged"] and np.allclose(np.linalg.inv(covariance), (x * (p * (1 - p))[:, None]).T @ x + np.eye(3), atol=1e-8)
    assert np.allclose(learning.fit_preference(rows.where("false"), 3)[1], np.eye(3))


def test_online_weights_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(9), i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(90)]
    want = {}
    for user, _, _, x in sorted(rows, key=lambda r: r[:3]):
        n, w = want.get(user, (0, [0.0] * 3))
        gain = 1 - 1 / (1 + np.exp(-np.dot(w, x)))
        want[user] = n + 1, [round(max(-2, min(2, a + 0.35 / (n + 1) ** 0.5 * gain * b - 0.002 * a)), 8) for a, b in zip(w, x, strict=True)]
    schema = "user_id string, ts long, event_id long, features array<double>"
    got = learning.online_weights(spark.createDataFrame([*rows, ("u9", 1, 1, None)], schema), 3)
    assert {r["user_id"]: r["n"] for r in got.collect()} == {u: n for u, (n, _) in want.items()}
    assert all(np.allclose(r["weights"], want[r["user_id"]][1], atol=1e-7) for r in got.collect())
    assert learning.online_weights(spark.createDataFrame([], schema), 3).count() == 0


def test_pairs_and_bundles(spark):
    pairs = spark.createDataFrame([("c", 1, 2), ("c", 3, 4), ("d", 2, 1)], "context string, left_no long, right_no long")
    left = evidence.unseen_pairs(pairs, spark.createDataFrame([("c", 2, 1)], pairs.schema))
    assert {tuple(r) for r in left.select("context", "left_no", "right_no").collect()} == {("c", 3, 4), ("d", 2, 1)}
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("r", 1, "b"), ("r", 1, "c"), ("s", 1, "d")], "query_id string, rank int, item_id string")
    assert {r["query_id"]: r["valid"] for r in evidence.evidence_bundles(ranked).collect()} == {"q": False, "r": False, "s": True}


def test_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, body in (("a.JPG", b"1"), ("sub/b.jpg", b"22"), ("c.txt", b"333")):
        (tmp_path / "in" / name).write_bytes(body)
    root = str(tmp_path / "in")
    assert {(r["path"].rsplit("/", 1)[1], r["length"]) for r in files.scan_files(spark, root, ["jpg"]).collect()} == {("a.JPG", 1), ("b.jpg", 2)}
    assert files.content_digests(spark, root, ["jpg", "txt"]).select("sha256").distinct().count() == 3
    assert files.scan_images(spark, root).count() == 0
    manifest = {"assets": [{"id": "x", "path": "/x"}, {"id": "y", "path": "/y"}], "pairs": [
        {"id": "1", "preferred": "x", "rejected": "y", "query": "q"}, {"id": "2", "preferred": "x", "rejected": "x"}, {"id": "3", "preferred": "x", "rejected": "z"},
        {"id": "4", "preferred": "x", "rejected": "y"}, {"id": "4", "preferred": "y", "rejected": "x"}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    good, bad = files.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r["pair_id"] for r in good.collect()] == ["1"]
    assert sorted(map(tuple, bad.collect())) == [("2", "same_item"), ("3", "missing_asset"), ("4", "duplicate_pair"), ("4", "duplicate_pair")]
    files.write_results(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert streams.run_available(files.stream_files(spark, root, ["jpg"]), "inventory", "append").count() == 2


def test_models_and_sql_functions(spark):
    def load():
        return lambda frame: frame.assign(v=[zlib.crc32(t.encode()) % 7 for t in frame["t"]])[["t", "v"]]

    rows = spark.createDataFrame([(f"t{i}",) for i in range(150)], "t string")
    got = learning.apply_model(rows, load, "t string, v long", "crc-1").collect()
    assert {r["t"]: r["v"] for r in got} == {f"t{i}": zlib.crc32(f"t{i}".encode()) % 7 for i in range(150)} and {r["model"] for r in got} == {"crc-1"}
    sqlfunctions.register(spark)
    assert tuple(spark.sql("SELECT hamming64(5L, 6L), cosine(array(1D, 0D), array(1D, 0D)), cosine(array(0D), array(1D))").first()) == (2, 1.0, None)
