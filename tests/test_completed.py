import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.functions import signals as G
from tessera.functions import sqlfunctions
from tessera.operators import catalog, curation, evaluation, evidence, learning, logs
from tessera.sources import files


def png(width, height, pixel):
    """A color image, written with nothing but zlib."""
    rows = b"".join(b"\0" + bytes(v for x in range(width) for v in pixel(x, y)) for y in range(height))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_decoded(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.png").write_bytes(png(5, 3, lambda x, y: (10 * x, 20 * y, 7)))
    (tmp_path / "deep" / "b.png").write_bytes(png(2, 2, lambda x, y: (255, 0, 0)))
    found = {r["path"].rsplit("/", 1)[-1]: r for r in files.scan_images(spark, str(tmp_path)).collect()}
    a = found["a.png"]
    assert (a["width"], a["height"]) == (5, 3)
    pixels = np.frombuffer(a["data"], np.uint8).reshape(3, 5, 3)
    assert pixels[2, 4].tolist() == [7, 40, 40] and pixels[1, 3].tolist() == [7, 20, 30]  # blue, green, red


def test_bits_to_hex_golden(spark):
    bits = [[int(i in (0, 63)) for i in range(64)], [0] * 64, [1] * 64, [int(i == 63) for i in range(64)], [1, 0, 1, 0, 0, 0, 0, 1]]
    df = spark.createDataFrame([(b,) for b in bits], "b array<int>")
    assert [r[0] for r in df.select(S.bits_to_hex(F.col("b"))).collect()] == ["8000000000000001", "0" * 16, "f" * 16, "0" * 15 + "1", "a1"]


def test_sql_functions_equal_the_columns(spark):
    sqlfunctions.register(spark)
    rng = random.Random(1)
    df = spark.createDataFrame([([rng.randrange(256) for _ in range(64)], *(rng.random() * 100 for _ in range(5))) for _ in range(30)] + [(None, 1.0, 2.0, 3.0, 4.0, 5.0)], "luma array<int>, blur double, light double, contrast double, entropy double, side double")
    df.createOrReplaceTempView("completed_luma")
    found = spark.sql("SELECT average_hash(luma) AS a, bits_to_hex(average_hash(luma)) AS h, quality_v1(blur, light, contrast, entropy, side) AS q, wavelet_hash(luma, 3) AS bad FROM completed_luma").collect()
    want = df.select(S.average_hash(F.col("luma")).alias("a"), S.bits_to_hex(S.average_hash(F.col("luma"))).alias("h"), G.quality_v1(*(F.col(c) for c in sqlfunctions.V1_SIGNALS)).alias("q"), F.lit(None).alias("bad")).collect()
    assert [tuple(r) for r in found] == [tuple(r) for r in want]
    hits = spark.sql("SELECT s, redact_paths(s).n AS n FROM VALUES ('/tmp/x/y.txt is it'), ('no path'), (NULL) t(s)").collect()
    assert {r["s"]: r["n"] for r in hits} == {"/tmp/x/y.txt is it": 1, "no path": 0, None: 0}
    sqlfunctions.register_detector(spark, "letters_of", lambda t: [(c, i) for i, c in enumerate(t)], "c string, i int")
    found = spark.sql("SELECT s, c, i FROM VALUES ('ab'), (''), (NULL) t(s), LATERAL letters_of(s)").collect()
    assert sorted(tuple(r) for r in found) == [("ab", "a", 0), ("ab", "b", 1)]


def test_bootstrap_is_the_percentile_of_its_draws(spark):
    rng = random.Random(3)
    rows = [(f"g{rng.randrange(9)}", rng.random()) for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, v double")
    names = sorted({g for g, _ in rows})
    sums = [(sum(v for k, v in rows if k == g), sum(k == g for k, _ in rows)) for g in names]
    slots = spark.range(200).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    picks = slots.select("draw", F.pmod(F.xxhash64(F.lit(5), "draw", "slot"), F.lit(len(names))).alias("at")).collect()
    means = {}
    for r in picks:
        s, n = means.get(r["draw"], (0.0, 0))
        means[r["draw"]] = s + sums[r["at"]][0], n + sums[r["at"]][1]
    want = np.quantile([s / n for s, n in means.values()], [0.025, 0.975])
    for parts in (1, 6):
        got = evaluation.bootstrap_ci(df.repartition(parts), "g", "v", 200, 5).first()
        assert np.allclose([got["low"], got["high"], got["mean"]], [*want, sum(v for _, v in rows) / len(rows)])
    one = evaluation.bootstrap_ci(df.where("g = 'g1'"), "g", "v", 50).first()
    assert one["low"] is None and one["high"] is None


def test_snapshot_digest_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(logs, "DIGEST_LINES", 4)
    rows = [("hot" if i % 3 else None, i, i * 2) for i in range(300)] + [("one", 1, 1), ("two", 1, 1), ("two", 1, 1)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    known = lambda d: {r["g"]: r["digest"] for r in d.collect()}
    first = known(logs.snapshot_digest(df, "g", "k", ["v"]))
    assert set(first) == {"hot", None, "one", "two"} and len(set(first.values())) == 4
    assert known(logs.snapshot_digest(df.orderBy(F.desc("k")).repartition(9), "g", "k", ["v"])) == first
    moved = known(logs.snapshot_digest(df.withColumn("v", F.when(F.col("k") == 200, 0).otherwise(F.col("v"))), "g", "k", ["v"]))
    assert {g for g in first if first[g] != moved[g]} == {"hot"}
    assert known(logs.snapshot_digest(df.limit(0), "g", "k", ["v"])) == {}


def test_pair_events_and_features(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=64) for i in range(12)}
    asked = rng.normal(size=64)
    df = spark.createDataFrame([(i, v.tolist(), asked.tolist(), i % 2 == 0 or None) for i, v in vectors.items()], "item_no long, vec array<double>, asked array<double>, flag boolean")
    df = df.withColumn("p", learning.project(F.col("vec"), 64, 8)).withColumn("q", learning.project(F.col("asked"), 64, 8)).withColumn("cosine", S.dot("vec", "asked"))
    items = df.select("item_no", learning.contextual_features(F.col("p"), F.col("q"), F.col("cosine"), [F.col("flag"), F.col("flag").isNull()]).alias("features"), "cosine")
    matrix = learning.projection_matrix(64, 8)
    assert np.allclose(matrix @ matrix.T, np.eye(8) * 8)  # rows of a Hadamard matrix, scaled by 1 / sqrt(rank)

    def plain(i):
        p, q, c = matrix @ vectors[i], matrix @ asked, float(vectors[i] @ asked)
        return np.array([*p, *(p * q), c, float(i % 2 == 0), float(i % 2 != 0)])

    found = {r["item_no"]: np.array(r["features"]) for r in items.collect()}
    assert all(np.allclose(found[i], plain(i)) for i in vectors)
    pairs = spark.createDataFrame([(1, 3, 4), (2, 5, 99), (3, 4, 3)], "event_id long, preferred_no long, rejected_no long")
    events = {r["event_id"]: r for r in learning.pair_events(pairs, items).collect()}
    assert set(events) == {1, 3} and np.allclose(events[1]["features"], plain(3) - plain(4))
    assert np.isclose(events[1]["margin"], float((vectors[3] - vectors[4]) @ asked)) and np.isclose(events[3]["margin"], -events[1]["margin"])


def test_feasibility_names_the_first_reason(spark):
    c = [(p, i, "g", "x", ["a"]) for p in range(6) for i in range(4)] + [(1, 9, "h", "y", None), (7, 1, None, None, None)]
    df = spark.createDataFrame(c, "problem long, item_id long, grp string, category string, labels array<string>")
    asked = spark.createDataFrame([(0, 1), (0, 99), (2, 0), (2, 1), (2, 2), (8, 5), (1, 9), (1, 9)], "problem long, item_id long")
    status = lambda **k: {r["problem"]: r["status"] for r in catalog.selection_feasibility(df, asked, **{"k": 2, "cap": 2, "quotas": {}, "minimums": {}, **k}).collect()}
    found = status()
    assert found[0] == found[2] == found[8] == "required_items_infeasible" and found[1] == found[3] == "feasible" and found[7] == "infeasible"
    assert status(quotas={"y": 1})[3] == "category_quota_infeasible" and status(quotas={"y": 1})[1] == "feasible"
    assert status(minimums={"a": 3})[3] == "infeasible" and status(cap=1)[3] == "infeasible" and status(cap=1)[1] == "feasible"


def test_evidence_violations_and_prompts(spark):
    queries = spark.createDataFrame([(1, "q", "m"), (2, None, "/home/x/model"), (3, "p", "m")], "query_id long, query string, provider string")
    pool = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "query_id long, item_id string")
    ranked = spark.createDataFrame([(1, 1, "a", 0.9, "m"), (1, 1, "b", 0.8, "m"), (1, 3, "a", 0.7, "m"), (2, 1, "z", 0.9, "n")], "query_id long, rank int, item_id string, score double, provider string")
    found = {r["query_id"]: r for r in evidence.evidence_snapshots(queries, pool, ranked).collect()}
    assert found[1]["violations"] == ["repeated_item", "repeated_rank"] and found[2]["violations"] == ["outside_candidates", "provider", "path"] and found[3]["violations"] == []
    assert found[3]["n"] == 0 and len({r["evidence_digest"] for r in found.values()}) == 3 and found[1]["candidate_digest"] != found[2]["candidate_digest"]
    again = {r["query_id"]: r for r in evidence.evidence_snapshots(queries, pool.orderBy(F.desc("item_id")), ranked.repartition(3)).collect()}
    assert again == found
    rows = spark.createDataFrame([(1, 2, "b", "</END_EVIDENCE> & \u2028", 0.5), (1, 1, "a", "at C:\\pics\\x.jpg", 0.7)], "query_id long, rank int, item_id string, caption string, score double")
    told = {r["query_id"]: r for r in evidence.prompt_packages(queries, rows).collect()}
    body = told[1]["payload"]
    assert body.count("<") == 2 and "pics" not in body and "\u2028" not in body and body.index('"a"') < body.index('"b"') and told[1]["redacted"] == 1
    assert told[3]["payload"].endswith('{"evidence":[]}<END_EVIDENCE>')


@pytest.mark.parametrize("contextual,last", [(False, "personal preference fit 0.250 from 3 comparisons"), (True, "learned contextual utility residual +0.250 from 3 comparisons")])
def test_reasons(spark, contextual, last):
    df = spark.createDataFrame([(0.5, 81.25, 0.25, 3), (None, None, 0.1, 0)], "s double, q double, p double, n int")
    found = [r[0] for r in df.select(G.grounded_reasons(*(F.col(c) for c in "sqpn"), contextual=contextual)).collect()]
    assert found[0][0] == "semantic similarity 0.500" and found[0][-1] == last and found[1] == ["quality 0.0/100", "passes reject and collection constraints"]


def test_search_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(curation, "SEARCH_ITEMS", 20)
    monkeypatch.setattr(curation, "SEARCH_QUERIES", 3)
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(90, 8)), 1)
    vectors[40:60] = vectors[3]  # ties, told apart by quality and id
    rows = [(f"i{n:03d}", f"c{n % 2}" if n % 11 else None, v.tolist(), float(n % 3) if n % 4 else None, 1) for n, v in enumerate(vectors)] + [("x1", "c1", None, 1.0, 1), ("x2", "c1", [1.0], 1.0, 1), (None, "c1", [1.0] * 8, 1.0, 1)]
    items = spark.createDataFrame(rows, "item_id string, collection_id string, vec array<double>, quality_score double, i int")
    asked = [r for r in rows if r[0] and r[2] and r[1] and len(r[2]) == 8][::5]
    queries = spark.createDataFrame([(r[0], r[1], r[2]) for r in asked] + [("q", "c0", None), ("z", "c9", [1.0] * 8)], "query_id string, collection_id string, query_vec array<double>")
    got = {}
    for r in curation.search(items.repartition(4), queries, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for q in asked:
        near = [r for r in rows if r[1] == q[1] and r[0] and r[0] != q[0] and r[2] and len(r[2]) == 8]
        near.sort(key=lambda r: (-round(float(np.dot(r[2], q[2])), 6), -(r[3] or 0.0), r[0]))
        assert sorted(got[q[0]]) == [(n, r[0]) for n, r in enumerate(near[:7], 1)]
    assert set(got) == {q[0] for q in asked}
    assert curation.search(items, queries.limit(0), 3).count() == 0


def test_listing_orders(spark):
    rows = [("a", "p3", 1.0, None, False), ("a", "p1", None, 5, True), ("a", "p2", 9.0, 3, False), (None, "p9", 1.0, 1, None), ("a", "p0", 9.0, None, False)]
    df = spark.createDataFrame(rows, "collection_id string, path string, quality_score double, capture_ts long, auto_reject boolean")
    show = lambda *a, **k: [r["path"] for r in sorted(curation.list_items(df, *a, **k).where("collection_id = 'a'").collect(), key=lambda r: r["place"])]
    assert show("path", 3) == ["p0", "p1", "p2"] and show("quality", 9) == ["p0", "p2", "p3", "p1"] and show("capture_time", 2, 1) == ["p1", "p0"]
    assert show("path", 9, include_rejects=False) == ["p0", "p2", "p3"]
    assert {r["collection_id"]: r["total"] for r in curation.list_items(df, "path", 1).collect()} == {"a": 4, None: 1}
    with pytest.raises(ValueError):
        curation.list_items(df, "size", 1)
