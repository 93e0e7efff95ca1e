import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import sharding

DOCS = "doc_id long, text string, shard int, slot int, h long"


def check(rows, docs, shards):
    text = defaultdict(list)
    for d in docs:
        text[d[0]].append(d[1] or "")
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (i is not None, i or 0, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, many in text.items() for t in many
    )
    slots, size, cut = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
        cut[r["text_crc32"], r["size"]].add(r["shard"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[i] for i in range(shards)], cut


def test_bytes_are_near_equal_and_texts_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 150)
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))), 1, 1, 1) for i in range(3000)]
    docs += [(5000 + i, docs[i % 40][1], 1, 1, 1) for i in range(400)]
    df = spark.createDataFrame(docs, DOCS).repartition(7)
    rows = sharding.assign(df, 16).collect()
    sizes, cut = check(rows, docs, 16)
    share, longest = sum(sizes) / 16, max(r["size"] for r in rows)
    assert max(abs(s - share) for s in sizes) <= max(0.02 * share, longest)
    assert all(len(s) == 1 for s in cut.values())
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, sharding.assign(df.repartition(3), 16).collect())) == sorted(map(key, rows))


def test_copies_of_one_text_are_split_where_they_must(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 100)
    docs = [(i, "copy of a text", 1, 1, 1) for i in range(1500)] + [(2000 + i, f"text {i:07d} x", 1, 1, 1) for i in range(1500)] + [(9000 + i, None, 1, 1, 1) for i in range(1500)]
    df = spark.createDataFrame(docs, DOCS)
    rows = sharding.assign(df, 16).collect()
    sizes, _ = check(rows, docs, 16)
    assert max(sizes) <= 1.03 * sum(sizes) / 16 and min(sizes) >= 0.97 * sum(sizes) / 16
    plan = sharding.plan(sharding.with_keys(df), 16)
    counts = sharding.histogram(sharding.with_keys(df), plan.keys)
    assert max(c[1] for c in counts.values()) <= 125


def test_odd_rows(spark):
    docs = [(None, None, 1, 1, 1), (None, "", 1, 1, 1), (1, "x" * 3_000_000, 1, 1, 1), (2, "a", 1, 1, 1), (2, "a", 1, 1, 1), (2, "b", 1, 1, 1)]
    check(sharding.assign(spark.createDataFrame(docs, DOCS), 16).collect(), docs, 16)
    assert sharding.assign(spark.createDataFrame([], DOCS), 16).count() == 0
    one = sharding.assign(spark.createDataFrame(docs[:1], DOCS), 1).collect()
    assert [(r["shard"], r["slot"], r["size"]) for r in one] == [(0, 0, 1)]


def test_cells_of_keys():
    rng = random.Random(3)
    keys = [(rng.randint(-4, 4), rng.randint(-4, 4)) for _ in range(500)]
    probes = sorted({sharding._key(rng.randint(-4, 4), rng.randint(-4, 4)) for _ in range(25)})
    h, t = (sharding.np.array(x, sharding.np.int64) for x in zip(*keys, strict=True))
    assert sharding._cells_of(h, t, *sharding._arrays(probes)).tolist() == [sum(p <= sharding._key(*k) for p in probes) for k in keys]


def test_written_shards_hold_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i}" * (i % 9), i) for i in range(900)], "doc_id long, text string, h int")
    sharding.write(docs, str(tmp_path / "out"), 8)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.select("doc_id", "text", "h").collect()) == sorted(docs.collect())
    want = sharding.assign(docs, 8).select("doc_id", F.col("shard").alias("s"))
    assert back.join(want, "doc_id").where("shard <> s").count() == 0
