"""The pipeline's near-copy stage against exact Jaccard similarity of all pairs."""

import random

import numpy as np

import corpus_pipeline
from conftest import DATA
from tessera.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    ids = sorted(i for i, _ in rows)
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in ids}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, i in enumerate(ids):
        for j in ids[:n]:
            common, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if common >= 0.8 * total:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in ids if root[i] == i}


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").orderBy("doc_id").limit(400).collect()]
    for k, (_, text) in enumerate([r for r in rows if len(r[1]) > 800][:120]):  # substituted words: similarity 0.6 to 1
        words = text.split()
        for at in rng.sample(range(len(words)), max(1, len(words) * (k % 10) // 200)):
            words[at] = f"other{at}"
        rows.append((10_000 + k, " ".join(words)))
    base = [f"b{k}" for k in range(300)]  # a group of near copies that all differ
    rows += [(20_000 + k, " ".join([*base[: 5 * k], f"own{k}", *base[5 * k + 1 :]])) for k in range(60)]
    rows += [(30_000, None), (30_001, ""), (30_002, "two words"), (30_003, "Two  words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == kept(rows)


def test_odd_rows(spark):
    rows = [(5, "same text " * 40), (5, "same text " * 40), (6, "same text " * 40), (None, "same text " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == ["5", "5", "None"]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("doc_id = -1"), "").count() == 0


def test_anchors_cover_their_balls():
    rng = np.random.default_rng(1)
    slices = rng.integers(0, 1 << 32, (40, simhash.SLICES), dtype=np.uint64)
    anchors = simhash.anchors_of(slices)
    assert [a >> 32 for a in anchors[0].tolist()] == list(range(simhash.SLICES))
    words = (anchors & 0xFFFFFFFF).astype(np.uint64)
    assert (simhash.anchors_of(words) == anchors).all()  # an anchor is its own
    assert np.bitwise_count(words ^ slices).max() == 1  # nothing is further than the covering radius


def test_recall_of_cut_and_inserted_texts(spark):
    rng = random.Random(8)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(150).collect()]
    rows = []
    for k, text in enumerate(texts):
        words = text.split()
        n = max(1, len(words) * rng.randrange(2, 17) // 100)
        at = rng.randrange(len(words) - n)
        rows += [(2 * k, text), (2 * k + 1, " ".join(words[:at] + words[at + n :] if k % 2 else words[:at] + [f"in{k}x{j}" for j in range(n)] + words[at:]))]
    similar = [k for k in range(len(texts)) if len(shingles(rows[2 * k][1]) & shingles(rows[2 * k + 1][1])) >= 0.8 * len(shingles(rows[2 * k][1]) | shingles(rows[2 * k + 1][1]))]
    left = {r["doc_id"] for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(2 * k + 1 not in left for k in similar)
    assert len(similar) > 100 and found >= 0.9 * len(similar)


def test_common_passage_in_many_texts(spark, monkeypatch):
    """Texts that share most of their words without being similar, and similar ones among them."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(80)]
    rows = [(k, " ".join([*passage, *(f"own{k}x{j}" for j in range(rng.randrange(5, 30)))])) for k in range(200)]
    rows += [(1_000 + k, text + f" more{k}") for k, text in rows[:40]]
    for few in (2, 1_000):
        monkeypatch.setattr(simhash, "FEW", few)
        got = {r["doc_id"] for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == kept(rows)


def test_sets_only_of_pairs_that_can_be_similar(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(rng.sample(base, 120))) for k in range(150)]  # the same words in other orders: all meet, none is similar
    rows += [(1000, " ".join(base)), (1001, " ".join([*base, "more"]))]
    made, materialize = [], simhash.materialize

    def watched(df, label):
        table = materialize(df, label)
        if label == "sets":
            made.extend(r["node"] for r in table.select("node").collect())
        return table

    monkeypatch.setattr(simhash, "materialize", watched)
    monkeypatch.setattr(simhash, "FEW", 1000)  # pairs by anchor, which need no sets
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert found == {**{k: k for k in range(150)}, 1000: 1000, 1001: 1000}
    assert set(made) == {simhash._node(simhash.shingle_set(t)) for i, t in rows if i >= 1000}


def test_bitmaps_bound_what_is_common():
    rng = np.random.default_rng(4)
    passed = 0
    for _ in range(400):
        n = rng.integers(0, 400)
        m = rng.integers(n * 4 // 5, n + 1)
        both = rng.integers(0, min(n, m) + 1)
        hashes = rng.integers(-(1 << 62), 1 << 62, n + m - both)
        one, two = np.unique(hashes[:n]), np.unique(hashes[n - both :])
        common = len(np.intersect1d(one, two))
        most = simhash.most_common(len(one), simhash.bitmap(one), len(two), simhash.bitmap(two))
        assert common <= most <= min(len(one), len(two))
        passed += most <= common + 0.5 * min(len(one), len(two))
    assert passed > 390  # and it is of use for sets of sizes near each other


def test_group_of_near_copies_leaves_no_all_pairs(spark, monkeypatch):
    """Near copies of one text that are not all similar to each other: compared with a few of the group, not with all of it."""
    rng = random.Random(6)
    base = [f"base{k}" for k in range(200)]
    rows = []
    for k in range(240):
        words = base.copy()
        for at in rng.sample(range(200), 1 if k % 2 else 4):  # those with 4 are similar to few but the base and those with 1
            words[at] = f"own{k}x{at}"
        rows.append((k, " ".join(words)))
    compared, possible = [], simhash._possible

    def watched(pairs, *args):
        compared.extend((r["src"], r["dst"]) for r in pairs.collect())
        return possible(pairs, *args)

    monkeypatch.setattr(simhash, "_possible", watched)
    got = {r["doc_id"] for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == kept(rows)
    assert len(compared) == len(set(compared)) < 7_170  # a quarter of all pairs
