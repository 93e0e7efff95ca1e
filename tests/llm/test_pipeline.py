"""Every stage of the pipeline against a brute-force version on that stage's own input."""

import bisect
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from conftest import DATA
from tessera.functions.shared import materialize
from tessera.llm import decontamination as D
from tessera.llm import packing, toxicity


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, input rows, output rows)] of a run over sf0.01 with planted documents."""
    folder, sf = str(tmp_path_factory.mktemp("sf")), f"{DATA}/sf0.01"
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    clean = [r for r in docs.where("length(text) > 2500").orderBy("doc_id").limit(3).collect()]
    item = max((r["text"] for r in benchmark.collect()), key=len)
    words = clean[1]["text"].split()
    texts = [clean[0]["text"], " ".join([*words[:40], "zebra", *words[41:]]), clean[2]["text"][:700] + " own words here", item, item.upper() + " tail", None, "", "x"]
    planted = spark.createDataFrame([(900_000 + i, t, "en", "planted", len(t or "")) for i, t in enumerate(texts)], docs.schema)
    docs.unionByName(planted).write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    now, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, now, folder), name)
        found.append((name, now, out))
        now = out
    return folder, {name: (before, after) for name, before, after in found}


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_documents_keep_their_columns(stages):
    _, found = stages
    for name, (before, after) in found.items():
        assert name == "packing" or before.schema.names == after.schema.names


def test_toxicity(spark, stages):
    folder, found = stages
    before, after = found["toxicity"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert set(texts_of(after)) == {r["doc_id"] for r in toxicity.score(before, labels).collect() if r["score"] < 0.7}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.where("toxic is not null").collect()}
    gone = set(texts_of(before)) - set(texts_of(after))
    assert gone  # how many are found depends on the labels: test_llm.py holds the recall of held-out rows at sf0.1
    assert sum(i in gone for i, t in toxic.items() if not t) < 0.02 * len(toxic)


def test_simhash(stages):
    """The rule of near-duplicate stages, five words and a similarity of 0.8, over all pairs of texts."""
    before, after = map(texts_of, stages[1]["simhash"])
    ids = sorted(before)
    sets = []
    for i in ids:
        w = (before[i] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(ids)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in range(len(ids)):
        for other in range(k):
            common = len(sets[k] & sets[other])
            if common >= 0.8 * (len(sets[k]) + len(sets[other]) - common):
                a, b = sorted((top(k), top(other)))
                root[b] = a
    assert set(after) == {ids[k] for k in range(len(ids)) if root[k] == k}
    assert not {900_000, 900_001} & set(after)


def test_repeats(stages):
    before, after = map(texts_of, stages[1]["repeats"])
    first, want = {}, {}
    for i in sorted(before):
        text = (before[i] or "").encode()
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - 49):
            if first.setdefault(text[p : p + 50], i) != i:
                gone[p : p + 50] = True
        left = np.frombuffer(text, np.uint8)[~gone].tobytes().decode(errors="replace")
        if left or not gone.any():
            want[i] = before[i] if before[i] is None else left
    squeeze = lambda t: t and re.sub("�+", "�", t)  # noqa: E731  (decoders differ in how many stand for one cut)
    assert {i: squeeze(t) for i, t in after.items()} == {i: squeeze(t) for i, t in want.items()}


def test_decontamination(spark, stages):
    folder, found = stages
    before, after = map(texts_of, found["decontamination"])
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    at = {}
    for i, w in items.items():
        for q, word in enumerate(w):
            at.setdefault(word, []).append((i, q))
    leaked = set()
    for d, text in before.items():
        w = words(text)
        for (item, shift), n in Counter((i, p - q) for p, word in enumerate(w) for i, q in at.get(word, ())).items():
            if n < np.ceil(min(D.WINDOW, len(items[item])) * D.SIMILAR):
                continue
            same = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(items[item])]
            width = min(D.WINDOW, len(same))
            if max(sum(same[s : s + width]) for s in range(len(same) - width + 1)) >= np.ceil(width * D.SIMILAR):
                leaked.add(d)
    assert set(after) == set(before) - leaked and leaked


def test_packing(stages):
    before, after = stages[1]["packing"]
    enc = packing.encoding(packing.ranks_path())
    want = {i: len(enc.encode_ordinary(t or "")) + 1 for i, t in texts_of(before).items()}
    rows = after.collect()
    length, place = {}, {}
    for r in rows:
        length[r["doc_id"]] = length.get(r["doc_id"], 0) + r["length"]
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert length == want
    for s in place.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
    gaps = []
    bins = 0
    for n in sorted((r["length"] for r in rows), reverse=True):  # best-fit decreasing, one piece at a time
        k = bisect.bisect_left(gaps, n)
        bins += k == len(gaps)
        gap = gaps.pop(k) if k < len(gaps) else 2048
        bisect.insort(gaps, gap - n)
    assert len(place) == bins
