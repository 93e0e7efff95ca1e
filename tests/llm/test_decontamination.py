"""Decontamination against a brute force that compares all diagonals without seeds."""

import math
import random
import re
from itertools import combinations

from tessera.llm import decontamination as D


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    found = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            width = min(13, len(v))
            for shift in range(-len(v) + 1, len(w)) if v else ():
                same = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(v)]
                best = max(sum(same[s : s + width]) for s in range(len(v) - width + 1))
                if best >= math.ceil(width * 0.8):
                    old = found.get((d, i), (0, 0, 0))
                    found[d, i] = (max(old[0], sum(same)), len(v), max(old[2], best))
    return found


def test_masks_hit_every_placement():
    for n in range(1, 14):
        masks = D.masks_for(n)
        for differ in combinations(range(n), n - math.ceil(n * 0.8)):
            assert any(not {at + p for p in m} & set(differ) for m in masks for at in range(n - m[-1])), (n, differ)


def test_overlaps_equal_all_diagonals(spark):
    rng = random.Random(11)
    pool = [f"w{k}" for k in range(900)]
    items = [(i, " ".join(rng.sample(pool, n))) for i, n in enumerate([*range(1, 21), 30, 40, *[13, 16, 20, 11] * 3])]
    items += [(90, None), (91, "..."), (92, "a b a b a b a b a b a b a")]
    docs = [(0, None), (1, ""), (2, "-"), (3, "a b a b a b a b a b a b a b a b a b")]
    for _, text in items[:-3]:
        for differ in range(5):
            v = words(text)
            for at in rng.sample(range(len(v)), min(differ, len(v))):
                v[at] = "other"
            noise = lambda: rng.sample(pool, rng.randrange(15))
            docs.append((len(docs), " ".join([*noise(), *v[rng.randrange(2) if differ else 0 :], *noise()])))
    got = D.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["item_words"], r["best"]) for r in got} == want
    assert len(got) == len(want) and any(n < 11 for _, n, _ in want.values())


def test_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 5), (None, text, 5), (2, None, 5), (3, "x", 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, text, 1), (7, text, 1), (None, text, 1), (8, None, 1)], "item_id long, text string, doc_id int")
    assert [tuple(r) for r in D.overlaps(docs, items).select("doc_id", "item_id", "matched", "item_words", "best").collect()] == [(1, 7, 20, 20, 13)]
    left = D.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["2", "3", "None"]
    assert D.overlaps(docs.limit(0), items).count() == 0 == D.overlaps(docs, items.limit(0)).count()
    assert D.decontaminate(docs, items.limit(0)).count() == 5
