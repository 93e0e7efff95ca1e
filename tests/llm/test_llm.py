import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import pytest
import xxhash

from conftest import DATA
from tessera.llm import attention, decontamination, exchange, html, lm, packing, repeats, simhash, substring, topk, toxicity
from tessera.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "same text " * 40), (5, "same text " * 40), (6, "same text " * 40), (None, "same text " * 40), (7, "é" * 3000), (8, "a " * 30000)]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 0) for i, t in ODD], "doc_id long, text string, label string, anchor string, n_chars long")


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 20_000)


def texts(n, seed=1):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 200))) for _ in range(n)]
    return [(i, (base[rng.randrange(n)][:300] if rng.random() < 0.4 else "") + t) for i, t in enumerate(base)]


def test_repeats_equal_brute_force(spark, small_chunks):
    rows = texts(80)
    first = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        assert bytes(got[i]["kept"]).decode() == "".join(c for c, g in zip(t, gone, strict=True) if not g)
        assert got[i]["n_removed"] == gone.sum()


def test_interval_tree_finds_all_maximal_repeats():
    rng = random.Random(2)
    pieces = ["".join(rng.choice("ab") for _ in range(30)).encode() for _ in range(6)]
    n = [len(p) - 4 for p in pieces]
    (lengths, one, two), larger = repeats.maximal_repeats(pieces, n, 5)
    got = {(int(m), frozenset((int(a), int(b)))) for m, a, b in zip(lengths, one, two, strict=True)} | {(int(m), frozenset(map(int, x))) for m, x in larger}
    places = [(p, k) for p in range(6) for k in range(n[p])]
    want = set()
    for length in range(5, 31):
        where = {}
        for w, (p, k) in enumerate(places):
            if k + length <= len(pieces[p]):
                where.setdefault(pieces[p][k : k + length], []).append(w)
        for found in where.values():
            right = {pieces[places[w][0]][places[w][1] + length : places[w][1] + length + 1] or w for w in found}
            left = {pieces[places[w][0]][places[w][1] - 1 : places[w][1]] or w for w in found}
            if len(found) > 1 and len(right) > 1 and len(left) > 1:
                want.add((length, frozenset(found)))
    assert got == want


def test_substring_equals_brute_force(spark, small_chunks):
    rows = texts(80, 5)
    first = {}
    split = [(i, t.encode().split()) for i, t in rows]
    for i, w in split:
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    got = {r["doc_id"]: r for r in substring.remove_known_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, w in split:
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest() and got[i]["n_removed"] == sum(gone)


def test_covering_finds_every_close_pair(spark):
    rng = np.random.default_rng(1)
    fps = set()
    for x in rng.integers(0, 2**63, 60, dtype=np.uint64).tolist():
        for _ in range(12):
            y = x
            for k in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                y ^= 1 << k
            fps.add(y)
    fps = np.array(sorted(fps), np.uint64)
    part = {int(f): {int(f)} for f in fps.view(np.int64)}

    def join(a, b):
        if part[a] is not part[b]:
            part[a] |= part[b]
            for x in part[b]:
                part[x] = part[a]

    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(f ^ fps[i + 1 :]) <= 3]:
            join(int(f.view(np.int64)), int(g.view(np.int64)))
    got = simhash.connected_components(simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"))).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(s) for s in groups.values()} == {frozenset(s) for s in part.values() if len(s) > 1}


def test_fingerprint_equals_definition():
    for text in ("", "One", "a b", "The QUICK brown fox jumps over the lazy dog é"):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(x, 42) for x in ([b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else []))]
        want = sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))
        assert simhash.fingerprint(text) % (1 << 64) == want


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 8), (902, [None] * 8)]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = np.floor(1024 * x.astype(float)).astype(int)
    for q in range(0, 700, 100):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(700) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_packing_places_every_token_once(spark, odd):
    rows = packing.pack(odd).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 2048 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False))
    enc = packing.encoding(packing.ranks_path())
    ids = np.array(enc.encode_ordinary(ODD[-1][1]) + [0], "<u4")
    mine = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == 8)
    assert [m[3] for m in mine] == [zlib.crc32(ids[s : s + n].tobytes()) for _, s, n, _ in mine] and sum(m[2] for m in mine) == len(ids)


def test_html_keeps_the_article(spark):
    for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").limit(100).collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert html.main_text(r["html"]) == "\n".join(b for b in blocks if b)
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav><a href=x>menu</a></nav>") == ""


def test_lm_base_counts(spark, small_chunks):
    rows = texts(60, 9)
    train = {}
    tokens = [(i, [*t.encode().lower().split(), None]) for i, t in rows]
    for i, w in tokens:
        for x in w if zlib.crc32(str(i).encode()) % 7 != 2 else ():
            train[x] = train.get(x, 0) + 1
    n, v = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, w in tokens:
        want = sum(np.log10((train.get(x, 0) + 1) / (n + v + 1)) for x in w)
        assert abs(got[i]["base_score"] - want) < 1e-8 and (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(x in train for x in w), n)
        assert got[i]["score"] < 0


def test_attention_is_a_distribution_and_causal():
    rng = np.random.default_rng(0)
    v = attention.Vocabulary(rng.integers(0, 50, attention.IDS).astype(float), rng.integers(0, 2, attention.IDS))
    assert np.allclose(np.bincount(v.of, np.exp(v.within), attention.CLASSES), 1, atol=1e-3)
    p = attention.initial(v)
    ids = rng.integers(0, 5000, 60)
    a = attention.score_ids(p, v, ids, np.array([60]))
    ids[40] += 1
    assert np.allclose(a[:40], attention.score_ids(p, v, ids, np.array([60]))[:40])


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(7)
    words = ["w%d" % i for i in range(5000)]
    item = rng.sample(words, 40)
    leak, far = item.copy(), item.copy()
    leak[6] = leak[20] = "zz"
    far = [w if k % 3 else "yy" for k, w in enumerate(far)]
    noise = lambda: " ".join(rng.sample(words, 60))
    docs = [(1, f"{noise()} {' '.join(leak)} {noise()}"), (2, noise()), (3, " ".join(far)), (4, None), (None, " ".join(item))]
    found = decontamination.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item)), (10, None)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["matched"]) for r in found] == [(1, 9, 38)]


def test_toxicity_on_held_out_rows(spark):
    got = QUERIES["op2_toxicity"](spark, f"{DATA}/sf0.1").toPandas().merge(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.02


def test_odd_rows_and_empty_tables(spark, odd):
    none = odd.where("doc_id = -1")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    for run in (repeats.remove_repeats, substring.remove_known_spans, simhash.near_duplicates, lm.score, lambda d: toxicity.score(d, labels)):
        assert run(odd).count() == len(ODD)
        assert run(none).count() == 0
    assert packing.pack(none).count() == 0
    kept = {r["doc_id"] for r in simhash.keep_one(odd).collect()}
    assert 6 not in kept and {5, None} <= kept
    left = {r["doc_id"]: r["text"] for r in repeats.deduplicated(odd).collect()}
    assert 6 not in left and left[5] == ODD[4][1] and left[1] is None
