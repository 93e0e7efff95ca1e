import random
from collections import Counter
from itertools import permutations

from tessera.llm import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, failed int, mask int"


def plain_fails(text):
    words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in text).split(" ") if w]
    found = "A" if len(words) < 200 else ""
    found += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    found += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    return found + ("D" if set(text) & set("#$%&*|") else "")


def plain(docs, labels):
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    least = {}
    for d in docs:
        if d[0] is not None:
            least[d[1] or ""] = min(least.get(d[1] or "", d[0]), d[0])
    rows = [(d[2] or "", plain_fails(d[1] or "") + ("E" if d[0] is not None and d[0] > least[d[1] or ""] else ""), d[0] in good, d[0] in toxic) for d in docs]
    found, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for p in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(p, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fails = sum(x in r[1] for r in mine)
                found[part, "".join(p), step] = [len(left), len(gone), fails - len(gone), sum(r[1] == x for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                shapley[part, x] += len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items())


def result(spark, docs, labels):
    found = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string"))
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


def test_intervals_are_the_removal_steps():
    orders = ["".join(p) for p in permutations("ABCDE")]
    assert [audit.lehmer_rank(p) for p in orders] == list(range(120))
    for mask in range(1, 32):
        fails = {x for i, x in enumerate("ABCDE") if mask >> i & 1}
        steps = Counter((s, r) for s, a, b in audit.removal_intervals(mask) for r in range(a, b))
        assert steps == Counter((min(p.index(x) for x in fails) + 1, r) for r, p in enumerate(orders))


def test_equals_every_order_applied(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "B", "cat", "Dog", "ein", "漢字", "x#", "Ünder", "two three"])
    docs = []
    for i in range(150):
        n = rng.choice([0, 1, 5, 199, 200, 201, 400])
        words = [f"w{k}" if rng.random() < 0.6 else word() for k in range(n)]
        text = rng.choice([None, "", rng.choice([" ", "\n", "\t \x0b"]).join(words), docs[-1][1] if docs else ""])
        docs.append((i // 2 if rng.random() < 0.1 else i, text, rng.choice(["en", "de", None, ""]), "s", 1, "x", 1, 1))
    docs += [(None, docs[3][1], "en", None, None, None, None, None), docs[5], docs[5], (900, "A" * 300_000 + " #", "fr", None, None, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "p") for i in range(0, 160, 2)] + [(4, 1, 1, "p"), (None, 1, 1, "p")]
    assert result(spark, docs, labels) == plain(docs, labels)


def test_limits_are_exact(spark):
    distinct = [f"w{i}" for i in range(200)]
    docs = [" ".join(distinct), " ".join(distinct[:199]), " ".join(distinct[:100] * 2), " ".join([*distinct[:99], "w0"] * 2), "ABC" + "x" * 97, "ABCD" + "x" * 96]
    rows = spark.createDataFrame([(t,) for t in docs], "t string").select(audit.failures(audit.F.col("t")))
    assert [r[0] for r in rows.collect()] == [0, 1, 0, 2, 1, 5]


def test_empty_tables(spark):
    assert result(spark, [], []) == []
    assert len(result(spark, [(None, None, None, None, None, None, None, None)], [])) == 600
