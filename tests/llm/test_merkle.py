import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `_node` int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root and, for each node, the (left, right) siblings of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            low = i // 16 * 16
            p.append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 16])))
        nodes, at = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], paths


def plain(rows):
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append((order(r[0]), plain_leaf(r, r[1]), r))
    trees = []
    for s in sorted(sources, key=order):
        members = sorted(sources[s], key=lambda m: m[:2])
        trees.append((members, *plain_tree([m[1] for m in members])))
    root, upper = plain_tree([t[1] for t in trees])
    found = []
    for (members, subroot, paths), above in zip(trees, upper, strict=True):
        for (_, leaf, r), path in zip(members, paths, strict=True):
            text, proof = r[1], path + above
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = plain_leaf(r, text)
            for left, right in proof:
                now = h(left, now, right)
            found.append((r[0], leaf, subroot, root, h(*(a + b for a, b in proof)), now, now == root))
    return found


def result(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r) for r in queries.op11_merkle(spark, str(tmp_path)).collect()]


def odd_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcÄßé漢ABC ") for _ in range(rng.randint(0, 30)))
    rows = [(i, word(), "en", "big", 3, "x", 1) for i in range(700)]
    rows += [(1000 + i, word(), None, "mid", None, None, None) for i in range(257)]
    rows += [(2000 + i, word(), "de", "ä", 1, None, None) for i in range(17)]
    rows += [(3000 + i, None, None, None, None, None, None) for i in range(16)]
    rows += [(4000, "One", "en", "only", 3, None, None), (None, None, None, "Z", None, None, None), (None, "b", None, "Z", None, None, None)]
    rows += [(5000, "Same", "en", "Z", 4, None, None)] * 3 + [(5000, "other", "en", "Z", 5, None, None), (5001, "A" * 200_000, "en", "", 200_000, None, None), (5002, "", "", "", 0, None, None)]
    return rows + [(6000 + i, "s", "en", f"s{i:03d}", 1, None, None) for i in range(300)]


def test_equals_plain_trees(spark, tmp_path):
    rows = odd_rows()
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(result(spark, rows, tmp_path), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 256])
def test_sizes_of_one_source(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", 1, None, None) for i in range(n)]
    assert sorted(result(spark, rows, tmp_path)) == sorted(plain(rows) if rows else [])


def test_columns_are_carried_and_guarded(spark):
    rows = spark.createDataFrame([(1, "a", h("1"), 7), (2, "a", h("2"), 8)], "doc_id long, source string, leaf string, _at int")
    found = {r["doc_id"]: r for r in merkle.manifest(rows).collect()}
    assert [found[1]["_at"], found[2]["_at"]] == [7, 8]
    assert found[1]["proof"] == [("", h("2"))] and found[1]["subroot"] == found[1]["root"] == h(h("1"), h("2"))
    with pytest.raises(ValueError):
        merkle.manifest(rows.withColumnRenamed("_at", "root"))


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).select(*merkle.FIELDS)
    rows = docs.select("doc_id", "source", merkle.leaves(docs).alias("leaf"))
    a, b = (merkle.manifest(rows.repartition(n)).select("leaf", "root", merkle.siblings_digest("proof")).collect() for n in (1, 13))
    assert sorted(a) == sorted(b)
