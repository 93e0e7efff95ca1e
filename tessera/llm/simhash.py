"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is two halves of 32 bits. Two fingerprints that differ in at most 3 bits differ in at
most 1 bit in one of the halves. The anchors of a half are the words of a covering code of radius 1: the
perfect [31, 26] Hamming code times one free bit. Each fingerprint is at home at its nearest anchor (at
most 1 away), and is replicated to every anchor within radius + threshold = 2 (2 or 17 of the 2^27), so a
pair always meets at the home of either. Per anchor, residents are compared with visitors by popcount.

Equal fingerprints are one node with their smallest doc_id, so groups of exact copies cost one row. An
anchor with many residents is dealt into blocks of residents; its visitors go to every block. A group
leaves a spanning forest of its links, never all pairs.

similar_components() serves a similarity of texts instead of a distance of fingerprints. Texts that share 0.8 of
their 5-word shingles differ in far more than 3 of 64 bits, so it covers a wider fingerprint of SLICES parts of
32 bits, over the distinct words of a text, with the same code: a part is replicated to every anchor within the
covering radius, and as the code is perfect that is one anchor. Texts that meet at an anchor are candidates, and
the exact similarity of their shingle sets decides. A group is joined by stars first, around a text of each anchor and
of each rare shingle, so it leaves no all pairs.
Most candidates share little. A bitmap of a text's shingles bounds from above how many two texts have in common, so
sets are made, and meet, only for the pairs that this bound leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize, temporary_tables
from tessera.llm.exchange import mix
from tessera.llm.inputs import documents
from tessera.operators.graph import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_DISTANCE = 3
#: Residents of an anchor in one block, about.
BLOCK = 256
#: Anchors with more residents than a block that may be broadcast; beyond, an ordinary join finds them.
BROADCAST_ANCHORS = 50_000
_POSITIONS = np.arange(1, 32, dtype=np.uint64)

#: For similar texts: words of a shingle, least Jaccard similarity, parts of 32 bits of the wide fingerprint.
SIMILAR_WORDS, SIMILAR = 5, 0.8
SLICES = 96
_STREAMS = (np.arange(SLICES // 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
#: Texts at an anchor up to which all their pairs are candidates; beyond, those with a rare shingle in common.
FEW = 12
#: Texts whose sketches a task holds at once.
BATCH = 250
#: Bits of a bitmap for each shingle, at least.
BITS = 4
#: Rows of ids that may be broadcast; beyond, an ordinary join finds them.
BROADCAST_IDS = 500_000


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the XXH64 of the text's shingles, repeats included."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = tokens[at : min(at + (1 << 16), n) + words - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(part) >= words else [b" ".join(part)]
        digests = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        votes += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return documents(docs).mapInPandas(run, "doc_id long, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), np.uint64)
    for p in _POSITIONS:
        out ^= ((half >> (p - np.uint64(1))) & np.uint64(1)) * p
    return out


def _flip(half: np.ndarray, position: np.ndarray) -> np.ndarray:
    """half with the bit at position 1 to 31 flipped; position 0 flips nothing."""
    return np.where(position > 0, half ^ (np.uint64(1) << (np.maximum(position, np.uint64(1)) - np.uint64(1))), half)


def home_anchor(half: np.ndarray) -> np.ndarray:
    return _flip(half, _syndrome(half))


def near_anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every anchor within 2 of each 32-bit value."""
    s, top = _syndrome(half), np.uint64(1) << np.uint64(31)
    home, rows = _flip(half, s), np.arange(len(half))
    found = [(rows, home), (rows, home ^ top)]
    for a in _POSITIONS:
        use = (s > 0) & (a < (a ^ s)) & ((a ^ s) > 0)
        found.append((rows[use], _flip(_flip(half[use], np.full(use.sum(), a)), a ^ s[use])))
    return np.concatenate([r for r, _ in found]), np.concatenate([x for _, x in found])


def _anchored(nodes: DataFrame, homes: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64).view(np.uint64)
            for side in (0, 1):
                half = (fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                rows, anchors = (np.arange(len(fp)), home_anchor(half)) if homes else near_anchors(half)
                key = (anchors | (np.uint64(side) << np.uint64(32))).view(np.int64)
                yield pd.DataFrame({"anchor": key, "fp": fp[rows].view(np.int64)})

    return nodes.select("fp").mapInPandas(run, "anchor long, fp long")


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join two parts not joined before."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    kept = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append((a, b))
    return kept


def _compare(block: np.ndarray, fp: np.ndarray, resident: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, fp) of rows sorted by block, residents first: each visitor's first one and a forest of residents."""
    start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[start, len(block)])
    here = np.add.reduceat(resident.astype(np.int64), start)
    first, count = np.repeat(start, size), np.where(resident, 0, np.repeat(here, size))
    visitors = np.flatnonzero(count)
    left, right = [], []
    step = 1 << 20
    edges = np.searchsorted(np.cumsum(count[visitors]), np.arange(0, count.sum() + step, step))
    for a, b in zip(edges, np.r_[edges[1:], len(visitors)], strict=True):
        v = visitors[a:b]
        if not len(v):
            continue
        n = count[v]
        who = np.repeat(v, n)
        with_ = np.repeat(first[v], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gap = np.bitwise_count(fp[who].view(np.uint64) ^ fp[with_].view(np.uint64))
        hit = (gap <= distance) & (gap > 0)
        who, with_ = who[hit], with_[hit]
        if not len(who):
            continue
        lead = np.r_[True, who[1:] != who[:-1]]
        left.append(fp[who[lead]])
        right.append(fp[with_[lead]])
        chain = np.flatnonzero(~lead)
        if len(chain):
            joined = np.unique(np.stack([with_[chain - 1], with_[chain]], 1), axis=0)
            kept = np.array(_forest(list(map(tuple, joined.tolist()))))
            left.append(fp[kept[:, 0]])
            right.append(fp[kept[:, 1]])
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def links(nodes: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """src, dst: fingerprints that link directly; enough of them to join all that link."""
    if not 0 <= distance <= 3:
        raise ValueError("the two covering codes of radius 1 serve distances of 0 to 3")
    spark = nodes.sparkSession
    residents = _anchored(nodes, True)
    hot = materialize(
        residents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("anchor", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
        "anchors",
    )
    small = hot.count() <= BROADCAST_ANCHORS
    side = F.broadcast(hot) if small else hot
    blocks = F.coalesce(F.col("blocks"), F.lit(1))
    home = residents.join(side, "anchor", "left").select(
        "anchor", F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("block"), "fp", F.lit(True).alias("resident")
    )
    away = _anchored(nodes, False).join(side, "anchor", "left").select(
        "anchor", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "fp", F.lit(False).alias("resident")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            anchor, block, resident = batch["anchor"].to_numpy(), batch["block"].to_numpy(), batch["resident"].to_numpy(bool)
            group = np.cumsum(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
            kept = batch[(group == group[-1]) & resident] if len(batch) else None
            src, dst = _compare(group, batch["fp"].to_numpy(np.int64), resident, distance)
            yield pd.DataFrame({"src": src, "dst": dst})

    return (
        home.unionByName(away)
        .repartition("anchor", "block")
        .sortWithinPartitions("anchor", "block", F.col("resident").desc())
        .mapInPandas(run, "src long, dst long")
    )


def components(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """Per document: doc_id, fp, component_id (iterative).

    A null text is an empty one; texts without words have fingerprint zero and link like any other. Rows
    that repeat a doc_id get a row each. A null doc_id is never a component's name unless it is alone. An
    empty table gives no rows; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = connected_components(links(nodes, distance))
    named = nodes.join(found, nodes["fp"] == found["id"]).groupBy("component").agg(F.min("first").alias("smallest"))
    of = found.join(named, "component").select(F.col("id").alias("fp"), "smallest")
    label = materialize(nodes.join(of, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id")), "labels")
    return prints.join(label, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach)."""
    return components(docs, words, distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The documents whose doc_id names their component, with all their columns.

    Rows that repeat a doc_id are one document and stay together; rows with a null doc_id stay.
    """
    gone = components(docs, words, distance).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


def shingle_set(text: str, words: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, one without words has none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.empty(0, np.int64)
    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.unique(np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">i8").astype(np.int64))


def wide_fingerprint(text: str) -> np.ndarray:
    """SLICES numbers of 32 bits; a bit is set if it is set in over half of the hashes of the distinct words."""
    tokens = set(text.encode().lower().split())
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, sorted(tokens), repeat(SEED))), ">u8").astype(np.uint64)
    votes = np.zeros(32 * SLICES, np.int64)
    for at in range(0, len(hashes), 1 << 10):
        streams = mix(hashes[at : at + (1 << 10)] + _STREAMS)
        votes += np.unpackbits(np.ascontiguousarray(streams.T).view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * votes > len(hashes)).view(np.uint32).astype(np.uint64)


def anchors_of(slices: np.ndarray) -> np.ndarray:
    """The one anchor within radius 1 of each slice of wide fingerprints (rows), numbered apart for each slice."""
    home = home_anchor(slices.ravel()).reshape(slices.shape)
    return (home | np.arange(slices.shape[1], dtype=np.uint64) << np.uint64(32)).view(np.int64)


def _node(hashes: np.ndarray) -> int:
    """Names a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed=SEED)).view(np.int64))


def bitmap(hashes: np.ndarray) -> bytes:
    """The bits that the lowest bits of the hashes name, in a power of two of bits; the least is a byte."""
    size = max(8, 1 << (BITS * len(hashes) - 1).bit_length()) if len(hashes) else 8
    bits = np.zeros(size, bool)
    bits[hashes & (size - 1)] = True
    return np.packbits(bits).tobytes()


def most_common(n: int, one: bytes, m: int, two: bytes) -> int:
    """No fewer than the hashes that sets of n and m have in common, from their bitmaps.

    Each of them sets one bit in both; a set has as many hashes more than bits as others hide.
    """
    a, b = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(x.reshape(-1, size)) for x in (a, b))
    shared, here, there = (int(np.bitwise_count(x).sum()) for x in (a & b, a, b))
    return shared + min(n - here, m - there)


def sketches(docs: DataFrame, words: int = SIMILAR_WORDS) -> DataFrame:
    """doc_id, node (names the set of shingles), n (its size), wide (the fingerprint), bits (the bitmap) of every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + BATCH] for b in batches for at in range(0, len(b), BATCH)):
            sets = [shingle_set(t, words) for t in batch["text"]]
            wide = [wide_fingerprint(t).astype(np.uint32).tobytes() for t in batch["text"]]
            columns = {"doc_id": batch["doc_id"].astype("Int64"), "node": [_node(s) for s in sets], "n": [len(s) for s in sets], "wide": wide}
            yield pd.DataFrame(columns | {"bits": [bitmap(s) for s in sets]}, index=batch.index)

    return documents(docs).mapInPandas(run, "doc_id long, node long, n long, wide binary, bits binary")


def _anchored_nodes(nodes: DataFrame) -> DataFrame:
    """anchor, node, n: a row for each slice of every node that has shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + BATCH] for b in batches for at in range(0, len(b), BATCH)):
            slices = np.frombuffer(b"".join(batch["wide"]), np.uint32).reshape(-1, SLICES).astype(np.uint64)
            repeated = batch[["node", "n"]].loc[batch.index.repeat(SLICES)].reset_index(drop=True)
            yield repeated.assign(anchor=anchors_of(slices).ravel())[["anchor", "node", "n"]]

    return nodes.where("n > 0").select("node", "n", "wide").mapInPandas(run, "anchor long, node long, n long")


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _sets(docs: DataFrame, rows: DataFrame, named: DataFrame, words: int) -> DataFrame:
    """node, hashes: the sets of the named nodes, made again from one text each."""
    named = _few(materialize(named.distinct(), "named"))
    ids = materialize(rows.join(named, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
    texts = documents(docs)
    used = texts.join(_few(ids), "doc_id", "left_semi").unionByName(texts.where("doc_id is null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[at : at + BATCH] for b in batches for at in range(0, len(b), BATCH)):
            sets = [shingle_set(t, words) for t in batch["text"]]
            yield pd.DataFrame({"node": [_node(s) for s in sets], "hashes": sets})

    return materialize(used.mapInPandas(run, "node long, hashes array<long>").join(named, "node", "left_semi").dropDuplicates(["node"]), "sets")


def _possible(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """src, dst: the pairs whose bitmaps leave it open that they are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
            common = np.fromiter(map(most_common, n, batch["a"], m, batch["b"]), np.int64, len(batch))
            yield batch[common >= similar * (n + m - common) - 1e-9][["src", "dst"]]

    left = nodes.select(F.col("node").alias("src"), "n", F.col("bits").alias("a"))
    right = nodes.select(F.col("node").alias("dst"), F.col("n").alias("m"), F.col("bits").alias("b"))
    met = pairs.join(left, "src").join(right, "dst").where(_near(F.col("n"), F.col("m"), similar))
    return materialize(met.select("src", "dst", "n", "m", "a", "b").mapInPandas(run, "src long, dst long"), "possible")


def _similar(pairs: DataFrame, docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, similar: float) -> DataFrame:
    """src, dst: the pairs whose sets are similar enough, exactly."""
    pairs = _possible(pairs, nodes, similar)
    sets = _sets(docs, rows, pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))), words)
    left = sets.select(F.col("node").alias("src"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("dst"), F.col("hashes").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    enough = common >= F.lit(similar) * (F.size("a") + F.size("b") - common) - 1e-9
    return materialize(pairs.join(left, "src").join(right, "dst").where(enough).select("src", "dst"), "links")


def _parts(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with `part`, the component of the links so far, where an anchor holds more than one; least, parts of the anchor."""
    joined = connected_components(links).withColumnRenamed("id", "node")
    parted = materialize(members.join(joined, "node", "left").select("anchor", "node", "n", F.coalesce("component", "node").alias("part")), "parts")
    open_ = parted.groupBy("anchor").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(F.struct("node", "n", "part")).alias("least"), F.count(F.lit(1)).alias("members"))
    return materialize(parted.join(open_.where("low <> high").select("anchor", "least", "members"), "anchor"), "open")


def _near(a: Column, b: Column, similar: float) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similar) - 1e-9


def _pairs_by_anchor(few: DataFrame, similar: float) -> DataFrame:
    """src, dst: all pairs of nodes of different parts at anchors with few members."""
    one = few.select("anchor", "part", F.col("node").alias("src"), "n")
    two = few.select("anchor", F.col("part").alias("with"), F.col("node").alias("dst"), F.col("n").alias("m"))
    return one.join(two, "anchor").where((F.col("src") < F.col("dst")) & (F.col("part") != F.col("with")) & _near(F.col("n"), F.col("m"), similar)).select("src", "dst")


def _prefixes(many: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """shingle, node, n, at: the rarest shingles of the nodes at anchors where very many meet.

    Texts with a common passage may all meet at an anchor. If their shingles are put in order of frequency, the
    rarest first, similar sets share one among the first (1 - similar) of each, and from the places of the first
    one they share follows how many they can share at most. So the passage itself makes no pairs.
    """
    nodes = materialize(many.select("node", "n").distinct(), "crowded")
    every = sets.join(nodes, "node").select("node", "n", F.explode("hashes").alias("shingle"))
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    ranked = every.join(often, "shingle", "left").withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("often", F.lit(1)), "shingle")) - 1)
    return materialize(ranked.where((F.col("often") > 1) & (F.col("at") <= F.col("n") * (1 - similar) + 1e-9)).select("shingle", "node", "n", "at"), "prefixes")


def _in_parts(prefixes: DataFrame, links: DataFrame) -> DataFrame:
    """prefixes with `part`, the component of the links so far."""
    joined = connected_components(links).withColumnRenamed("id", "node")
    return materialize(prefixes.join(joined, "node", "left").select("shingle", "node", "n", "at", F.coalesce("component", "node").alias("part")), "parts")


def _enough(similar: float) -> Column:
    """Whether node and dst, of different parts, can be similar; true if the shingle is the first that two similar ones share."""
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place"))
    return (F.col("part") != F.col("with")) & _near(F.col("n"), F.col("m"), similar) & (most >= (F.col("n") + F.col("m")) * F.lit(similar / (1 + similar)) - 1e-9)


def _pairs_by_hub(prefixes: DataFrame, similar: float) -> DataFrame:
    """src, dst: for each shingle, its nodes with the one that has the fewest rarer shingles.

    In a group of near copies that one has the fewest words of its own, so most are similar to it if to any.
    """
    hubs = prefixes.groupBy("shingle").agg(F.min(F.struct("at", "node", "n", "part")).alias("hub"))
    other = materialize(hubs.selectExpr("shingle", "hub.node AS dst", "hub.n AS m", "hub.part AS with", "hub.at AS place"), "hubs")
    return prefixes.join(other, "shingle").where(_enough(similar)).select(F.least("node", "dst").alias("src"), F.greatest("node", "dst").alias("dst"))


def _pairs_by_prefix(prefixes: DataFrame, similar: float) -> DataFrame:
    """src, dst: all pairs of nodes of different parts that can be similar."""
    other = prefixes.select("shingle", F.col("node").alias("dst"), F.col("n").alias("m"), F.col("part").alias("with"), F.col("at").alias("place"))
    return prefixes.join(other, "shingle").where((F.col("node") < F.col("dst")) & _enough(similar)).select(F.col("node").alias("src"), "dst")


def _new(pairs: DataFrame, *tested: DataFrame) -> DataFrame:
    """src, dst: the distinct pairs that have not been compared; src is the smaller in all of them."""
    pairs = pairs.distinct()
    for known in tested:
        pairs = pairs.join(known, ["src", "dst"], "left_anti")
    return materialize(pairs, "pairs")


def similar_components(docs: DataFrame, words: int = SIMILAR_WORDS, similar: float = SIMILAR) -> DataFrame:
    """Per document: doc_id, component_id (smallest doc_id that links of similar texts reach; iterative).

    First each text is compared with one smaller text that it meets, then at each anchor whose texts are not
    joined by that with the smallest text there. Where very many meet, those that can be similar by their rarest
    shingles are then compared with one text for each such shingle. Last, the pairs of each anchor that are in
    different components still are compared, all of them; where very many meet, all that can be similar by their
    rarest shingles. No pair is compared twice.

    A null text is an empty one, and texts without words are copies of each other. Rows that repeat a doc_id
    get a row each. A null doc_id is never a component's name unless it is alone. An empty table gives no
    rows; other columns are ignored.
    """
    with temporary_tables(docs.sparkSession) as keep:
        rows = materialize(sketches(docs, words), "sketches")
        nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("bits").alias("bits")), "nodes")
        at = materialize(_anchored_nodes(nodes), "anchors")
        shared = materialize(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("anchor"), "shared")
        met = materialize(at.join(_few(shared), "anchor"), "met")
        members = materialize(met.join(met.groupBy("anchor").agg(F.min(F.struct("node", "n")).alias("least")), "anchor"), "members")
        known = docs, rows, nodes, words, similar
        stars = members.where("node <> least.node").where(_near(F.col("n"), F.col("least.n"), similar)).groupBy("node").agg(F.min("least.node").alias("src"))
        one = _new(stars.select("src", F.col("node").alias("dst")))
        links = _similar(one, *known)
        left = _parts(met, links)
        stars = left.where("part <> least.part").where(_near(F.col("n"), F.col("least.n"), similar)).select(F.col("least.node").alias("src"), F.col("node").alias("dst"))
        two = _new(stars, one)
        links = links.unionByName(_similar(two, *known))
        left = _parts(left.select("anchor", "node", "n"), links)
        few, many = left.where(F.col("members") <= FEW), left.where(F.col("members") > FEW)
        crowded = _prefixes(many, _sets(docs, rows, many.select("node"), words), similar)
        three = _new(_pairs_by_hub(_in_parts(crowded, links), similar), one, two)
        links = links.unionByName(_similar(three, *known))
        rest = _pairs_by_anchor(few, similar).unionByName(_pairs_by_prefix(_in_parts(crowded, links), similar))
        found = connected_components(links.unionByName(_similar(_new(rest, one, two, three), *known)))
        named = nodes.join(found, nodes["node"] == found["id"]).groupBy("component").agg(F.min("first").alias("smallest"))
        of = found.join(named, "component").select(F.col("id").alias("node"), "smallest")
        label = materialize(nodes.join(of, "node", "left").select("node", F.coalesce("smallest", "first").alias("component_id")), "labels")
        return keep(materialize(rows.select("doc_id", "node").join(label, "node").select("doc_id", "component_id"), "components"))


def keep_one_similar(docs: DataFrame, words: int = SIMILAR_WORDS, similar: float = SIMILAR) -> DataFrame:
    """The documents whose doc_id names their component of similar texts, with all their columns.

    Rows that repeat a doc_id are one document and stay together; rows with a null doc_id stay.
    """
    gone = similar_components(docs, words, similar).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
