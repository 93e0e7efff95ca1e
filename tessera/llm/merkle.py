"""Merkle manifest of a dataset: a root for each source, one for the whole, and a proof for every row.

Nodes of a tree are cut into aligned blocks of 16 x 16. A block keeps each of its levels as one hex string,
64 characters a digest: fixed-width substrings of it hash to the parents, and what flanks a digest in its run
of 16 is a segment of the proof. The blocks' tops are the nodes of the next, 256 times smaller tree, until a
source has one node; the sources' roots are then a tree of their own. Proofs are put together on the way
down, where every block gets the path of its top.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import materialize

RUN, HEX = 16, 64
BLOCK = RUN * RUN
#: monotonically_increasing_id() holds the partition above this bit and the place in it below.
PLACE_BITS = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf(values: Sequence[Column]) -> Column:
    """SHA-256 of the values, each as its byte count, a colon and its text, or a dash for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def folded(node: Column, proof: Column) -> Column:
    """The root that a leaf and the segments of its proof give."""
    return F.aggregate(proof, node, lambda now, side: F.sha2(F.concat(side["left"], now, side["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def _numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Leaves with their tree and place in it; the trees; how many trees there are and the largest one's leaves.

    Rows are sorted by range over all partitions and written with their place in that order. Places within a
    source follow from the counts of each (partition, source), so no source is ever in one task; only one count a
    partition comes to the driver.
    """
    ordered = materialize(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(F.col("_source").asc_nulls_first(), F.col("_key").asc_nulls_first(), F.col("_leaf"), F.col("_tie"))
        .sortWithinPartitions(F.col("_source").asc_nulls_first(), F.col("_key").asc_nulls_first(), F.col("_leaf"), F.col("_tie"))
        .select("_source", "_leaf", "_row", F.monotonically_increasing_id().alias("_at")),
        "merkle-order",
    )
    part = F.shiftright("_at", PLACE_BITS)
    spans = materialize(ordered.groupBy(part.alias("_part"), "_source").agg(F.count(F.lit(1)).alias("_here"), F.min("_at").alias("_low")), "merkle-spans")
    heads = spans.groupBy("_source").agg(F.sum("_here").alias("_n"), F.min("_low").alias("_first")).withColumn("_home", F.shiftright("_first", PLACE_BITS))
    counts = heads.groupBy("_home").agg(F.count(F.lit(1)).alias("c"), F.max("_n").alias("n")).orderBy("_home").collect()
    starts, trees = [], 0
    for r in counts:
        starts.append((r["_home"], trees))
        trees += r["c"]
    starts = rows.sparkSession.createDataFrame(starts, "_home long, _start long")
    tree = F.col("_start") + F.row_number().over(Window.partitionBy("_home").orderBy("_first")) - 1
    heads = heads.join(starts, "_home").select(F.col("_source").alias("_name"), tree.alias("_tree"), "_n")
    before = F.coalesce(F.sum("_here").over(Window.partitionBy("_tree").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spans.join(heads, F.col("_source").eqNullSafe(F.col("_name"))).select("_part", "_name", "_tree", "_n", (before - F.col("_low")).alias("_shift"))
    nodes = ordered.join(placed, (part == F.col("_part")) & F.col("_source").eqNullSafe(F.col("_name")))
    return nodes.select("_tree", "_n", (F.col("_at") + F.col("_shift")).alias("_at"), F.col("_leaf").alias("_node"), "_row"), heads, trees, max((r["n"] for r in counts), default=0)


def _blocks(nodes: DataFrame) -> DataFrame:
    """Aligned blocks of the nodes (_tree, _n, _at, _node, _row): their levels as hex strings, their top, their rows."""
    inside = F.sort_array(F.collect_list(F.struct("_at", "_node", "_row")))
    whole = nodes.groupBy("_tree", F.floor(F.col("_at") / BLOCK).alias("_block")).agg(F.first("_n").alias("_n"), inside.alias("_in"))
    level0 = whole.select("_tree", "_block", "_n", F.array_join("_in._node", "").alias("_level0"), F.col("_in._row").alias("_rows"))
    runs = F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / RUN).cast("int"))
    parents = F.transform(runs, lambda r: F.sha2(F.substring(F.col("_level0"), r * (RUN * HEX) + 1, F.lit(RUN * HEX)), 256))
    level1 = level0.withColumn("_level1", F.when(F.col("_n") > 1, F.array_join(parents, "")))
    top = F.when(F.col("_n") == 1, F.col("_level0")).when(F.col("_n") <= RUN, F.col("_level1")).otherwise(F.sha2("_level1", 256))
    return level1.withColumn("_top", top)


def _grow(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks from the nodes up, and (_tree, _node), the root of every tree."""
    levels = []
    while True:
        levels.append(materialize(_blocks(nodes), "merkle-blocks"))
        largest = -(-largest // BLOCK)
        tops = levels[-1].select("_tree", F.ceil(F.col("_n") / BLOCK).alias("_n"), F.col("_block").alias("_at"), F.col("_top").alias("_node"), F.lit(None).cast("string").alias("_row"))
        if largest <= 1:
            return levels, tops.select("_tree", "_node")
        nodes = tops


def _paths(blocks: DataFrame) -> Column:
    """(_at, _node, _path, _row) of all nodes of a block with _path, the path of its top."""

    def of_run(run: Column, r: Column) -> Column:
        above = F.struct(F.substring(F.col("_level1"), F.lit(1), r * HEX).alias("left"), F.substring(F.col("_level1"), (r + 1) * HEX + 1, F.lit(RUN * HEX)).alias("right"))

        def of_node(i: Column) -> Column:
            beside = F.struct(F.substring(run, F.lit(1), i * HEX).alias("left"), F.substring(run, (i + 1) * HEX + 1, F.lit(RUN * HEX)).alias("right"))
            own = F.when(F.col("_n") == 1, F.array().cast(PATH)).when(F.col("_n") <= RUN, F.array(beside)).otherwise(F.array(beside, above))
            at = r * RUN + i
            return F.struct(
                (F.col("_block") * BLOCK + at).alias("_at"), F.substring(run, i * HEX + 1, F.lit(HEX)).alias("_node"), F.concat(own, F.col("_path")).alias("_path"),
                F.get(F.col("_rows"), at).alias("_row"),
            )

        return F.transform(F.sequence(F.lit(0), F.floor(F.length(run) / HEX).cast("int") - 1), of_node)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_rows") - 1) / RUN).cast("int")), lambda r: F.substring(F.col("_level0"), r * (RUN * HEX) + 1, F.lit(RUN * HEX)))
    return F.flatten(F.transform(runs, of_run))


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """_tree, _root, _node, _path, _row of all lowest nodes, given (_tree, _at, _path, _root) above the highest blocks."""
    for k, blocks in reversed(list(enumerate(levels))):
        joined = blocks.join(tops.withColumnRenamed("_at", "_block"), ["_tree", "_block"])
        down = joined.select("_tree", "_root", F.inline(_paths(joined)))
        tops = down if k == 0 else down.select("_tree", "_root", "_at", "_path")
    return tops


def manifest(rows: DataFrame) -> DataFrame:
    """rows with proof, subroot and root, from rows that have doc_id, source and leaf.

    Per source, leaves ascend by doc_id (null first; equal ones by leaf, and repeated rows are leaves of their
    own); the sources' roots, ordered by source (null first, bytewise), are the leaves of the last tree.
    proof: for each level from the leaf to the root what is left and what is right of the node in its run, as one
    hex string each. All other columns are carried along. No rows give no rows.
    """
    taken = {"proof", "subroot", "root"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    stored = rows.select(F.col("source").alias("_source"), F.col("doc_id").alias("_key"), F.col("leaf").alias("_leaf"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"))
    nodes, _, trees, largest = _numbered(materialize(stored, "merkle-leaves"))
    levels, subroots = _grow(nodes, largest)
    subroots = materialize(subroots, "merkle-subroots")
    whole = subroots.select(F.lit(0).cast("long").alias("_tree"), F.lit(trees).cast("long").alias("_n"), F.col("_tree").alias("_at"), "_node", F.lit(None).cast("string").alias("_row"))
    upper, roots = _grow(whole, trees)
    top = roots.select("_tree", F.lit(0).cast("long").alias("_at"), F.array().cast(PATH).alias("_path"), F.col("_node").alias("_root"))
    sources = _descend(upper, top).select(F.col("_at").alias("_tree"), "_path", F.struct(F.col("_node").alias("subroot"), F.col("_root").alias("root")).alias("_root"))
    found = _descend(levels, sources.withColumn("_at", F.lit(0).cast("long")))
    return found.select("_row.*", F.col("_path").alias("proof"), "_root.*")


def leaves(docs: DataFrame, text: Column | None = None) -> Column:
    """The leaf of a row of documents, or what it would be with another text."""
    return leaf([docs[c] if c != "text" or text is None else text for c in FIELDS])
