"""Files as tables: inventories, digests, images, manifests; JSON and Parquet sinks; new files as a stream."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FILE = "path string, modificationTime timestamp, length long, content binary"


def _glob(extensions: list[str]) -> str:
    """A glob for the extensions in either case."""
    folded = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    return "*.{" + ",".join(folded) + "}"


def scan_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, length, modificationTime of all files below root with one of the extensions; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).load(root)
    return files.select("path", "length", "modificationTime")


#: Files of more bytes are hashed in pieces of about so many; the ends of names that Hadoop's readers would unpack.
WHOLE_BYTES, PIECE_BYTES = 64 << 20, 16 << 10
_PACKED = r"(?i)[.](gz|bz2|zst|lz4|snappy|deflate)$"
_BOM = b"\xef\xbb\xbf"


def _digests_in_pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """_file, sha256 of large files: tasks read their splits by lines, which are joined to pieces; a file's pieces are hashed in order.

    SHA-256 is one sequence, so a file's pieces meet in one task, which holds a batch of them. The line break that follows every line
    is cut off behind the file's length; Hadoop leaves out a byte order mark, so both digests are kept until the length tells.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, held, size = None, 0, [], 0
        for batch in batches:
            rows = zip(*(batch[c].to_pylist() for c in ("_file", "length", "start", "line")), strict=True)
            out = []
            for file, length, start, line in rows:
                if at != (file, length, start) or size >= PIECE_BYTES:
                    if held:
                        out.append((*at, number, b"".join(held)))
                    number, held, size = number + 1 if at == (file, length, start) else 0, [], 0
                    at = file, length, start
                held += (line, b"\n")
                size += len(line) + 1
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], kinds)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*at, number, b"".join(held)), strict=True))], kinds)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, seen, plain, marked = None, 0, 0, None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"_file": at, "sha256": (marked if seen < size - 1 else plain).hexdigest()}])

        for batch in batches:
            for file, length, piece in zip(*(batch[c].to_pylist() for c in ("_file", "length", "piece")), strict=True):
                if file != at:
                    if at is not None:
                        yield told()
                    at, size, seen, plain, marked = file, length, 0, sha256(), sha256(_BOM)
                plain.update(piece[: max(0, size - seen)])
                marked.update(piece[: max(0, size - len(_BOM) - seen)])
                seen += len(piece)
        if at is not None:
            yield told()

    names = ["_file", "length", "start", "number", "piece"]
    kinds = pa.schema([("_file", pa.string()), ("length", pa.int64()), ("start", pa.int64()), ("number", pa.int64()), ("piece", pa.binary())])
    lines = spark.read.option("lineSep", "\n").text(paths)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(join, "_file string, length long, start long, number long, piece binary")
    return pieces.repartition("_file").sortWithinPartitions("_file", "start", "number").select("_file", "length", "piece").mapInArrow(fold, "_file string, sha256 string")


def content_digests(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, length, sha256 of each file; only a large file whose name says that it is packed must fit in a task's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).load(root)
    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length", F.col("_metadata.file_path").alias("_file"))
    found = [(_escaped(r["path"]), bool(re.search(_PACKED, r["path"]))) for r in large.select("path").collect()]  # one for each WHOLE_BYTES of input at most
    packed, plain = ([p for p, is_packed in found if is_packed == kind] for kind in (True, False))
    whole = lambda rows: rows.select("path", "length", F.sha2("content", 256).alias("sha256"))
    digests = whole(files.where(F.col("length") <= WHOLE_BYTES))
    if packed:
        digests = digests.unionByName(whole(spark.read.format("binaryFile").load(packed)))
    if plain:
        digests = digests.unionByName(large.join(_digests_in_pieces(spark, plain), "_file").select("path", "length", "sha256"))
    return digests


def _escaped(path: str) -> str:
    """A path that a reader takes as it is, not as a pattern."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    """path, width, height, channels, data of the images below root; unreadable ones are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def stream_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """New files below root as a stream of path, length, modificationTime."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", True).option("pathGlobFilter", _glob(extensions)).load(root)
    return files.select("path", "length", "modificationTime")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs joined with their assets, violations) of JSON documents {assets: [{id, path}], pairs: [{id, preferred, rejected, query}]}.

    Violations, with pair_id: same_item, missing_asset, duplicate_pair. A pair with one is not returned.
    """
    schema = "assets array<struct<id string, path string>>, pairs array<struct<id string, preferred string, rejected string, query string>>"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    assets = read.select(F.explode("assets").alias("a")).select("a.id", "a.path").dropDuplicates(["id"])
    pairs = read.select(F.explode("pairs").alias("p")).select("p.*").withColumnRenamed("id", "pair_id")
    side = lambda key: assets.select(F.col("id").alias(key), F.col("path").alias(f"{key}_path"))
    joined = pairs.join(side("preferred"), "preferred", "left").join(side("rejected"), "rejected", "left")
    often = pairs.groupBy(F.col("pair_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    reason = F.when(F.col("_n") > 1, "duplicate_pair").when(F.col("preferred") == F.col("rejected"), "same_item").when(F.col("preferred_path").isNull() | F.col("rejected_path").isNull(), "missing_asset")
    judged = joined.join(often, F.col("pair_id").eqNullSafe(F.col("_id"))).drop("_id").withColumn("violation", reason)
    return judged.where("violation is null").drop("violation", "_n"), judged.where("violation is not null").select("pair_id", "violation")


def write_results(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Write the rows as a folder of JSON lines or Parquet; an existing folder is an error."""
    rows.write.format(kind).mode("errorifexists").save(path)
