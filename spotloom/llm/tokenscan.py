"""Token counts of the documents in flat, unindexed token files (operator 5).

A token file is nothing but fixed-width ids, each document closed by an end-of-document id. Files are read in blocks of
``BLOCK`` bytes by as many tasks as there are blocks; a block's end-of-document ids are found by one vectorised
comparison. A document that crosses blocks gets its length from the last end before its block: a prefix scan (running
maximum of the ends, running sum of their number) within groups of blocks, then over the groups of a file.

Edge cases: an empty file has no document; two ends in a row are an empty document; ids after the last end are a
document with ``complete`` false; bytes after the last whole id are an error, as the file is then no token file. A null
or empty text is written as an empty document. Repeated rows are documents of their own. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spotloom.llm.bpe import codec
from spotloom.llm.common import map_slices, text_list
from spotloom.session import stage

#: Bytes of a block (a multiple of any id width) and blocks of a group of the scan.
BLOCK, GROUP = 1 << 20, 4096
END = 0


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, split_by: tuple[str, ...] = (), order_by: str | None = None) -> None:
    """Encodes each text as 16-bit little-endian ids plus one, followed by the end id 0, in the order of the rows.

    The rows' bytes go through Spark's text sink as they are; its line separator is the end id. With ``split_by``, rows that
    differ in these columns are in different folders (column=value), each in the order of ``order_by``.
    """
    kept = [*split_by, *([order_by] if order_by else [])]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = codec(path, pattern)
        if len(coder.lengths) > 0xFFFF:
            raise ValueError("the vocabulary does not fit 16 bits")
        ids = [(np.frombuffer(coder.encode(t), dtype="<u4") + 1).astype("<u2").tobytes() for t in text_list(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), *batch.columns[1:]], names=["ids", *kept])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    encoded = map_slices(docs.select("text", *kept), run, f"ids binary{kinds}")
    if kept:
        encoded = encoded.sortWithinPartitions(*kept)
    rows = encoded.select(F.col("ids").cast("string").alias("value"), *split_by)
    rows.write.partitionBy(*split_by).option("lineSep", "\0\0").option("compression", "none").text(folder)


def with_place(docs: DataFrame) -> DataFrame:
    """Rows of a file source with the file (as a hash), the block of it that their task reads, and their number in the file.

    The number does not depend on how a scan is cut into tasks; the block does.
    """
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("file_hash"), F.col("_metadata.file_block_start").alias("file_block"), F.col("_metadata.row_index").alias("file_row"))


def in_file(counts: DataFrame) -> DataFrame:
    """Token counts of files that were split by file_hash and file_block, with file_hash and file_row of each document.

    The blocks of a file follow each other, so a document's number in the file is its number in the block and those of
    the blocks before.
    """
    part = lambda c: F.regexp_extract("file", rf"/{c}=(-?[0-9]+)/", 1).cast("long").alias(c)
    sizes = counts.groupBy("file").agg(F.count("*").alias("n")).select("file", part("file_hash"), part("file_block"), "n")
    before = Window.partitionBy("file_hash").orderBy("file_block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("file", "file_hash", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return counts.join(firsts, "file").select("file_hash", (F.col("first") + F.col("doc_no")).alias("file_row"), "n_tokens", "complete")


def ends_of(data: bytes, first: int, end: int, width: str) -> np.ndarray:
    """Positions of the end id in a block whose first id is number ``first`` of its file."""
    return np.flatnonzero(np.frombuffer(data, dtype=width) == end) + first


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def count_tokens(spark: SparkSession, folder: str, end: int = END, width: str = "<u2", block: int = BLOCK) -> DataFrame:
    """file, doc_no (from 0 within the file), n_tokens and complete of each document in the files of ``folder``."""
    size = np.dtype(width).itemsize
    if block % size:
        raise ValueError("a block must hold whole ids")

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = [], []
        for file, length, number in zip(*(c.to_pylist() for c in batch.columns)):
            if length % size:
                raise ValueError(f"{file} is no token file: {length} bytes")
            with _open(file) as source:
                source.seek(number * block)
                data = source.read(min(block, length - number * block))
            found.append(ends_of(data, number * block // size, end, width))
            counts.append(len(data) // size)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["file", "block", "ends", "ids"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.expr(f"sequence(0, (length - 1) div {block})")).alias("block"))
    blocks = blocks.repartition("path", "block")
    read = stage(map_slices(blocks, scan, "file string, block bigint, ends array<bigint>, ids bigint", rows=16))

    facts = read.select("file", "block", F.floor(F.col("block") / GROUP).alias("part"), F.array_max("ends").alias("last"), F.size("ends").cast("long").alias("n"), "ids")
    inner = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = facts.groupBy("file", "part").agg(F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    carried = parts.select("file", "part", F.max("last").over(outer).alias("last0"), F.sum("n").over(outer).alias("n0"))
    scanned = facts.select("file", "block", "part", F.max("last").over(inner).alias("last1"), F.sum("n").over(inner).alias("n1")).join(carried, ["file", "part"])
    start = scanned.select("file", "block", F.coalesce("last1", "last0", F.lit(-1)).alias("prior"), (F.coalesce("n1", F.lit(0)) + F.coalesce("n0", F.lit(0))).alias("first_no"))

    closed = read.where(F.size("ends") > 0).join(start, ["file", "block"])
    lengths = F.zip_with("ends", F.concat(F.array("prior"), F.col("ends")), lambda e, p: e - p - 1)
    closed = closed.select("file", "first_no", F.posexplode(F.slice(lengths, 1, F.size("ends"))).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("first_no") + F.col("k")).alias("doc_no"), "n_tokens", F.lit(True).alias("complete"))
    whole = parts.groupBy("file").agg(F.max("last").alias("last"), F.sum("n").alias("doc_no"), F.sum("ids").alias("ids"))
    tail = whole.select("file", "doc_no", (F.col("ids") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return closed.unionByName(tail)
