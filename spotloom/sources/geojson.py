"""GeoJSON documents read piece by piece, so no task holds a document.

A document is cut after each closing brace, wherever that is, by Spark's splittable text reader (an archive's member is
inflated as a stream instead). What a piece means depends on all before it: whether it starts inside a string, and how
many braces are open. Both are prefix sums, over blocks of pieces first and then within them. A feature begins at the
brace that opens the second level, and its pieces are joined and parsed. Spark's JSON functions do the parsing.
"""

from __future__ import annotations

import codecs
import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spotloom.functions import polygons
from spotloom.session import stage

#: Bytes inflated at a time, and pieces of a block.
CHUNK, BLOCK = 1 << 20, 1 << 14
_PIECES = "file string, block bigint, seq bigint, value string"
_ESCAPED, _STRING = r"\\.", r'"[^"]*"'
#: Text without an open brace, strings as they come.
_BEFORE = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
_FEATURE = "type string, properties struct<cell_id:string,class:string>, geometry struct<type:string,coordinates:string>"


def text_pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq and value of each piece; every piece but the last of a file ended in a brace."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def zip_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The same for the first ``.geojson`` member of each archive, one task an archive."""
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("value", pa.string())])

    def run(batches):
        for batch in batches:
            for name, blob in zip(batch.column("path"), batch.column("content")):
                with zipfile.ZipFile(io.BytesIO(blob.as_buffer())) as archive:
                    member = next((m for m in archive.namelist() if m.endswith(".geojson")), None)
                    if member is None:
                        raise FileNotFoundError("no .geojson member in the archive")
                    decoder, rest, seq = codecs.getincrementaldecoder("utf-8-sig")(), "", 0
                    with archive.open(member) as source:
                        while rest is not None:
                            data = source.read(CHUNK)
                            *whole, rest = (rest + decoder.decode(data, not data)).split("}")
                            if not data:
                                whole, rest = [*whole, rest], None
                            numbers = range(seq, seq + len(whole))
                            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(whole), pa.string()), pa.array([n // BLOCK for n in numbers], pa.int64()), pa.array(numbers, pa.int64()), pa.array(whole, pa.string())], schema=schema)
                            seq += len(whole)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _PIECES)


def _before(pieces: DataFrame, amount: str, name: str) -> DataFrame:
    """``pieces`` with the sum of ``amount`` over all earlier pieces of the file."""
    blocks = pieces.groupBy("file", "block").agg(F.sum(amount).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_blocks"))
    inner = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("_inner", F.coalesce(F.sum(amount).over(inner), F.lit(0))).join(blocks, ["file", "block"]).withColumn(name, F.col("_blocks") + F.col("_inner")).drop("_blocks", "_inner")


def _count(text: Column, character: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(character), F.lit("")))


def features(pieces: DataFrame) -> DataFrame:
    """pos (number in its document), cell_id, class and vertices (signed rings) of each feature.

    A null geometry gives null vertices; a geometry that is no polygon is an error.
    """
    plain = F.regexp_replace("value", _ESCAPED, "")
    # Braces outside strings if the piece starts outside a string, and if it starts inside one.
    braces = lambda text: _count(F.regexp_replace(F.regexp_replace(text, _STRING, ""), '"[^"]*$', ""), "{").cast("long")
    texts = stage(pieces.withColumns({"quotes": _count(plain, '"').cast("long"), "plain": braces(plain), "quoted": braces(F.concat(F.lit('"'), plain))}))
    # The sums need no text.
    rows = _before(texts.drop("value"), "quotes", "_q")
    opened, ended = F.col("_q") % 2 == 1, (F.col("_q") + F.col("quotes")) % 2 == 1
    rows = rows.select("file", "block", "seq", opened.alias("opened"), F.when(opened, F.col("quoted")).otherwise(F.col("plain")).alias("opens"), F.when(ended, 0).otherwise(1).alias("closes"))
    rows = _before(stage(rows.withColumn("delta", F.col("opens") - F.col("closes"))), "delta", "depth")
    begins = (F.col("depth") <= 1) & (F.col("depth") + F.col("opens") >= 2)
    rows = _before(stage(rows.withColumn("begins", begins.cast("long"))), "begins", "_n")
    inside = rows.where((F.col("depth") >= 2) | (F.col("begins") == 1)).withColumn("pos", F.col("_n") + F.col("begins") - 1)
    # Both sides hold a row a piece; the staged files are small for what is in them, so their size would call for a broadcast.
    inside = texts.select("file", "block", "seq", "value").join(inside.hint("merge"), ["file", "block", "seq"])
    # A feature's first piece counts from the brace that opens the second level; a string left open before goes first.
    bare = F.when(F.col("opened"), F.regexp_replace("value", r'^(?:[^"\\]++|\\.)*+"', "")).otherwise(F.col("value"))
    first = F.when(F.col("depth") == 1, F.regexp_extract(bare, rf"(?s)^{_BEFORE}(\{{.*)$", 1)).otherwise(F.regexp_extract(bare, rf"(?s)^{_BEFORE}\{{{_BEFORE}(\{{.*)$", 1))
    cut = inside.select("file", "pos", "block", "seq", F.when(F.col("begins") == 1, first).otherwise(F.col("value")).alias("value"))
    joined = cut.groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("parts"))
    whole = joined.select("file", "pos", F.from_json(F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.lit("}")), _FEATURE).alias("f"))
    # Other objects of the document (a reference system, say) are no features; numbers stay without gaps.
    found = whole.where((F.col("f.type") == "Feature") | F.col("f.geometry").isNotNull())
    skipped = whole.where(~F.coalesce((F.col("f.type") == "Feature") | F.col("f.geometry").isNotNull(), F.lit(False)))
    others = skipped.groupBy("file").agg(F.sort_array(F.collect_list("pos")).alias("_others"))  # a handful a document
    found = found.join(others, "file", "left").withColumn("pos", F.col("pos") - F.coalesce(F.size(F.filter("_others", lambda o: o < F.col("pos"))), F.lit(0)))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.from_json(coordinates, "array<array<array<double>>>")
    parts = F.when(kind == "MultiPolygon", F.from_json(coordinates, "array<array<array<array<double>>>>")).when(kind == "Polygon", F.array(one))
    checked = F.when(F.col("f.geometry").isNull() | kind.isin("Polygon", "MultiPolygon"), parts).otherwise(F.raise_error(F.concat(F.lit("an outline is a "), F.coalesce(kind, F.lit("geometry without type")))))
    points = F.transform(checked, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))))
    return found.select(F.col("pos").cast("long").alias("pos"), F.col("f.properties.cell_id").alias("cell_id"), F.col("f.properties.class").alias("class"), polygons.oriented(points).alias("vertices"))
