"""Columnar and geometry sources."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spotloom.functions import polygons
from spotloom.functions.scalars import decode_name
from spotloom.operators import filters, gap, panels
from spotloom.sources import geojson

def read_transcripts(spark: SparkSession, path: str, nucleus_only: bool = False) -> DataFrame:
    """Per-molecule rows; only the needed columns are scanned and feature names are text."""
    columns = ["cell_id", "feature_name"] + (["overlaps_nucleus"] if nucleus_only else [])
    df = spark.read.parquet(path).select(*columns)
    if df.schema["feature_name"].dataType.typeName() == "binary":
        df = df.withColumn("feature_name", decode_name("feature_name"))
    return df


def _numbers(data: np.ndarray, at: np.ndarray, little: np.ndarray, kind: str) -> np.ndarray:
    """Numbers of type ``kind`` (u4 or f8) at byte offsets ``at``, each in its own byte order."""
    width = np.dtype(kind).itemsize
    raw = np.ascontiguousarray(data[at[:, None] + np.arange(width)])
    return np.where(little, raw.view(f"<{kind}")[:, 0], raw.view(f">{kind}")[:, 0])


def decode_outlines(blobs: pa.Array) -> pa.Array:
    """Signed rings of WKB polygons and multipolygons, by offset arithmetic over the whole column.

    One step reads the header of one part or ring of every row that has another, so the number of steps is that of the
    row with the most. The first ring of a part is made to run counter-clockwise, its holes clockwise.
    """
    blobs = blobs.cast(pa.large_binary())
    kind = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
    valid = np.asarray(blobs.is_valid())
    rows = np.flatnonzero(valid)
    if not len(rows):
        return pa.nulls(len(blobs), kind)
    full = blobs.drop_null()
    offsets = np.frombuffer(full.buffers()[1], dtype=np.int64)[full.offset:full.offset + len(full) + 1]
    data = np.frombuffer(full.buffers()[2], dtype=np.uint8)
    at = offsets[:-1].copy()

    def header(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte order, geometry type and count that open a polygon or multipolygon."""
        little = data[place] == 1
        return little, _numbers(data, place + 1, little, "u4"), _numbers(data, place + 5, little, "u4").astype(np.int64)

    little, types, counts = header(at)
    if not np.isin(types, (3, 6)).all():
        raise ValueError(f"expected two-dimensional polygons, found WKB type {types[~np.isin(types, (3, 6))][0]}")
    many = types == 6
    parts, rings = np.where(many, counts, 0), np.where(many, 0, counts)
    at = at + 9
    outer = ~many  # whether the next ring opens a part
    found: list[tuple[np.ndarray, ...]] = []  # row, first byte, points, byte order, whether it is an outer ring
    while True:
        opens = np.flatnonzero((rings == 0) & (parts > 0))
        if len(opens):
            little[opens], inner, rings[opens] = header(at[opens])
            if (inner != 3).any():
                raise ValueError("a multipolygon holds polygons only")
            at[opens] += 9
            parts[opens] -= 1
            outer[opens] = True
        reads = np.flatnonzero(rings > 0)
        if not len(reads):
            if not (parts > 0).any():
                break
            continue
        points = _numbers(data, at[reads], little[reads], "u4").astype(np.int64)
        found.append((reads, at[reads] + 4, points, little[reads], outer[reads].copy()))
        at[reads] += 4 + 16 * points
        rings[reads] -= 1
        outer[reads] = False
    if (at != offsets[1:]).any():
        raise ValueError("a WKB outline ends early or late")
    step = np.concatenate([np.full(len(f[0]), n) for n, f in enumerate(found)]) if found else np.zeros(0, dtype=np.int64)
    row, first, points, order, is_outer = (np.concatenate([f[n] for f in found]) if found else np.zeros(0, dtype=np.int64) for n in range(5))
    sort = np.lexsort((step, row))
    row, first, points, order, is_outer = (c[sort] for c in (row, first, points, order, is_outer))
    ends = np.concatenate([[0], np.cumsum(points)])
    inside = np.arange(ends[-1]) - np.repeat(ends[:-1], points)
    place, each = np.repeat(first, points) + 16 * inside, np.repeat(order, points)
    x, y = _numbers(data, place, each, "f8"), _numbers(data, place + 8, each, "f8")
    after = np.where(inside + 1 == np.repeat(points, points), np.arange(len(x)) - inside, np.arange(len(x)) + 1)
    left_x, left_y = np.repeat(x[np.minimum(ends[:-1], max(0, len(x) - 1))] if len(x) else x, points), np.repeat(y[np.minimum(ends[:-1], max(0, len(y) - 1))] if len(y) else y, points)
    cross = (x - left_x) * (y[after] - left_y) - (x[after] - left_x) * (y - left_y)
    area = np.diff(np.concatenate([[0.0], np.cumsum(cross)])[ends])
    turn = np.repeat((area >= 0) != is_outer.astype(bool), points)
    source = np.where(turn, np.repeat(ends[1:] - 1, points) - inside, np.arange(len(x)))
    vertices = pa.StructArray.from_arrays([pa.array(x[source]), pa.array(y[source])], names=["x", "y"])
    ring_lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vertices)
    per_row = np.zeros(len(blobs), dtype=np.int64)
    np.add.at(per_row, rows[row], 1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), ring_lists, mask=pa.array(~valid)).cast(kind)


def decode_wkb(column: str | Column) -> Column:
    """Signed rings of WKB polygons and multipolygons, once, at ingest."""
    @F.arrow_udf(polygons.RINGS)
    def decode(blobs: pa.Array) -> pa.Array:
        parts = [decode_outlines(blobs.slice(start, 4096)) for start in range(0, len(blobs), 4096)]
        return pa.concat_arrays(parts) if parts else decode_outlines(blobs)

    return decode(F.col(column) if isinstance(column, str) else column)


def read_outlines(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """(cell_id, vertices) from Parquet with a WKB ``geometry`` column; ``vertices`` are signed rings."""
    df = spark.read.parquet(path)
    if "geometry" not in df.columns:
        raise KeyError(f"expected a geometry column in {path}")
    ident = id_column or next((c for c in ("cell_id", "__index_level_0__", "index") if c in df.columns), None)
    if ident is None:
        raise KeyError(f"no cell id column in {path}")
    return df.select(F.col(ident).cast("long").alias("cell_id"), decode_wkb("geometry").alias("vertices"))


def read_segmentation(spark: SparkSession, path: str, id_column: str | None = None) -> DataFrame:
    """Centroid and bounding box per cell."""
    return gap.polygon_metadata(read_outlines(spark, path, id_column))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, class, vertices) from GeoJSON documents of any size; ``vertices`` are signed rings.

    The id falls back to the number of the feature in its document and the class to 'NA'.
    """
    return _cells(geojson.features(geojson.text_pieces(spark, path)))


def read_geojson_zip(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_geojson`` for the first ``.geojson`` member of each archive."""
    return _cells(geojson.features(geojson.zip_pieces(spark, path)))


def _cells(features: DataFrame) -> DataFrame:
    return features.select(
        F.coalesce(F.col("cell_id").try_cast("double").try_cast("long"), F.col("pos")).alias("cell_id"),
        F.coalesce("class", F.lit("NA")).alias("class"), "vertices")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").limit(1).collect())
    except Exception as exc:  # a missing path is an answer here
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise


def read_segmentation_any(spark: SparkSession, folder: str, sample: str, kind: str = "cellvit") -> DataFrame:
    """First of ``.parquet``, ``.geojson``, ``.geojson.zip`` that exists: (cell_id, class, vertices)."""
    names = {"cellvit": ("cellvit_seg", f"{sample}_cellvit_seg"), "xenium": ("xenium_seg", f"{sample}_xenium_cell_seg")}
    if kind not in names:
        raise ValueError("kind must be cellvit or xenium")
    sub, stem = names[kind]
    base = f"{folder.rstrip('/')}/{sub}/{stem}"
    if _exists(spark, f"{base}.parquet"):
        df = spark.read.parquet(f"{base}.parquet")
        label = F.col("class").cast("string") if "class" in df.columns else F.lit(None).cast("string")
        ident = next((c for c in ("cell_id", "__index_level_0__", "index") if c in df.columns), None)
        if ident is None:
            raise KeyError(f"no cell id column in {base}.parquet")
        return df.select(F.col(ident).cast("long").alias("cell_id"), F.coalesce(label, F.lit("NA")).alias("class"),
                         decode_wkb("geometry").alias("vertices"))
    if _exists(spark, f"{base}.geojson"):
        return read_geojson(spark, f"{base}.geojson")
    if _exists(spark, f"{base}.geojson.zip"):
        return read_geojson_zip(spark, f"{base}.geojson.zip")
    raise FileNotFoundError(f"no segmentation for {sample} under {folder}")


def read_expression_long(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """Long expression partitioned by ``sample_id``; a sample is a partition, an entity a pushed-down filter."""
    df = spark.read.parquet(path)
    return df if sample is None else df.where(F.col("sample_id") == sample)


def open_bank_expression(spark: SparkSession, path: str) -> DataFrame:
    """Bucketed expression written by ``writers.write_bank_expression``, in this session or another."""
    from spotloom.sources.writers import bank_table

    name = bank_table(path)
    if not spark.catalog.tableExists(name):
        facts = spark.read.json(f"{path}/layout").first()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(facts["columns"])))
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{facts['id_col']}`) SORTED BY (`{facts['id_col']}`) INTO {facts['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def read_tile_index(spark: SparkSession, path: str) -> DataFrame:
    """Tile rows of a store whose parallel arrays are cut to the shortest: (sample_id, patch_idx, barcode, x, y).

    The stored row holds ``sample_id``, ``barcodes`` (text or bytes), ``coords`` and ``n_img``.
    """
    df = spark.read.parquet(path)
    n = F.least(F.size("barcodes"), F.size("coords"), F.col("n_img").cast("int"))
    return (
        df.select("sample_id", F.posexplode(F.slice(F.arrays_zip("barcodes", "coords"), 1, n)).alias("patch_idx", "t"))
        .select("sample_id", F.col("patch_idx").cast("long").alias("patch_idx"), decode_name("t.barcodes").alias("barcode"),
                F.col("t.coords")[0].alias("x"), F.col("t.coords")[1].alias("y"))
    )


def _stems(spark: SparkSession, folder: str, suffix: str, name: str | None) -> DataFrame:
    # The content column is pruned: only the listing is read.
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder)
    if name:
        return files.select(F.regexp_extract("path", name, 1).alias("sample_id")).distinct()
    last = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.substring(last, F.lit(1), F.length(last) - len(suffix)).alias("sample_id")).distinct()


def discover_samples(spark: SparkSession, expression_dir: str, tile_dir: str, expression_suffix: str = ".parquet", tile_suffix: str = ".parquet", name: str | None = None) -> DataFrame:
    """Samples with both an expression file and a tile file, sorted; none is an error.

    A sample is the name of its file without the suffix, or what ``name`` finds in the path.
    """
    return samples_with_both(_stems(spark, expression_dir, expression_suffix, name), _stems(spark, tile_dir, tile_suffix, name))


def samples_with_both(expression: DataFrame, tiles: DataFrame) -> DataFrame:
    both = expression.select("sample_id").distinct().join(tiles.select("sample_id"), "sample_id", "left_semi")
    return panels.require_rows(both, "no sample has both an expression and a tile file").orderBy("sample_id")


def gene_panel_from_transcripts(transcripts: DataFrame, order: Column | str, remove_control: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct features in first-seen order, in each group of ``by``: (by…, pos, gene), ``pos`` the order value of the first sighting."""
    rows = filters.drop_control_features(transcripts) if remove_control else transcripts
    order = F.col(order) if isinstance(order, str) else order
    return rows.groupBy(*by, F.col("feature_name").alias("gene")).agg(F.min(order).alias("pos")).select(*by, "pos", "gene")
