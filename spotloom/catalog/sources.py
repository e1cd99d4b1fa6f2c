"""Scans and sinks: what is written to the shared folder is read back."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import functions as F, types as T

from spotloom.catalog.core import R, query, r6
from spotloom.operators import counting, panels, splits
from spotloom.plans import cells as cell_jobs
from spotloom.session import scratch_path
from spotloom.sources import documents, tables, text, writers


@query("src_01_read_transcripts", "SELECT cell_id, feature_name, overlaps_nucleus FROM fx_transcripts")
def _(v):
    path = scratch_path(v.spark, "transcripts")
    v.fx_transcripts.withColumn("feature_name", F.encode("feature_name", "UTF-8")).write.parquet(path)
    return tables.read_transcripts(v.spark, path, nucleus_only=True)


def ring():
    """Rectangle outline of the polygon view."""
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)).alias("vertices")


def _box(x0, y0, x1, y1, hole: bool = False):
    """Closed rectangle ring, counter-clockwise, or clockwise as a hole."""
    corners = [(x0, y0), (x0, y1), (x1, y1), (x1, y0)] if hole else [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in [*corners, corners[0]]])


def parts():
    """Outlines of the polygon view as lists of parts: every third has a hole of half its sides, every fifth a second part."""
    x, y, w, h, c = (F.col(n) for n in ("x0", "y0", "w", "h", "cell_id"))
    outer, hole = _box(x, y, x + w, y + h), _box(x + w / 4, y + h / 4, x + w * 3 / 4, y + h * 3 / 4, True)
    first = F.when(c % 3 == 1, F.array(outer, hole)).otherwise(F.array(outer))
    return F.when(c % 5 == 2, F.array(first, F.array(_box(x + 300, y, x + 300 + w, y + h)))).otherwise(F.array(first)).alias("parts")


@F.udf(returnType=T.BinaryType(), useArrow=True)
def _wkb(parts):
    def polygon(rings):
        body = b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *[c for p in r for c in (p["x"], p["y"])]) for r in rings)
        return struct.pack("<BII", 1, 3, len(rings)) + body

    return polygon(parts[0]) if len(parts) == 1 else struct.pack("<BII", 1, 6, len(parts)) + b"".join(map(polygon, parts))


@F.udf(returnType=T.BinaryType(), useArrow=True)
def _zipped(text):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("cells.geojson", text)
    return held.getvalue()


BOX_SQL = f"""SELECT cell_id, {R('x0 + w / 2', 'centroid_x')}, {R('y0 + h / 2', 'centroid_y')}, {R('x0', 'bbox_min_x')}, {R('y0', 'bbox_min_y')},
    {R('x0 + w', 'bbox_max_x')}, {R('y0 + h', 'bbox_max_y')} FROM fx_polygons"""
BOX = ["centroid_x", "centroid_y", "bbox_min_x", "bbox_min_y", "bbox_max_x", "bbox_max_y"]

# Area of the first part less its hole, and of the second part.
PART_SQL = """t AS (SELECT *, w * h * CASE WHEN cell_id % 3 = 1 THEN 0.75e0 ELSE 1e0 END AS a1, CASE WHEN cell_id % 5 = 2 THEN w * h ELSE 0 END AS a2 FROM fx_polygons)"""


@query("src_02_read_segmentation", f"""WITH {PART_SQL} SELECT cell_id, {R('((x0 + w / 2) * a1 + (x0 + 300 + w / 2) * a2) / (a1 + a2)', 'centroid_x')}, {R('y0 + h / 2', 'centroid_y')},
    {R('x0', 'bbox_min_x')}, {R('y0', 'bbox_min_y')}, {R('x0 + w + CASE WHEN cell_id % 5 = 2 THEN 300 ELSE 0 END', 'bbox_max_x')}, {R('y0 + h', 'bbox_max_y')} FROM t""")
def _(v):
    path = scratch_path(v.spark, "segmentation")
    v.fx_polygons.select("cell_id", _wkb(parts()).alias("geometry")).write.parquet(path)
    return tables.read_segmentation(v.spark, path).select("cell_id", *[r6(c) for c in BOX])


RING_SQL = """r AS (SELECT cell_id, technology, 0 AS part, 0 AS hole, [x0, x0 + w, x0 + w, x0, x0] AS xs, [y0, y0, y0 + h, y0 + h, y0] AS ys FROM fx_polygons
  UNION ALL SELECT cell_id, technology, 0, 1, [x0 + w / 4, x0 + w / 4, x0 + w * 3 / 4, x0 + w * 3 / 4, x0 + w / 4], [y0 + h / 4, y0 + h * 3 / 4, y0 + h * 3 / 4, y0 + h / 4, y0 + h / 4] FROM fx_polygons WHERE cell_id % 3 = 1
  UNION ALL SELECT cell_id, technology, 1, 0, [x0 + 300, x0 + 300 + w, x0 + 300 + w, x0 + 300, x0 + 300], [y0, y0, y0 + h, y0 + h, y0] FROM fx_polygons WHERE cell_id % 5 = 2),
n AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY part, hole) - 1 AS ring FROM r)"""


@query("src_03_read_segmentation_any", f"""WITH {RING_SQL}, o AS (SELECT cell_id, technology AS class, CAST(ring AS INT) AS ring, unnest(range(5)) AS ord, unnest(xs) AS x, unnest(ys) AS y FROM n)
SELECT sample, cell_id, class, ring, CAST(ord AS INT) AS ord, {R('x')}, {R('y')} FROM o, (SELECT unnest(['A', 'B', 'C']) AS sample)""")
def _(v):
    folder = scratch_path(v.spark, "outlines")
    outlines = v.fx_polygons.select("cell_id", F.col("technology").alias("class"), parts())
    outlines.select("cell_id", "class", _wkb("parts").alias("geometry")).write.parquet(f"{folder}/cellvit_seg/A_cellvit_seg.parquet")
    point = F.transform("parts", lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    one = F.size("parts") == 1
    shape = F.concat(F.lit('{"type":"'), F.when(one, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), F.when(one, F.to_json(point[0])).otherwise(F.to_json(point)), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("cell_id").cast("string").alias("cell_id"), "class")), F.lit(',"geometry":'), shape, F.lit("}"))
    # The fixture writes one document per thousand outlines, so that no task builds a growing one.
    docs = outlines.select(F.floor(F.col("cell_id") / 1000).alias("d"), feature.alias("f")).groupBy("d").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    docs.write.partitionBy("d").text(f"{folder}/cellvit_seg/B_cellvit_seg.geojson")
    docs.select("d", _zipped("value").cast("string").alias("value")).write.partitionBy("d").text(f"{folder}/cellvit_seg/C_cellvit_seg.geojson.zip")
    found = panels.stack_frames([tables.read_segmentation_any(v.spark, folder, s).select(F.lit(s).alias("sample"), "cell_id", "class", "vertices") for s in "ABC"])
    rings = found.select("sample", "cell_id", "class", F.posexplode("vertices").alias("ring", "points"))
    return rings.select("sample", "cell_id", "class", "ring", F.posexplode("points").alias("ord", "p")).select("sample", "cell_id", "class", "ring", "ord", r6("p.x", "x"), r6("p.y", "y"))


@query("src_04_read_gene_list", """
WITH l AS (SELECT p_partkey AS pos, trim(CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN 'Total genes' ELSE concat('  ', p_type, '-', p_brand, ' ') END) AS gene FROM part),
     f AS (SELECT gene, min(pos) AS first_pos FROM l WHERE gene <> '' AND NOT starts_with(gene, 'Total') GROUP BY gene)
SELECT CAST(row_number() OVER (ORDER BY first_pos) - 1 AS BIGINT) AS pos, gene FROM f""")
def _(v):
    line = F.when(F.col("p_partkey") % 7 == 0, "  ").when(F.col("p_partkey") % 11 == 0, "Total genes").otherwise(
        F.concat(F.lit("  "), "p_type", F.lit("-"), "p_brand", F.lit(" ")))
    path = scratch_path(v.spark, "genes")
    # A gene list is one small file, its lines in order.
    v.part.select("p_partkey", line.alias("line")).coalesce(1).sortWithinPartitions("p_partkey").select("line").write.text(path)
    return text.read_gene_list(v.spark, f"{path}/*.txt", skip_headers=True)


@query("src_05_read_gene_table", "SELECT p_brand AS gene FROM part")
def _(v):
    path = scratch_path(v.spark, "gene_table")
    v.part.select("p_partkey", F.col("p_brand").alias("gene_name")).write.csv(path, sep="\t", header=True)
    return text.read_gene_table(v.spark, path)


@query("src_06_read_sample_metadata", f"""
WITH m AS (SELECT s_name AS sample_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0.25e0 + s_nationkey / 100e0 END AS emb, 0.5e0 + s_nationkey / 50e0 AS est,
    CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 100e0 END AS gap, CASE WHEN s_suppkey % 5 = 0 THEN 'UNKNOWN' ELSE 'Visium' END AS technology FROM supplier)
SELECT sample_id, {R('coalesce(emb, est)', 'pixel_size_um')}, {R('55', 'spot_diameter_um')}, technology, {R('coalesce(gap, 55)', 'inter_spot_dist_um')} FROM m""")
def _(v):
    k = F.col("s_suppkey")
    raw = v.supplier.select(
        F.col("s_name").alias("sample"),
        F.when(k % 6 == 0, "not a number").when(k % 3 == 0, "NaN").otherwise((F.lit(0.25) + F.col("s_nationkey") / F.lit(100.0)).cast("string")).alias("pixel_size_um_embedded"),
        (F.lit(0.5) + F.col("s_nationkey") / F.lit(50.0)).cast("string").alias("pixel_size_um_estimated"),
        F.lit("55").alias("spot_diameter"), F.when(k % 4 == 0, "-1").otherwise("100").alias("inter_spot_dist"),
        F.when(k % 5 == 0, "").otherwise("Visium").alias("st_technology"))
    path = scratch_path(v.spark, "metadata")
    write_each(raw.select("sample", F.to_json(F.struct(*[c for c in raw.columns if c != "sample"])).alias("value")), path)
    found = documents.read_sample_metadata(v.spark, path, files="*.txt", name=r"sample=([^/]+)/")
    return found.select(named("sample_id"), r6("pixel_size_um"), r6("spot_diameter_um"), "technology", r6("inter_spot_dist_um"))


def named(column: str):
    """A name as it was before it became a folder, which escapes it, in a path, which escapes it again."""
    return F.url_decode(F.url_decode(column)).alias(column)


FILES_A_TASK = 256


def write_each(rows, path: str) -> None:
    """One small text file for each row, in a folder that names it. All rows of a name come from one task.

    The rows are few bytes, so the number of tasks goes by the number of files; each task moves its own files into place.
    """
    tasks = max(1, -(-rows.count() // FILES_A_TASK))
    rows.repartition(tasks, "sample").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("sample").text(path)


def write_10x(v, path: str) -> None:
    """Triplet folder of the expression view: range-ordered text parts, the banner in the first one."""
    genes = v.part.select(F.col("p_brand").alias("gene")).distinct()
    genes.select(F.concat_ws("\t", F.concat(F.lit("id-"), "gene"), "gene").alias("value")).coalesce(1).write.text(f"{path}/genes.tsv")
    v.orders.select(F.col("o_orderkey").cast("string").alias("value")).coalesce(1).write.text(f"{path}/barcodes.tsv")
    order = lambda name: text._indexed(v.spark, f"{path}/{name}")
    g = order("genes.tsv").select(F.col("idx").alias("gi"), F.col("parts")[1].alias("gene"))
    b = order("barcodes.tsv").select(F.col("idx").alias("bi"), F.col("parts")[0].cast("long").alias("obs_id"))
    expr = v.fx_expr.join(g, "gene").join(b, "obs_id")
    body = expr.select(F.col("bi").alias("o"), F.concat_ws(" ", F.col("gi").cast("string"), F.col("bi").cast("string"), F.col("cnt").cast("string")).alias("value"))
    size = f"{g.count()} {b.count()} {expr.count()}"
    head = v.spark.createDataFrame([(-2, "%%MatrixMarket matrix coordinate integer general"), (-1, size)], "o long, value string")
    head.unionByName(body).repartitionByRange("o").sortWithinPartitions("o").select("value").write.text(f"{path}/matrix.mtx")


@query("src_07_read_10x_triplets", "SELECT CAST(obs_id AS VARCHAR) AS barcode, gene, CAST(cnt AS DOUBLE) AS value FROM fx_expr")
def _(v):
    path = scratch_path(v.spark, "triplets")
    write_10x(v, path)
    return text.read_10x_triplets(v.spark, path)


@query("src_08_read_expression_long", "SELECT sample_id, obs_id, gene, cnt FROM fx_expr WHERE sample_id = '1-URGENT'")
def _(v):
    path = writers.write_expression_long(v.fx_expr, scratch_path(v.spark, "expression"))
    return tables.read_expression_long(v.spark, path, "1-URGENT").select("sample_id", "obs_id", "gene", "cnt")


@query("src_09_read_fold_manifest", """
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'named' ELSE s_name END AS split_name, CAST(s_nationkey AS INT) AS fold_index,
  CASE WHEN s_suppkey % 2 = 0 THEN 'z' ELSE concat('A', CAST(s_nationkey AS VARCHAR), ',B,C') END AS sample_ids,
  concat('B,A', CAST(s_nationkey AS VARCHAR)) AS train_samples, 'C' AS test_samples FROM supplier""")
def _(v):
    n = F.col("s_nationkey").cast("string")
    fold = F.concat(F.lit('{"fold_index":'), n, F.lit(',"train_samples":"B, A'), n, F.lit(',","test_samples":["C"]}'))
    doc = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('{"split_name":"named","sample_ids":["z"],"folds":['), fold, F.lit("]}"))).otherwise(
        F.concat(F.lit("["), fold, F.lit("]")))
    path = scratch_path(v.spark, "manifests")
    write_each(v.supplier.select(F.col("s_name").alias("sample"), doc.alias("value")), path)
    out = documents.read_fold_manifest(v.spark, path, files="*.txt", name=r"sample=([^/]+)/")
    out = out.withColumn("split_name", named("split_name"))
    return out.select("split_name", "fold_index", *[F.array_join(c, ",").alias(c) for c in ("sample_ids", "train_samples", "test_samples")])


LOG_SQL = f"""SELECT fold, {R("CAST(regexp_extract(line, 'overall=([-0-9.]+)', 1) AS DOUBLE)", 'overall')}, {R("CAST(regexp_extract(line, 'gene=([-0-9.]+)', 1) AS DOUBLE)", 'gene')},
    {R("CAST(regexp_extract(line, 'spot=([-0-9.]+)', 1) AS DOUBLE)", 'spot')} FROM (SELECT CAST(fold AS INT) AS fold, arg_max(line, pos) AS line FROM fx_logs GROUP BY fold)"""


@query("src_10_read_training_logs", LOG_SQL)
def _(v):
    return text.read_training_logs(v.spark, write_logs(v), name="*.txt").select("fold", r6("overall"), r6("gene"), r6("spot"))


def write_logs(v) -> str:
    """The log lines of each fold in ``fold=n``, one file a fold, its lines in order."""
    path = scratch_path(v.spark, "logs")
    v.fx_logs.repartition("fold").sortWithinPartitions("fold", "pos").select("fold", "line").write.partitionBy("fold").text(path)
    return path


@query("src_11_read_fold_metrics", f"""
WITH f AS (SELECT CAST(s_nationkey AS INT) AS fold_idx, avg(s_acctbal) / 10000 AS o, avg(s_suppkey) / 1000 AS g FROM supplier GROUP BY s_nationkey)
SELECT fold_idx, 'visium' AS platform, {R('o', 'overall_pearson')}, {R('g', 'mean_gene_pearson')} FROM f
UNION ALL SELECT fold_idx, 'xenium', {R('g', 'overall_pearson')}, {R('o', 'mean_gene_pearson')} FROM f""")
def _(v):
    path = scratch_path(v.spark, "fold_metrics")
    f = v.supplier.groupBy(F.col("s_nationkey").alias("fold")).agg((F.avg("s_acctbal") / 10000).alias("o"), (F.avg("s_suppkey") / 1000).alias("g"))
    block = lambda a, b: F.struct(F.col(a).alias("overall_pearson"), F.col(b).alias("mean_gene_pearson"), F.lit(0.5).alias("mean_spot_pearson"))
    f.select("fold", block("o", "g").alias("visium_test_metrics"), block("g", "o").alias("xenium_test_metrics")).repartition("fold").write.partitionBy("fold").json(path)
    return documents.read_fold_metrics(v.spark, path, "*.json").select("fold_idx", "platform", r6("overall_pearson"), r6("mean_gene_pearson"))


@query("src_12_read_spot_positions", f"SELECT concat('s', CAST(spot_id AS VARCHAR)) AS barcode, {R('center_x', 'x')}, {R('center_y', 'y')} FROM fx_spots")
def _(v):
    path = scratch_path(v.spark, "spot_files")
    name = F.concat(F.lit("s"), F.col("spot_id").cast("string"))
    v.fx_spots.select(name, F.lit(1), F.lit(0), F.lit(0), "center_x", "center_y").write.csv(f"{path}/positions")
    v.fx_spots.select(name, F.lit("x")).write.csv(f"{path}/barcodes", sep="\t")
    joined = text.join_positions(text.read_barcodes(v.spark, f"{path}/barcodes"), text.read_spot_positions(v.spark, f"{path}/positions"))
    return joined.select("barcode", r6("x"), r6("y"))


def tile_store(v):
    """Tile stores of at most 256 tiles each, with more images than coordinates in some."""
    chunk = v.fx_spots.withColumn("store", F.concat_ws("-", F.col("sample_no").cast("string"), F.floor(F.col("spot_id") / 256).cast("string")))
    rows = chunk.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("spot_id", "center_x", "center_y"))).alias("t"))
    return rows.select(
        F.col("store").alias("sample_id"), F.transform("t", lambda t: F.encode(F.concat(F.lit("s"), t["spot_id"].cast("string")), "UTF-8")).alias("barcodes"),
        F.transform("t", lambda t: F.array(t["center_x"], t["center_y"])).alias("coords"), (F.size("t") - F.size("t") % 2).alias("n_img"))


@query("src_13_read_tile_index", f"""
WITH s AS (SELECT concat(CAST(sample_no AS VARCHAR), '-', CAST(spot_id // 256 AS VARCHAR)) AS sample_id, * FROM fx_spots),
     n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY spot_id) - 1 AS patch_idx, count(*) OVER (PARTITION BY sample_id) AS c FROM s)
SELECT sample_id, CAST(patch_idx AS BIGINT) AS patch_idx, concat('s', CAST(spot_id AS VARCHAR)) AS barcode, {R('center_x', 'x')}, {R('center_y', 'y')} FROM n WHERE patch_idx < c - c % 2""")
def _(v):
    path = scratch_path(v.spark, "tiles")
    tile_store(v).write.parquet(path)
    return tables.read_tile_index(v.spark, path).select("sample_id", "patch_idx", "barcode", r6("x"), r6("y"))


@query("src_14_discover_samples", """SELECT DISTINCT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS sample_id FROM customer
    WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)""")
def _(v):
    name = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    expr = v.customer.select(name.alias("sample")).distinct()
    tiles = v.customer.join(v.supplier.select(F.col("s_nationkey").alias("c_nationkey")).distinct(), "c_nationkey", "left_semi").select(name.alias("sample")).distinct()
    folder = scratch_path(v.spark, "samples")
    for rows, sub in ((expr, "expression"), (tiles, "tiles")):
        # Empty files would do: only the listing is read.
        rows.select("sample", F.lit("").alias("value")).repartition("sample").write.partitionBy("sample").text(f"{folder}/{sub}")
    return tables.discover_samples(v.spark, f"{folder}/expression", f"{folder}/tiles", ".txt", ".txt", name=r"sample=([^/]+)/").select(named("sample_id"))


@query("src_15_gene_panel_from_transcripts", "SELECT min(mol_id) AS pos, feature_name AS gene FROM fx_transcripts WHERE NOT starts_with(feature_name, 'BLANK_') GROUP BY feature_name")
def _(v):
    return tables.gene_panel_from_transcripts(v.fx_transcripts, "mol_id")


# -- sinks --------------------------------------------------------------------

@query("snk_01_write_cell_cache", """
SELECT cell_id, feature_name AS gene, count(*) AS cnt FROM fx_transcripts WHERE cell_id > 0 AND NOT starts_with(feature_name, 'BLANK_')
  AND cell_id IN (SELECT cell_id FROM fx_cells) GROUP BY cell_id, feature_name""")
def _(v):
    t = cell_jobs.prepare_cells(v.fx_transcripts, v.fx_cells)
    base = writers.write_cell_cache(scratch_path(v.spark, "cache"), {"nucleus_only": False}, counts=t.counts, cells=t.cells, panel=t.panel, manifest=t.manifest)
    return v.spark.read.parquet(f"{base}/counts")


@query("snk_02_write_pseudospots", """
WITH m AS (SELECT cell_id // 4 AS spot_id, cell_id FROM fx_cells), c AS (SELECT cell_id, feature_name AS gene, count(*) AS cnt FROM fx_transcripts WHERE cell_id > 0 GROUP BY cell_id, feature_name)
SELECT spot_id, gene, CAST(sum(cnt) AS BIGINT) AS cnt FROM m JOIN c USING (cell_id) GROUP BY spot_id, gene""")
def _(v):
    members = v.fx_cells.select(F.expr("cell_id div 4").alias("spot_id"), "cell_id")
    counts = counting.cell_gene_counts(v.fx_transcripts, remove_control=False)
    spot_counts = cell_jobs.pseudospot_counts(members, counts)
    spots = members.groupBy("spot_id").agg(F.count(F.lit(1)).alias("cell_count"))
    base = writers.write_pseudospots(scratch_path(v.spark, "spots"), {"min_cells": 1}, counts=spot_counts, spots=spots, membership=members,
                                     manifest=spots.agg(F.count(F.lit(1)).alias("num_pseudospots")))
    return v.spark.read.parquet(f"{base}/counts")


@query("snk_03_write_manifest", f"SELECT count(*) AS n_cells, {R('min(centroid_x)', 'x_low')}, {R('max(centroid_x)', 'x_high')} FROM fx_cells")
def _(v):
    path = scratch_path(v.spark, "manifest")
    writers.write_manifest(v.fx_cells.agg(F.count(F.lit(1)).alias("n_cells"), F.min("centroid_x").alias("x_low"), F.max("centroid_x").alias("x_high")), path)
    return v.spark.read.schema("n_cells long, x_low double, x_high double").json(path).select("n_cells", r6("x_low"), r6("x_high"))


@query("snk_04_write_split_manifest", "SELECT CASE WHEN sample_id = '1-URGENT' THEN 'test' ELSE 'train' END AS split, cell_id AS id FROM fx_cells")
def _(v):
    test = v.fx_cells.where(F.col("sample_id") == "1-URGENT").select("sample_id")
    split = splits.leave_one_out_split(v.fx_cells.select("sample_id", F.col("cell_id").alias("id")), test)
    return v.spark.read.parquet(writers.write_split_manifest(split, scratch_path(v.spark, "split"))).select("split", "id")


@query("snk_05_write_metric_table", f"""SELECT fold, {R('overall')}, CASE WHEN platform = 'visium' THEN round(mean_gene, 6) + 0e0 END AS mean_gene FROM fx_fold_metrics""")
def _(v):
    m = v.fx_fold_metrics
    frames = [m.where(F.col("platform") == "visium").select("fold", "overall", "mean_gene"), m.where(F.col("platform") == "xenium").select("fold", "overall")]
    path = writers.write_metric_table(frames, scratch_path(v.spark, "metrics"))
    return v.spark.read.csv(path, header=True, schema="fold int, mean_gene double, overall double").select("fold", r6("overall"), r6("mean_gene"))


@query("snk_06_write_gene_list", "SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS pos, gene FROM fx_panel")
def _(v):
    path = writers.write_gene_list(v.fx_panel, scratch_path(v.spark, "genes"))
    return text.read_gene_list(v.spark, path)


@query("snk_07_write_diagnostic_tables", f"SELECT technology, sample_id, cell_id, {R('w * h', 'area_px2')} FROM fx_polygons")
def _(v):
    rows = v.fx_polygons.select("technology", "sample_id", "cell_id", (F.col("w") * F.col("h")).alias("area_px2"))
    path = writers.write_diagnostic_table(rows, scratch_path(v.spark, "records"), "csv")
    return v.spark.read.csv(path, header=True, schema="technology string, sample_id string, cell_id long, area_px2 double").select("technology", "sample_id", "cell_id", r6("area_px2"))
