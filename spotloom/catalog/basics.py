"""Filters, joins, counting, windows, sampling, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.catalog.core import R, query, r6
from spotloom.catalog.sources import BOX, BOX_SQL, ring
from spotloom.constants import PLATFORM_CODES, STAGE_ORDER
from spotloom.functions import polygons, scalars
from spotloom.operators import counting, filters, gap, metrics, normalization, panels, ranking, retrieval, spatial, splits
from spotloom.plans import cells as cell_jobs

# Grid of the flagship: pixel 0.5 µm, diameter 55 µm, spacing 100 µm, hexagonal.
GRID = cell_jobs.GridParameters(55.0, 200.0, "hex")

# -- filters ------------------------------------------------------------------


@query("flt_01_drop_control_features", "SELECT cell_id, feature_name FROM fx_transcripts WHERE NOT starts_with(feature_name, 'BLANK_')")
def _(v):
    return filters.drop_control_features(v.fx_transcripts.select("cell_id", "feature_name"))


@query("flt_02_valid_cell_ids", """
WITH t AS (SELECT mol_id, CASE WHEN mol_id % 3 = 0 THEN concat(CAST(cell_id AS VARCHAR), '.7') WHEN mol_id % 11 = 0 THEN 'UNASSIGNED' ELSE CAST(cell_id AS VARCHAR) END AS c FROM fx_transcripts)
SELECT mol_id, CAST(trunc(TRY_CAST(c AS DOUBLE)) AS BIGINT) AS cell_id FROM t WHERE trunc(TRY_CAST(c AS DOUBLE)) > 0""")
def _(v):
    text = F.when(F.col("mol_id") % 3 == 0, F.concat(F.col("cell_id").cast("string"), F.lit(".7"))).when(
        F.col("mol_id") % 11 == 0, "UNASSIGNED").otherwise(F.col("cell_id").cast("string"))
    return filters.valid_cell_ids(v.fx_transcripts.select("mol_id", text.alias("cell_id")))


@query("flt_03_nucleus_only", "SELECT mol_id, feature_name FROM fx_transcripts WHERE overlaps_nucleus = 1")
def _(v):
    flag = F.when(F.col("overlaps_nucleus") == 1, "1.0").otherwise("none")
    return filters.nucleus_only(v.fx_transcripts.withColumn("overlaps_nucleus", flag)).select("mol_id", "feature_name")


COUNTS_SQL = """c AS (SELECT cell_id, feature_name AS gene, count(*) AS cnt FROM fx_transcripts
    WHERE cell_id > 0 AND NOT starts_with(feature_name, 'BLANK_') AND cell_id IN (SELECT cell_id FROM fx_cells) GROUP BY cell_id, feature_name)"""
KEPT_SQL = COUNTS_SQL + """, k AS (SELECT f.*, CAST(s.transcript_count AS BIGINT) AS transcript_count FROM fx_cells f
    JOIN (SELECT cell_id, sum(cnt) AS transcript_count FROM c GROUP BY cell_id) s USING (cell_id))"""


def counted(v):
    return counting.cell_gene_counts(v.fx_transcripts, v.fx_cells)


@query("flt_04_drop_zero_expression", f"WITH {KEPT_SQL} SELECT cell_id, transcript_count FROM k")
def _(v):
    return counting.attach_counts(v.fx_cells, counted(v)).select("cell_id", "transcript_count")


@query("flt_05_in_tissue_only", "SELECT cell_id, sample_id FROM fx_cells WHERE in_tissue > 0")
def _(v):
    return filters.in_tissue_only(v.fx_cells).select("cell_id", "sample_id")


HIT_SQL = """
    e AS (SELECT min(centroid_x) AS x0, max(centroid_x) AS x1, min(centroid_y) AS y0, max(centroid_y) AS y1 FROM {cells}),
    q AS (SELECT c.cell_id, c.centroid_x AS x, c.centroid_y AS y, e.*, CAST(round_even((c.centroid_y - y0) / (200e0 * sqrt(3e0) / 2e0), 0) AS BIGINT) + o.o AS grid_row
          FROM {cells} c, e, (SELECT unnest([-1, 0, 1]) AS o) o),
    w AS (SELECT *, x0 + CASE WHEN grid_row % 2 = 0 THEN 0e0 ELSE 100e0 END AS sx, y0 + grid_row * (200e0 * sqrt(3e0) / 2e0) AS center_y FROM q
          WHERE grid_row >= 0 AND grid_row < floor((y1 + 55e0 - y0) / (200e0 * sqrt(3e0) / 2e0)) + 1),
    p AS (SELECT *, CAST(greatest(floor((x1 + 55e0 - sx) / 200e0) + 1, 0) AS BIGINT) AS ncols FROM w),
    g AS (SELECT *, least(greatest(CAST(round_even((x - sx) / 200e0, 0) AS BIGINT), 0), ncols - 1) AS grid_col FROM p WHERE ncols > 0),
    d AS (SELECT *, sx + grid_col * 200e0 AS center_x, (x - sx - grid_col * 200e0) * (x - sx - grid_col * 200e0) + (y - center_y) * (y - center_y) AS d2 FROM g),
    h AS (SELECT cell_id, grid_row, grid_col, center_x, center_y FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, grid_row) AS r FROM d) WHERE r = 1 AND d2 <= 55e0 * 55e0)"""
SPOT_SQL = """
    s AS (SELECT grid_row, grid_col, count(*) AS cell_count FROM h GROUP BY grid_row, grid_col HAVING count(*) >= 3),
    n AS (SELECT *, CAST(row_number() OVER (ORDER BY grid_row, grid_col) - 1 AS BIGINT) AS spot_id FROM s)"""


@query("flt_06_having_min_cells", f"WITH {HIT_SQL.format(cells='fx_cells')}, {SPOT_SQL} SELECT grid_row, grid_col, cell_count FROM s")
def _(v):
    hits = spatial.nearest_grid_center(v.fx_cells, GRID.radius, GRID.spacing, GRID.layout)
    return filters.having_min_cells(hits.groupBy("grid_row", "grid_col").agg(F.count(F.lit(1)).alias("cell_count")), 3)


@query("flt_07_min_detect_fraction", f"""SELECT gene, {R('count(*) / (SELECT count(*) FROM fx_obs)', 'overall_detect')} FROM fx_expr WHERE cnt > 0
    GROUP BY gene HAVING count(*) / (SELECT count(*) FROM fx_obs) >= 0.15""")
def _(v):
    n = v.fx_obs.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = v.fx_expr.groupBy("gene").agg(F.count_if(F.col("cnt") > 0).alias("_s")).withColumn("_n", n)
    return filters.min_detect_fraction(share.select("gene", (F.col("_s") / F.col("_n")).alias("overall_detect")), 0.15).select("gene", r6("overall_detect"))


@query("flt_08_assert_count_like", f"""SELECT sample_id, {R('0', 'non_integer_fraction')}, true AS count_semantics_verified FROM fx_expr GROUP BY sample_id""")
def _(v):
    return filters.assert_count_like(v.fx_expr, by=("sample_id",)).select("sample_id", r6("non_integer_fraction"), "count_semantics_verified")


FOLD_SQL = """b AS (SELECT min(centroid_x) AS lo, max(centroid_x) AS hi FROM {t}),
    f AS (SELECT {t}.*, CAST((centroid_x >= lo + 1 * ((hi - lo) / 5)) AS INT) + CAST((centroid_x >= lo + 2 * ((hi - lo) / 5)) AS INT)
      + CAST((centroid_x >= lo + 3 * ((hi - lo) / 5)) AS INT) + CAST((centroid_x >= lo + 4 * ((hi - lo) / 5)) AS INT) AS fold FROM {t}, b)"""


@query("flt_09_split_filter", f"WITH {FOLD_SQL.format(t='fx_cells')} SELECT cell_id, fold FROM f WHERE fold <> 4")
def _(v):
    return filters.split_filter(splits.position_folds(v.fx_cells, "centroid_x", 5), "train", 4).select("cell_id", "fold")


VIEW_ROWS = "(SELECT id, platform, side, CASE WHEN id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, CASE WHEN id % 3 = 0 THEN 'fused' WHEN id % 3 = 1 THEN 'shared' ELSE 'private' END AS view FROM fx_embed)"


def view_rows(v):
    return v.fx_embed.withColumn("model", F.when(F.col("id") % 2 == 0, "m1").otherwise("m2")).withColumn(
        "view", F.when(F.col("id") % 3 == 0, "fused").when(F.col("id") % 3 == 1, "shared").otherwise("private"))


@query("flt_10_select_view", f"SELECT id, platform, side FROM {VIEW_ROWS} WHERE model = 'm1' AND view = 'shared'")
def _(v):
    return filters.select_view(view_rows(v), "m1", "alignment").select("id", "platform", "side")


NEAR_SQL = """a AS (SELECT cell_id, in_tissue, spot_id, distance FROM (SELECT c.cell_id, c.in_tissue, p.spot_id, sqrt((centroid_x - center_x) * (centroid_x - center_x) + (centroid_y - center_y) * (centroid_y - center_y)) AS distance,
    row_number() OVER (PARTITION BY c.cell_id ORDER BY (centroid_x - center_x) * (centroid_x - center_x) + (centroid_y - center_y) * (centroid_y - center_y), p.spot_id) AS r
    FROM fx_cells c JOIN fx_spots p ON abs(centroid_x - center_x) < 60 AND abs(centroid_y - center_y) < 60) WHERE r = 1 AND distance < 60)"""


@query("flt_11_covered_spots", f"WITH {NEAR_SQL} SELECT spot_id, count(*) AS cells_per_spot FROM a GROUP BY spot_id")
def _(v):
    assigned = spatial.nearest_within_radius(v.fx_cells, v.fx_spots, 60.0)
    return filters.covered_spots(retrieval.cells_per_spot(assigned, v.fx_spots)).select("spot_id", "cells_per_spot")


@query("flt_12_any_panel_gene_present", """SELECT DISTINCT sample_id FROM fx_obs WHERE sample_id IN (SELECT sample_id FROM fx_expr WHERE gene = 'Brand#1')
    AND sample_id IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 490000)""")
def _(v):
    panel = v.fx_panel.where(F.col("gene") == "Brand#1")
    matched = v.orders.where(F.col("o_totalprice") > 490000).select(F.col("o_orderpriority").alias("sample_id"))
    return filters.usable_samples(v.fx_obs.select("sample_id").distinct(), v.fx_expr, panel, matched)


# -- joins --------------------------------------------------------------------


@query("joi_01_transcripts_cells", "SELECT mol_id, t.cell_id, feature_name FROM fx_transcripts t JOIN fx_cells c ON t.cell_id = c.cell_id")
def _(v):
    return counting.keep_cells(v.fx_transcripts, v.fx_cells).select("mol_id", "cell_id", "feature_name")


@query("joi_02_transcripts_panel", "SELECT mol_id, cell_id, feature_name AS gene FROM fx_transcripts WHERE feature_name IN (SELECT gene FROM fx_panel)")
def _(v):
    return counting.keep_panel(v.fx_transcripts, v.fx_panel).select("mol_id", "cell_id", "gene")


@query("joi_03_tiles_obs", f"""SELECT CAST(sample_no AS VARCHAR) AS sample_id, concat('s', CAST(spot_id AS VARCHAR)) AS barcode, {R('center_x', 'x')} FROM fx_spots""")
def _(v):
    tiles = v.fx_spots.select(F.col("sample_no").cast("string").alias("sample_id"), F.concat(F.lit("s"), F.col("spot_id").cast("string")).alias("barcode"),
                              F.col("spot_id").alias("patch_idx"), F.col("center_x").alias("x"))
    obs = v.fx_spots.select(
        F.col("sample_no").cast("string").alias("sample_id"), F.concat(F.lit("s"), F.col("spot_id").cast("string")).alias("barcode"))
    return cell_jobs.join_tiles(tiles, obs).select("sample_id", "barcode", r6("x"))


@query("joi_04_align_to_panel", f"""
WITH p AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, gene FROM fx_panel), o AS (SELECT DISTINCT sample_id, obs_id FROM fx_expr)
SELECT o.sample_id, o.obs_id, CAST(p.pos AS BIGINT) AS pos, p.gene, {R('coalesce(e.cnt, 0)', 'cnt')} FROM o CROSS JOIN p LEFT JOIN fx_expr e ON e.sample_id = o.sample_id AND e.obs_id = o.obs_id AND e.gene = p.gene""")
def _(v):
    return panels.align_to_panel(v.fx_expr, v.fx_panel, ["sample_id", "obs_id"]).select("sample_id", "obs_id", "pos", "gene", r6("cnt"))


@query("joi_05_nearest_grid_center", f"WITH {HIT_SQL.format(cells='fx_cells')} SELECT cell_id, grid_row, grid_col, {R('center_x')}, {R('center_y')} FROM h")
def _(v):
    hits = spatial.nearest_grid_center(v.fx_cells, GRID.radius, GRID.spacing, GRID.layout)
    return hits.select("cell_id", "grid_row", "grid_col", r6("center_x"), r6("center_y"))


@query("joi_06_nearest_within_radius", f"WITH {NEAR_SQL} SELECT cell_id, spot_id, {R('distance')} FROM a")
def _(v):
    return spatial.nearest_within_radius(v.fx_cells, v.fx_spots, 60.0).select("cell_id", "spot_id", r6("distance"))


PATCH_SQL = """o AS (SELECT cell_id, i * 16 + j AS patch_idx,
    greatest(least(x0 + w, (j + 1) * 14) - greatest(x0, j * 14), 0) * greatest(least(y0 + h, (i + 1) * 14) - greatest(y0, i * 14), 0) AS overlap_area
    FROM fx_polygons, (SELECT range AS i FROM range(16)), (SELECT range AS j FROM range(16))
    WHERE x0 <= (j + 1) * 14 AND x0 + w >= j * 14 AND y0 <= (i + 1) * 14 AND y0 + h >= i * 14)"""


def overlaps(v):
    return spatial.polygon_patch_overlap(v.fx_polygons.select("cell_id", ring()))


@query("joi_07_polygon_patch_overlap", f"WITH {PATCH_SQL} SELECT cell_id, CAST(patch_idx AS BIGINT) AS patch_idx, {R('overlap_area')} FROM o")
def _(v):
    return overlaps(v).select("cell_id", "patch_idx", r6("overlap_area"))


@query("joi_11_skip_completed", "SELECT fold, platform FROM fx_fold_metrics WHERE fold NOT IN (SELECT s_nationkey FROM supplier)")
def _(v):
    done = v.supplier.select(F.col("s_nationkey").alias("fold")).distinct()
    return splits.skip_completed(v.fx_fold_metrics, done).select("fold", "platform")


@query("joi_12_split_by_samples", "SELECT cell_id, CASE WHEN sample_id IN ('1-URGENT', '2-HIGH') THEN 'test' ELSE 'train' END AS split FROM fx_cells WHERE sample_id <> '5-LOW'")
def _(v):
    pick = lambda *names: v.fx_cells.where(F.col("sample_id").isin(*names)).select("sample_id").distinct()
    split = splits.two_set_split(v.fx_cells, pick("1-URGENT", "2-HIGH"), pick("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"))
    return splits.require_both_sides(split).select("cell_id", "split")


@query("joi_13_attach_geometry", f"""SELECT cell_id, technology, {R('w * h', 'area_px2')}, {R('x0 + w / 2', 'centroid_x')}, {R('y0 + h / 2', 'centroid_y')}
    FROM fx_polygons JOIN fx_cells USING (cell_id)""")
def _(v):
    chosen = v.fx_polygons.select("cell_id", "technology")
    outlines = v.fx_polygons.join(v.fx_cells.select("cell_id"), "cell_id").select("cell_id", ring())
    return spatial.attach_geometry(chosen, outlines).select("cell_id", "technology", r6("area_px2"), r6("centroid_x"), r6("centroid_y"))


@query("joi_14_attach_totals", "SELECT sample_id, count(*) AS n, CASE WHEN sample_id = '5-LOW' THEN NULL ELSE count(*) * 2 END AS total_available_cells FROM fx_cells GROUP BY sample_id")
def _(v):
    kept = v.fx_cells.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    totals = kept.where(F.col("sample_id") != "5-LOW").select("sample_id", (F.col("n") * 2).alias("total"))
    return gap.attach_totals(kept, totals)


# -- counting -----------------------------------------------------------------


@query("agg_01_cell_gene_counts", f"WITH {COUNTS_SQL} SELECT cell_id, gene, cnt FROM c")
def _(v):
    return counted(v)


@query("agg_02_cell_qc", f"WITH {COUNTS_SQL} SELECT cell_id, CAST(sum(cnt) AS BIGINT) AS transcript_count FROM c GROUP BY cell_id")
def _(v):
    return counting.cell_qc(counted(v))


FULL_SPOT_SQL = KEPT_SQL + "," + HIT_SQL.format(cells="k") + "," + SPOT_SQL + """,
    m AS (SELECT n.spot_id, h.cell_id FROM h JOIN n USING (grid_row, grid_col)),
    sc AS (SELECT spot_id, gene, CAST(sum(cnt) AS BIGINT) AS cnt FROM m JOIN c USING (cell_id) GROUP BY spot_id, gene)"""


def spot_tables(v):
    t = cell_jobs.prepare_cells(v.fx_transcripts, v.fx_cells)
    return cell_jobs.build_pseudospots(t.cells, t.counts, GRID)


@query("agg_03_pseudospot_counts", f"WITH {FULL_SPOT_SQL} SELECT spot_id, gene, cnt FROM sc")
def _(v):
    return spot_tables(v).counts


@query("agg_04_pseudospot_qc", f"""WITH {FULL_SPOT_SQL} SELECT n.spot_id, n.cell_count, CAST(sum(cnt) AS BIGINT) AS transcript_count, count(*) AS n_genes_by_counts
    FROM n JOIN sc USING (spot_id) GROUP BY n.spot_id, n.cell_count""")
def _(v):
    return spot_tables(v).spots.select("spot_id", "cell_count", "transcript_count", "n_genes_by_counts")


@query("agg_05_extent", f"SELECT sample_id, {R('min(centroid_x)', 'x_min')}, {R('max(centroid_x)', 'x_max')}, {R('min(centroid_y)', 'y_min')}, {R('max(centroid_y)', 'y_max')} FROM fx_cells GROUP BY sample_id")
def _(v):
    return spatial.extent(v.fx_cells, by=("sample_id",)).select("sample_id", *[r6(c) for c in ("x_min", "x_max", "y_min", "y_max")])


@query("agg_06_fold_sizes", f"WITH {FOLD_SQL.format(t='fx_cells')} SELECT concat('fold_', CAST(fold AS VARCHAR)) AS fold_key, count(*) AS n FROM f GROUP BY fold")
def _(v):
    return splits.fold_sizes(splits.position_folds(v.fx_cells, "centroid_x", 5))


@query("agg_07_aggregate_cells_to_spots", f"""
WITH {NEAR_SQL}, t AS (SELECT spot_id, gene, sum(exp(ln(1 + cnt)) - 1) AS s FROM a JOIN fx_expr ON cell_id = obs_id GROUP BY spot_id, gene), g AS (SELECT DISTINCT gene FROM t)
SELECT p.spot_id, g.gene, {R('ln(1 + coalesce(s, 0))', 'pred', 5)} FROM fx_spots p CROSS JOIN g LEFT JOIN t ON t.spot_id = p.spot_id AND t.gene = g.gene""")
def _(v):
    pred = v.fx_expr.select(F.col("obs_id").alias("cell_id"), "gene", scalars.log1p_counts("cnt").alias("pred"))
    assigned = spatial.nearest_within_radius(v.fx_cells, v.fx_spots, 60.0)
    return retrieval.aggregate_cells_to_spots(pred, assigned, v.fx_spots).select("spot_id", "gene", r6("pred", digits=5))


# -- windows, sorts, samples --------------------------------------------------


@query("win_01_position_folds", f"WITH {FOLD_SQL.format(t='fx_cells')} SELECT cell_id, fold FROM f")
def _(v):
    return splits.position_folds(v.fx_cells, "centroid_x", 5).select("cell_id", "fold")


@query("win_02_reindex", f"WITH {HIT_SQL.format(cells='fx_cells')}, {SPOT_SQL} SELECT spot_id, grid_row, grid_col FROM n")
def _(v):
    hits = spatial.nearest_grid_center(v.fx_cells, GRID.radius, GRID.spacing, GRID.layout)
    sizes = hits.groupBy("grid_row", "grid_col").agg(F.count(F.lit(1)).alias("cell_count"))
    return spatial.number_spots(filters.having_min_cells(sizes, 3)).select("spot_id", "grid_row", "grid_col")


@query("win_03_membership_offsets", """
WITH m AS (SELECT o_custkey AS spot_id, o_orderkey AS cell_id FROM orders)
SELECT spot_id, cell_id, CAST(row_number() OVER (PARTITION BY spot_id ORDER BY cell_id) - 1 AS BIGINT) AS ord, CAST(s.spot_start AS BIGINT) AS spot_start FROM m JOIN
  (SELECT spot_id, coalesce(sum(n) OVER (ORDER BY spot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot_start FROM (SELECT spot_id, count(*) AS n FROM m GROUP BY spot_id)) s USING (spot_id)""")
def _(v):
    return spatial.membership_order(v.orders.select(F.col("o_custkey").alias("spot_id"), F.col("o_orderkey").alias("cell_id"))).select("spot_id", "cell_id", "ord", "spot_start")


@query("win_04_head_per_group", "SELECT sample_id, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY cell_id) AS r FROM fx_cells) WHERE r <= 50")
def _(v):
    return ranking.head_per_group(v.fx_cells, ["sample_id"], ["cell_id"], 50).select("sample_id", "cell_id")


PIXEL_SQL = """p AS (SELECT crop_id, y, x, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b, (r / 255e0 + g / 255e0 + b / 255e0) / 3e0 AS gray FROM fx_pixels),
    gr AS (SELECT *, sqrt(power(coalesce(gray - lag(gray) OVER (PARTITION BY crop_id, y ORDER BY x), 0), 2) + power(coalesce(gray - lag(gray) OVER (PARTITION BY crop_id, x ORDER BY y), 0), 2)) AS gradient FROM p)"""


@query("win_06_pixel_gradient", f"WITH {PIXEL_SQL} SELECT crop_id, y, x, {R('gray')}, {R('gradient')} FROM gr")
def _(v):
    return gap.pixel_gradient(v.fx_pixels).select("crop_id", "y", "x", r6("gray"), r6("gradient"))


@query("win_07_metric_delta", f"""
WITH m AS (SELECT run AS model, epoch AS stage, avg(loss) AS avg_loss, CAST(max(n) AS DOUBLE) AS top_n FROM fx_batches GROUP BY run, epoch),
     l AS (SELECT model, stage, 'avg_loss' AS metric, avg_loss AS value FROM m UNION ALL SELECT model, stage, 'top_n', top_n FROM m)
SELECT model, metric, {R('max(CASE WHEN stage = 30 THEN value END) - max(CASE WHEN stage = 1 THEN value END)', 'delta')} FROM l GROUP BY model, metric
HAVING max(CASE WHEN stage = 30 THEN value END) - max(CASE WHEN stage = 1 THEN value END) IS NOT NULL""")
def _(v):
    m = v.fx_batches.groupBy(F.col("run").alias("model"), F.col("epoch").alias("stage")).agg(F.avg("loss").alias("avg_loss"), F.max("n").cast("double").alias("top_n"))
    return metrics.metric_delta(m, 1, 30, ["avg_loss", "top_n"], ["model"]).select("model", "metric", r6("delta"))


@query("win_08_history_curves", f"""
WITH a AS (SELECT run, epoch, sum(loss * n) / greatest(sum(n), 1) AS l FROM fx_batches WHERE n > 1 GROUP BY run, epoch), b AS (SELECT run, epoch, sum(loss * n) / greatest(sum(n), 1) AS l FROM fx_batches WHERE n = 1 AND epoch > 3 GROUP BY run, epoch)
SELECT coalesce(a.run, b.run) AS run, coalesce(a.epoch, b.epoch) AS epoch, {R('a.l', 'train_loss')}, {R('b.l', 'test_loss')} FROM a FULL OUTER JOIN b ON a.run = b.run AND a.epoch = b.epoch""")
def _(v):
    rows = v.fx_batches
    train = metrics.weighted_mean(rows.where(F.col("n") > 1), "loss", "n", ["run", "epoch"], "train_loss")
    test = metrics.weighted_mean(rows.where((F.col("n") == 1) & (F.col("epoch") > 3)), "loss", "n", ["run", "epoch"], "test_loss")
    return metrics.history_curves(train, test, ["run"]).select("run", "epoch", r6("train_loss"), r6("test_loss"))


AUC_SQL = """r AS (SELECT {g} s, y, rank() OVER ({p} ORDER BY s) + (count(*) OVER (PARTITION BY {g} s) - 1) / 2e0 AS rk FROM t)"""


@query("win_09_auc_by_rank", f"""
WITH t AS (SELECT l_discount * 100 + l_tax AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_linestatus AS g FROM lineitem), {AUC_SQL.format(g='g,', p='PARTITION BY g')}
SELECT g, {R('(sum(CASE WHEN y = 1 THEN rk END) - count(CASE WHEN y = 1 THEN 1 END) * (count(CASE WHEN y = 1 THEN 1 END) + 1e0) / 2e0) / (count(CASE WHEN y = 1 THEN 1 END) * count(CASE WHEN y = 0 THEN 1 END))', 'auc')} FROM r GROUP BY g""")
def _(v):
    t = v.lineitem.select((F.col("l_discount") * 100 + F.col("l_tax")).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_linestatus").alias("g"))
    return ranking.auc_by_rank(t, group=["g"]).select("g", r6("auc"))


@query("srt_02_top_shifted_genes", f"""
WITH m AS (SELECT gene, abs(avg(CASE WHEN technology = 'Visium' THEN cnt END) - avg(CASE WHEN technology = 'Xenium' THEN cnt END)) AS abs_mean_diff, CAST(count(*) AS DOUBLE) AS abs_detect_diff FROM fx_expr GROUP BY gene)
SELECT gene, {R('abs_mean_diff')} FROM m ORDER BY m.abs_mean_diff DESC, m.abs_detect_diff DESC, gene LIMIT 12""")
def _(v):
    side = lambda t: F.avg(F.when(F.col("technology") == t, F.col("cnt")))
    m = v.fx_expr.groupBy("gene").agg(F.abs(side("Visium") - side("Xenium")).alias("abs_mean_diff"), F.count(F.lit(1)).cast("double").alias("abs_detect_diff"))
    return gap.top_shifted_genes(m, 12).select("gene", r6("abs_mean_diff"))


@query("srt_03_sample_n", "SELECT cell_id FROM (SELECT cell_id FROM fx_cells ORDER BY md5(concat(CAST(cell_id AS VARCHAR), '|7')), cell_id LIMIT 300)")
def _(v):
    return splits.sample_n(v.fx_cells, 300, 7, "cell_id").select("cell_id").orderBy("cell_id")


@query("srt_04_sample_per_stratum", """
SELECT id, platform, side FROM (SELECT *, row_number() OVER (PARTITION BY platform, side ORDER BY md5(concat(CAST(id AS VARCHAR), '|3')), id) AS r FROM fx_embed)
WHERE r <= CASE WHEN platform = 'visium' AND side = 'bank' THEN 40 WHEN platform = 'xenium' AND side = 'query' THEN 15 ELSE 1000000 END""")
def _(v):
    caps = {("visium", "bank"): 40, ("xenium", "query"): 15, ("xenium", "bank"): 0}
    return splits.sample_per_stratum(v.fx_embed, ["platform", "side"], caps, 3, "id").select("id", "platform", "side")


STAGE_CASE = "CASE (cell_id % 9) " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STAGE_ORDER)) + " ELSE 'other' END"


@query("srt_05_stage_order", f"SELECT CAST(cell_id % 9 + 1 AS INT) AS stage_pos, {STAGE_CASE} AS stage, sample_id AS model, count(*) AS n FROM fx_cells GROUP BY ALL")
def _(v):
    stage = F.get(F.array(*[F.lit(s) for s in (*STAGE_ORDER, "other")]), (F.col("cell_id") % 9).cast("int"))
    rows = v.fx_cells.groupBy(stage.alias("stage"), F.col("sample_id").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.stage_order(rows, STAGE_ORDER).select(F.col("stage_pos").cast("int").alias("stage_pos"), "stage", "model", "n")


# -- sets ---------------------------------------------------------------------

PANEL_ROWS = "(SELECT sample_no, gene, CAST(substr(gene, 7) AS BIGINT) AS pos FROM fx_panels)"


def panel_rows(v):
    return v.fx_panels.withColumn("pos", F.substring("gene", 7, 3).cast("long"))


@query("set_01_shared_genes", f"""SELECT max(CASE WHEN sample_no = 0 THEN pos END) AS pos, gene FROM {PANEL_ROWS} GROUP BY gene
    HAVING count(DISTINCT sample_no) = (SELECT count(DISTINCT sample_no) FROM fx_panels)""")
def _(v):
    return panels.shared_genes(panel_rows(v), 0, remove_control=True, sample="sample_no")


@query("set_02_overlap_genes", f"SELECT pos, gene FROM fx_panel WHERE gene IN (SELECT gene FROM fx_panels WHERE sample_no = 1)")
def _(v):
    return panels.require_rows(panels.overlap_genes(v.fx_panel, v.fx_panels.where(F.col("sample_no") == 1)), "no overlap")


@query("set_03_joint_bank", """
SELECT id, 'visium' AS source, 0 AS platform_id FROM fx_embed WHERE platform = 'visium' AND side = 'bank'
UNION ALL SELECT id, 'xenium', 1 FROM fx_embed WHERE platform = 'xenium' AND side = 'bank'""")
def _(v):
    bank = v.fx_embed.where(F.col("side") == "bank")
    joint = panels.joint_bank({p: bank.where(F.col("platform") == p).select("id") for p in PLATFORM_CODES}, PLATFORM_CODES)
    return panels.evaluation_bank(joint, "joint", "visium").select("id", "source", "platform_id")


@query("set_04_stack_frames", f"SELECT id, platform, NULL AS side FROM fx_embed WHERE platform = 'visium' UNION ALL SELECT id, platform, side FROM fx_embed WHERE platform = 'xenium'")
def _(v):
    e = v.fx_embed
    return panels.stack_frames([e.where(F.col("platform") == "visium").select("id", "platform"), e.where(F.col("platform") == "xenium").select("id", "platform", "side")])


@query("set_05_sample_list_except", """
WITH s AS (SELECT DISTINCT sample_id FROM fx_cells), n AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS INT) AS fold_index FROM s)
SELECT n.fold_index, n.sample_id AS held_out, s.sample_id, CASE WHEN s.sample_id = n.sample_id THEN 'test' ELSE 'train' END AS role FROM n CROSS JOIN s""")
def _(v):
    return splits.leave_one_out_plan(v.fx_cells.select("sample_id").distinct())


@query("set_06_distinct_keep_order", "SELECT p_type AS value, min(p_partkey) AS pos FROM part GROUP BY p_type")
def _(v):
    return panels.distinct_keep_order(v.part.select(F.col("p_type").alias("value"), F.col("p_partkey").alias("pos")), "value")


WIDE = ["Brand#1", "Brand#2", "Brand#4"]
WIDE_SQL = "SELECT obs_id, " + ", ".join(f"CAST(coalesce(max(CASE WHEN gene = '{g}' THEN cnt END), 0) AS BIGINT) AS \"{g}\"" for g in WIDE) + " FROM fx_expr GROUP BY obs_id"


@query("set_07_to_long", f"WITH w AS ({WIDE_SQL}) " + " UNION ALL ".join(f"SELECT obs_id, '{g}' AS gene, \"{g}\" AS expression FROM w" for g in WIDE))
def _(v):
    wide = panels.to_wide(v.fx_expr, ["obs_id"], WIDE)
    return panels.wide_to_long(wide, ["obs_id"], WIDE)


@query("set_08_to_dense", f"""
WITH p AS (SELECT row_number() OVER (ORDER BY pos) AS slot, gene FROM fx_panel), o AS (SELECT DISTINCT obs_id FROM fx_expr)
SELECT o.obs_id, CAST(count(*) AS INT) AS width, {R('sum(p.slot * coalesce(e.cnt, 0))', 'weighted', 4)} FROM o CROSS JOIN p LEFT JOIN fx_expr e ON e.obs_id = o.obs_id AND e.gene = p.gene GROUP BY o.obs_id""")
def _(v):
    dense = panels.to_dense(v.fx_expr, v.fx_panel, ["obs_id"])
    slots = F.transform("expression", lambda x, i: x * (i + 1))
    return dense.select("obs_id", F.size("expression").alias("width"), r6(F.aggregate(slots, F.lit(0.0), lambda a, x: a + x), "weighted", 4))


@query("set_09_rename_for_compare", """SELECT spot_id AS obs_name, 'pseudospot' AS source, spot_id % 5 AS total_counts, CAST(NULL AS BIGINT) AS n_genes_by_counts, spot_id % 3 AS cell_count FROM fx_spots
    UNION ALL SELECT spot_id, 'native', spot_id % 7, CAST(NULL AS BIGINT), NULL FROM fx_spots""")
def _(v):
    s, k = v.fx_spots, F.col("spot_id")
    a = s.select("spot_id", (k % 5).alias("transcript_count"), (k % 3).alias("cell_count"))
    b = s.select(k.alias("obs_name"), (k % 7).alias("n_counts"))
    return panels.stack_frames([panels.rename_for_compare(a, "pseudospot"), panels.rename_for_compare(b, "native")])


# -- scalar functions ---------------------------------------------------------


@query("scl_01_log1p_counts", f"SELECT obs_id, gene, {R('ln(1 + greatest(cnt - 20, 0))', 'v')} FROM fx_expr")
def _(v):
    return v.fx_expr.select("obs_id", "gene", r6(scalars.normalize(F.col("cnt") - 20, "log1p"), "v"))


@query("scl_02_log1p_cpm", f"""
WITH a AS (SELECT obs_id, gene, cnt, 'all' AS scope, sum(cnt) OVER (PARTITION BY obs_id) AS t FROM fx_expr), b AS (SELECT obs_id, gene, cnt, 'panel' AS scope, sum(cnt) OVER (PARTITION BY obs_id) AS t FROM fx_expr WHERE gene IN (SELECT gene FROM fx_panel)),
u AS (SELECT * FROM a WHERE gene IN (SELECT gene FROM fx_panel) UNION ALL SELECT * FROM b)
SELECT obs_id, gene, scope, {R('ln(1 + cnt / t * 1e6)', 'v')} FROM u""")
def _(v):
    both = [normalization.normalize_long(v.fx_expr, ["obs_id"], "log1p_cpm", panel=v.fx_panel, total_scope=s).withColumn("scope", F.lit(s)) for s in ("all", "panel")]
    return panels.stack_frames(both).select("obs_id", "gene", "scope", r6("norm", "v"))


@query("scl_03_log1p_cp10k", f"SELECT obs_id, gene, {R('ln(1 + cnt / sum(cnt) OVER (PARTITION BY obs_id) * 1e4)', 'v')} FROM fx_expr")
def _(v):
    return normalization.normalize_long(v.fx_expr, ["obs_id"], "cp10k").select("obs_id", "gene", r6("norm", "v"))


@query("scl_04_expm1", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('exp(l_discount) - 1', 'v')} FROM lineitem")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", r6(scalars.undo_log1p("l_discount"), "v"))


META = "(SELECT s_suppkey AS k, 0.25e0 + s_nationkey / 100e0 AS pixel, 50e0 + s_suppkey % 10 AS diameter, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 100e0 END AS gap FROM supplier)"


@query("scl_05_px", f"SELECT k, {R('diameter / pixel / 2', 'radius')}, {R('coalesce(gap, diameter) / pixel', 'spacing')} FROM {META}")
def _(v):
    k = F.col("s_suppkey")
    m = v.supplier.select(k.alias("k"), (F.lit(0.25) + F.col("s_nationkey") / F.lit(100.0)).alias("pixel"), (F.lit(50.0) + k % 10).alias("diameter"),
                          F.when(k % 3 != 0, F.lit(100.0)).alias("gap"))
    return m.select("k", r6(scalars.spot_radius_px("diameter", "pixel"), "radius"), r6(scalars.spacing_px("gap", "diameter", "pixel"), "spacing"))


@query("scl_06_grid_layout", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'square' WHEN c_mktsegment = 'BUILDING' THEN 'hex' ELSE 'square' END AS layout FROM customer")
def _(v):
    asked = F.when(F.col("c_custkey") % 3 == 0, " Square ").otherwise("AUTO")
    tech = F.when(F.col("c_mktsegment") == "BUILDING", "Visium HD").otherwise("Other")
    return v.customer.select("c_custkey", scalars.grid_layout(asked, tech).alias("layout"))


@query("scl_07_grid_centers", f"""
WITH e AS (SELECT sample_id, min(centroid_x) AS x0, max(centroid_x) AS x1, min(centroid_y) AS y0, max(centroid_y) AS y1 FROM fx_cells GROUP BY sample_id),
r AS (SELECT *, x0 + CASE WHEN grid_row % 2 = 0 THEN 0e0 ELSE 100e0 END AS sx FROM (SELECT e.*, unnest(range(0, CAST(floor((y1 + 55e0 - y0) / (200e0 * sqrt(3e0) / 2e0)) + 1 AS BIGINT))) AS grid_row FROM e)),
c AS (SELECT *, unnest(range(0, CAST(floor((x1 + 55e0 - sx) / 200e0) + 1 AS BIGINT))) AS grid_col FROM r)
SELECT sample_id, grid_row, grid_col, {R('sx + grid_col * 200e0', 'center_x')}, {R('y0 + grid_row * (200e0 * sqrt(3e0) / 2e0)', 'center_y')} FROM c""")
def _(v):
    c = spatial.grid_centers(spatial.extent(v.fx_cells, by=("sample_id",)), GRID.radius, GRID.spacing, GRID.layout)
    return c.select("sample_id", "grid_row", "grid_col", r6("center_x"), r6("center_y"))


@query("scl_08_crop_window", """
WITH s AS (SELECT cell_id, centroid_x, centroid_y, greatest(CAST(round_even((40 + cell_id % 30) / 0.5e0, 0) AS BIGINT), 1) AS size FROM fx_cells)
SELECT cell_id, size, CAST(round_even(centroid_x - size / 2e0, 0) AS BIGINT) AS x_left, CAST(round_even(centroid_y - size / 2e0, 0) AS BIGINT) AS y_top FROM s""")
def _(v):
    s = v.fx_cells.withColumn("size", scalars.crop_size_px((F.col("cell_id") % 30 + 40).cast("double"), scalars.dbl(0.5)))
    return s.select("cell_id", "size", scalars.crop_origin("centroid_x", "size").alias("x_left"), scalars.crop_origin("centroid_y", "size").alias("y_top"))


@query("scl_09_decode_name", "SELECT p_partkey, p_name AS name FROM part")
def _(v):
    return v.part.select("p_partkey", scalars.decode_name(F.encode("p_name", "UTF-8")).alias("name"))


@query("scl_10_polygon_centroid_bbox", BOX_SQL)
def _(v):
    return gap.polygon_metadata(v.fx_polygons.select("cell_id", ring())).select("cell_id", *[r6(c) for c in BOX])


SHAPE_SQL = {
    "area_px2": "w * h", "area_um2": "w * h * 0.25e0", "perimeter_px": "2 * (w + h)", "perimeter_um": "(w + h)", "bbox_width_px": "w", "bbox_height_px": "h",
    "bbox_width_um": "w / 2", "bbox_height_um": "h / 2", "aspect_ratio": "w / h", "fill_ratio": "1", "equivalent_diameter_um": "sqrt(w * h * 4 / pi()) / 2"}


@query("scl_11_polygon_stats", "SELECT cell_id, " + ", ".join(R(e, n) for n, e in SHAPE_SQL.items()) + " FROM fx_polygons")
def _(v):
    return gap.polygon_stats(v.fx_polygons.select("cell_id", ring()), 0.5).select("cell_id", *[r6(c) for c in SHAPE_SQL])


@query("scl_12_crop_stats", f"""WITH {PIXEL_SQL} SELECT crop_id, {R('avg(r)', 'crop_r_mean')}, {R('stddev_pop(r)', 'crop_r_std')}, {R('avg(gray)', 'gray_mean')}, {R('stddev_pop(gray)', 'gray_std')},
    {R('avg(gradient)', 'gradient_mean')}, {R('stddev_pop(gradient)', 'gradient_std')} FROM gr GROUP BY crop_id""")
def _(v):
    s = gap.crop_stats(gap.pixel_gradient(v.fx_pixels))
    return s.select("crop_id", *[r6(c) for c in ("crop_r_mean", "crop_r_std", "gray_mean", "gray_std", "gradient_mean", "gradient_std")])


@query("scl_13_parse_id_list", "SELECT p_partkey, i AS item, CASE WHEN i = 0 THEN p_type ELSE p_brand END AS value FROM part, (SELECT unnest([0, 1]) AS i)")
def _(v):
    line = F.concat(F.lit(" , "), "p_type", F.lit(" ,, "), "p_brand", F.lit(","))
    return v.part.select("p_partkey", F.posexplode(scalars.parse_id_list(line)).alias("item", "value"))


@query("scl_14_fold_label_barcode", "SELECT s_suppkey, printf('fold_%02d', s_nationkey) AS label, concat('visium_', CAST(s_suppkey AS VARCHAR)) AS barcode FROM supplier")
def _(v):
    return v.supplier.select("s_suppkey", scalars.fold_label("s_nationkey").alias("label"), scalars.spot_barcode(F.lit("visium"), "s_suppkey").alias("barcode"))


@query("scl_15_finite_or_null", f"SELECT event_id, CASE WHEN event_id % 4 = 0 THEN round(value, 6) + 0e0 END AS v FROM events")
def _(v):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "NaN").when(k == 2, "Infinity").otherwise("n/a")
    return v.events.select("event_id", r6(scalars.finite_or_null(text), "v"))


@query("scl_16_depth_tokens", f"""SELECT o_orderkey, {R('log10(greatest(o_totalprice, 1))', 'source')}, {R("CASE o_orderkey % 4 WHEN 0 THEN log10(greatest(o_totalprice, 1)) WHEN 1 THEN log10(greatest(o_totalprice, 1) * 2.5) WHEN 2 THEN log10(greatest(o_totalprice, 1)) + 1.5 ELSE 4.0 END", 'target')} FROM orders""")
def _(v):
    spec = F.get(F.array(F.lit(""), F.lit("f2.5"), F.lit("a1.5"), F.lit("t4.0")), (F.col("o_orderkey") % 4).cast("int"))
    return v.orders.select("o_orderkey", r6(scalars.source_depth("o_totalprice"), "source"), r6(scalars.target_depth("o_totalprice", spec), "target"))
