"""Whole jobs and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.catalog.basics import FOLD_SQL, FULL_SPOT_SQL, KEPT_SQL, spot_tables
from spotloom.catalog.core import R, query, r6
from spotloom.catalog.gaps import SUMMARY_SQL, TECHS
from spotloom.catalog.scoring import summary_columns, summary_sql
from spotloom.catalog.sources import ring, write_10x, write_logs
from spotloom.catalog.vectors import ASK, PRED_SQL, match_sql, sides
from spotloom.operators import metrics, neighbors, normalization, panels
from spotloom.plans import cells as cell_jobs, evaluation, reports
from spotloom.session import scratch_path
from spotloom.sources import tables
from spotloom.streaming import molecules


@query("job_01_prepare_cells", f"WITH {KEPT_SQL}, {FOLD_SQL.format(t='k')} SELECT cell_id, transcript_count, fold AS position_fold FROM f")
def _(v):
    return cell_jobs.prepare_cells(v.fx_transcripts, v.fx_cells).cells.select("cell_id", "transcript_count", "position_fold")


@query("job_01_panel", """SELECT feature_name AS gene, CAST(min(mol_id) AS BIGINT) AS pos FROM fx_transcripts
    WHERE NOT starts_with(feature_name, 'BLANK_') GROUP BY feature_name""")
def _(v):
    return cell_jobs.prepare_cells(v.fx_transcripts, v.fx_cells, order="mol_id").panel.select("gene", F.col("pos").cast("long").alias("pos"))


@query("job_02_build_pseudospots", f"""
WITH {FULL_SPOT_SQL}, qc AS (SELECT n.spot_id, n.center_x AS centroid_x, n.cell_count, n.grid_row, n.grid_col, CAST(sum(cnt) AS BIGINT) AS transcript_count, count(*) AS n_genes_by_counts
   FROM (SELECT n.*, (SELECT any_value(center_x) FROM h WHERE h.grid_row = n.grid_row AND h.grid_col = n.grid_col) AS center_x FROM n) n JOIN sc USING (spot_id) GROUP BY ALL),
{FOLD_SQL.format(t='qc')}
SELECT spot_id, grid_row, grid_col, {R('centroid_x', 'center_x')}, cell_count, transcript_count, n_genes_by_counts, fold AS position_fold FROM f""")
def _(v):
    return spot_tables(v).spots.select("spot_id", "grid_row", "grid_col", r6("center_x"), "cell_count", "transcript_count", "n_genes_by_counts", "position_fold")


@query("job_02_membership", f"""
WITH {FULL_SPOT_SQL}, mm AS (SELECT n.spot_id, h.cell_id FROM h JOIN n USING (grid_row, grid_col)),
z AS (SELECT spot_id, sum(count(*)) OVER (ORDER BY spot_id) - count(*) AS spot_start FROM mm GROUP BY spot_id)
SELECT spot_id, cell_id, row_number() OVER (PARTITION BY spot_id ORDER BY cell_id) - 1 AS ord, CAST(spot_start AS BIGINT) AS spot_start FROM mm JOIN z USING (spot_id)""")
def _(v):
    return spot_tables(v).membership.select("spot_id", "cell_id", F.col("ord").cast("long").alias("ord"), F.col("spot_start").cast("long").alias("spot_start"))


KEYED_FOLD_SQL = """b AS (SELECT sample_id, min({x}) AS lo, max({x}) AS hi FROM {t} GROUP BY sample_id),
    f AS (SELECT {t}.*, CASE WHEN hi = lo THEN 0 ELSE CAST(({x} >= lo + 1 * ((hi - lo) / 5)) AS INT) + CAST(({x} >= lo + 2 * ((hi - lo) / 5)) AS INT)
      + CAST(({x} >= lo + 3 * ((hi - lo) / 5)) AS INT) + CAST(({x} >= lo + 4 * ((hi - lo) / 5)) AS INT) END AS fold FROM {t} JOIN b USING (sample_id))"""


def sampled_molecules(v):
    return v.fx_transcripts.join(v.fx_cells.select("cell_id", "sample_id"), "cell_id")


@query("job_01_all_samples", f"WITH {KEPT_SQL}, {KEYED_FOLD_SQL.format(t='k', x='centroid_x')} SELECT sample_id, cell_id, transcript_count, fold AS position_fold FROM f")
def _(v):
    t = cell_jobs.prepare_cells(sampled_molecules(v), v.fx_cells, by=("sample_id",))
    return t.cells.select("sample_id", "cell_id", "transcript_count", "position_fold")


# Each sample has a grid over its own extent: the text of one grid, with the sample as a key.
KEYED_SPOT_SQL = KEPT_SQL + """,
    e AS (SELECT sample_id, min(centroid_x) AS x0, max(centroid_x) AS x1, min(centroid_y) AS y0, max(centroid_y) AS y1 FROM k GROUP BY sample_id),
    q AS (SELECT k.cell_id, k.centroid_x AS x, k.centroid_y AS y, e.*, CAST(round_even((k.centroid_y - y0) / 200e0, 0) AS BIGINT) AS grid_row, CAST(round_even((k.centroid_x - x0) / 200e0, 0) AS BIGINT) AS grid_col FROM k JOIN e USING (sample_id)),
    d AS (SELECT *, least(greatest(grid_row, 0), floor((y1 + 55e0 - y0) / 200e0)) AS r, least(greatest(grid_col, 0), floor((x1 + 55e0 - x0) / 200e0)) AS c FROM q),
    h AS (SELECT sample_id, cell_id, CAST(r AS BIGINT) AS grid_row, CAST(c AS BIGINT) AS grid_col, x0 + c * 200e0 AS center_x FROM d WHERE r = grid_row AND (x - x0 - c * 200e0) * (x - x0 - c * 200e0) + (y - y0 - r * 200e0) * (y - y0 - r * 200e0) <= 55e0 * 55e0),
    s AS (SELECT sample_id, grid_row, grid_col, any_value(center_x) AS center_x, count(*) AS cell_count FROM h GROUP BY sample_id, grid_row, grid_col HAVING count(*) >= 3),
    n AS (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY grid_row, grid_col) - 1 AS BIGINT) AS spot_id FROM s),
    m AS (SELECT n.sample_id, n.spot_id, h.cell_id FROM h JOIN n USING (sample_id, grid_row, grid_col)),
    tc AS (SELECT m.sample_id, m.spot_id, CAST(sum(cnt) AS BIGINT) AS transcript_count FROM m JOIN c USING (cell_id) GROUP BY ALL)"""


@query("job_02_all_samples", f"WITH {KEYED_SPOT_SQL}, z AS (SELECT n.*, transcript_count FROM n JOIN tc USING (sample_id, spot_id)), {KEYED_FOLD_SQL.format(t='z', x='center_x')} SELECT sample_id, spot_id, grid_row, grid_col, cell_count, transcript_count, fold AS position_fold FROM f")
def _(v):
    t = cell_jobs.prepare_cells(sampled_molecules(v), v.fx_cells, by=("sample_id",))
    s = cell_jobs.build_pseudospots(t.cells, t.counts, cell_jobs.GridParameters(55.0, 200.0, "square"), by=("sample_id",))
    return s.spots.select("sample_id", "spot_id", "grid_row", "grid_col", "cell_count", "transcript_count", "position_fold")


def spot_obs(v):
    name = F.concat(F.lit("s"), F.col("spot_id").cast("string"))
    tiles = v.fx_spots.select(F.col("sample_no").cast("string").alias("sample_id"), name.alias("barcode"), F.col("spot_id").alias("patch_idx"))
    obs = v.fx_spots.select(F.col("sample_no").cast("string").alias("sample_id"), name.alias("barcode"), F.col("spot_id").alias("obs_id"))
    return tiles, obs


@query("job_03_index_spots", f"""
WITH e AS (SELECT CAST(s_nationkey AS VARCHAR) AS sample_id, l_suppkey AS obs_id, p_brand AS gene, CAST(sum(l_quantity) AS BIGINT) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE p_brand IN (SELECT gene FROM fx_panel) GROUP BY s_nationkey, l_suppkey, p_brand)
SELECT sample_id, obs_id, gene, {R('ln(1 + cnt / sum(cnt) OVER (PARTITION BY obs_id) * 1e6)', 'norm')} FROM e WHERE obs_id IN (SELECT spot_id FROM fx_spots)""")
def _(v):
    expr = (
        v.lineitem.join(v.part, F.col("l_partkey") == F.col("p_partkey")).join(v.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("s_nationkey").cast("string").alias("sample_id"), F.col("l_suppkey").alias("obs_id"), F.col("p_brand").alias("gene"))
        .agg(F.sum("l_quantity").cast("long").alias("cnt"))
    )
    tiles, obs = spot_obs(v)
    return cell_jobs.index_spots(expr, tiles, obs, v.fx_panel, method="log1p_cpm")[1].select("sample_id", "obs_id", "gene", r6("norm"))


def pair_sql(by: str = "", asked: str = "SELECT DISTINCT query_id FROM mt") -> str:
    """Every panel gene for every query of ``mt``; missing values are 0."""
    key, on = (f"{by}, ", f"AND pr.{by} = a.{by}") if by else ("", "")
    return f"""sp AS (SELECT {'a.' + by + ', ' if by else ''}a.query_id AS entity_id, g.gene, coalesce(pr.pred, 0) AS pred, coalesce(t.value, 0) AS target
      FROM (SELECT DISTINCT {key}query_id FROM mt) a CROSS JOIN fx_vpanel g LEFT JOIN pr ON pr.query_id = a.query_id AND pr.gene = g.gene {on}
      LEFT JOIN fx_values t ON t.id = a.query_id AND t.gene = g.gene)"""


@query("job_04_evaluate_retrieval", f"WITH {match_sql(ASK, 10)}, {PRED_SQL}, {pair_sql()}, {summary_sql('sp')} SELECT *, 10 AS top_k FROM su")
def _(v):
    q, b = sides(v)
    return summary_columns(evaluation.evaluate_retrieval(b, q, v.fx_values, v.fx_vpanel, 10), extra=("top_k",))


CV_PRED = PRED_SQL.replace("SELECT query_id, bank_id", "SELECT fold, query_id, bank_id").replace("SELECT query_id, gene", "SELECT fold, query_id, gene").replace("GROUP BY query_id, gene", "GROUP BY fold, query_id, gene")


@query("job_05_cross_validate", f"WITH {match_sql('q.fold <> b.fold', 10, 'fold')}, {CV_PRED}, {pair_sql('fold')}, {summary_sql('sp', 'fold', 'spot')} SELECT * FROM su")
def _(v):
    obs = v.fx_embed.withColumn("sample_id", F.col("fold"))
    return summary_columns(evaluation.cross_validate(obs, v.fx_values, v.fx_vpanel, 10)[0], "fold", label="spot")


NEAR3_SQL = """a AS (SELECT sample_id, cell_id, spot_id FROM (SELECT CAST(c.cell_id % 3 AS VARCHAR) AS sample_id, c.cell_id, p.spot_id, sqrt((centroid_x - center_x) * (centroid_x - center_x) + (centroid_y - center_y) * (centroid_y - center_y)) AS distance,
    row_number() OVER (PARTITION BY c.cell_id ORDER BY (centroid_x - center_x) * (centroid_x - center_x) + (centroid_y - center_y) * (centroid_y - center_y), p.spot_id) AS r
    FROM fx_cells c JOIN fx_spots p ON c.cell_id % 3 = p.spot_id % 3 AND abs(centroid_x - center_x) < 80 AND abs(centroid_y - center_y) < 80) WHERE r = 1 AND distance < 80)"""


@query("job_06_infer_spots_from_cells", f"""
WITH {NEAR3_SQL}, n AS (SELECT count(*) AS n FROM fx_embed), ce AS (SELECT a.*, cell_id % n AS query_id FROM a, n), used AS (SELECT DISTINCT query_id FROM ce),
{match_sql('q.id IN (SELECT query_id FROM used)', 3)}, {PRED_SQL},
og AS (SELECT DISTINCT sample_id, gene FROM fx_spot_expr WHERE gene IN (SELECT gene FROM fx_vpanel)),
sx AS (SELECT ce.sample_id, spot_id, pr.gene, ln(1 + greatest(sum(exp(pred) - 1), 0)) AS p FROM ce JOIN pr USING (query_id) JOIN og ON og.sample_id = ce.sample_id AND og.gene = pr.gene GROUP BY ce.sample_id, spot_id, pr.gene),
sp AS (SELECT s.sample_id, s.spot_id AS entity_id, og.gene, coalesce(sx.p, 0) AS pred, coalesce(ln(1 + t.cnt), 0) AS target FROM (SELECT DISTINCT sample_id, spot_id FROM a) s JOIN og USING (sample_id)
   LEFT JOIN sx ON sx.sample_id = s.sample_id AND sx.spot_id = s.spot_id AND sx.gene = og.gene LEFT JOIN fx_spot_expr t ON t.sample_id = s.sample_id AND t.spot_id = s.spot_id AND t.gene = og.gene),
{summary_sql('sp', 'sample_id', 'spot')} SELECT *, true AS count_semantics_verified FROM su""")
def _(v):
    third = lambda c: (F.col(c) % 3).cast("string").alias("sample_id")
    spots = v.fx_spots.select(third("spot_id"), "spot_id", "center_x", "center_y")
    cells = v.fx_cells.select(third("cell_id"), "cell_id", "centroid_x", "centroid_y")
    n = v.fx_embed.agg(F.count(F.lit(1)).alias("n")).scalar()
    queries = cells.withColumn("id", F.col("cell_id") % n).join(v.fx_embed.select("id", "vec"), "id").select("sample_id", "cell_id", "vec")
    _, _, scores = evaluation.infer_spots_from_cells(
        spots, cells, v.fx_spot_expr, v.fx_embed.select("id", "vec"), v.fx_values, queries, v.fx_vpanel, radius=80.0, k=3)
    return summary_columns(scores, "sample_id", label="spot", extra=("count_semantics_verified",))


EXT_PRED = PRED_SQL.replace("SELECT query_id, bank_id", "SELECT label, query_id, bank_id").replace("SELECT query_id, gene", "SELECT label, query_id, gene").replace("GROUP BY query_id, gene", "GROUP BY label, query_id, gene")


@query("job_07_evaluate_external", f"WITH {match_sql(ASK, 5, 'label')}, {EXT_PRED}, {pair_sql('label')}, {summary_sql('sp', 'label', 'spot')} SELECT label AS sample_id, * EXCLUDE (label) FROM su")
def _(v):
    q, b = sides(v)
    _, rows = evaluation.evaluate_external(b, q.withColumn("sample_id", F.col("label")), v.fx_values, v.fx_vpanel, 5)
    return summary_columns(rows, "sample_id", label="spot")


@query("job_08_score_predictions", f"WITH {summary_sql('fx_pred', 'sample_no')} SELECT * FROM su")
def _(v):
    return summary_columns(evaluation.score_predictions(v.fx_pred, by=("sample_no",)), "sample_no")


def joint_sql(mode: str, where: str) -> str:
    pred = PRED_SQL.replace("SELECT query_id, bank_id", "SELECT platform, query_id, bank_id").replace("SELECT query_id, gene", "SELECT platform, query_id, gene").replace("GROUP BY query_id, gene", "GROUP BY platform, query_id, gene")
    return f"SELECT '{mode}' AS bank, * FROM (WITH {match_sql(where, 10, 'platform')}, {pred}, {pair_sql('platform')}, {summary_sql('sp', 'platform', 'spot')} SELECT * FROM su)"


DECODER = "(SELECT id AS entity_id, platform, gene, value AS target, value * 0.5e0 + id % 3 AS pred FROM fx_values JOIN fx_embed USING (id) WHERE side = 'query')"


@query("job_09_joint_evaluation", " UNION ALL ".join([
    joint_sql("target", ASK + " AND q.platform = b.platform"), joint_sql("joint", ASK),
    f"SELECT 'decoder' AS bank, * FROM (WITH dc AS {DECODER}, {summary_sql('dc', 'platform', 'spot')} SELECT * FROM su)"]))
def _(v):
    decoder = v.fx_values.join(v.fx_embed.where(F.col("side") == "query").select("id", "platform"), "id").select(
        "platform", F.col("id").alias("entity_id"), "gene", (F.col("value") * 0.5 + F.col("id") % 3).alias("pred"), F.col("value").alias("target"))
    return summary_columns(evaluation.joint_evaluation(v.fx_embed, v.fx_values, v.fx_vpanel, 10, decoder), "platform", "bank", label="spot")


NATIVE = "(SELECT obs_id AS spot_id, gene, cnt FROM fx_expr WHERE technology = 'Xenium')"


def rounded(df):
    return df.select(*[r6(f.name, digits=4) if f.dataType.typeName() == "double" else f.name for f in df.schema])


def pseudospot_tables(v, **options):
    t = spot_tables(v)
    native_expr = v.fx_expr.where(F.col("technology") == "Xenium").select(F.col("obs_id").alias("spot_id"), "gene", "cnt")
    native = v.fx_obs.where(F.col("technology") == "Xenium").select(F.col("obs_id").alias("spot_id"))
    return reports.pseudospot_report(t.spots, native, t.counts, native_expr, v.fx_panel, **options)


def gene_tables(v, **options):
    genes = v.fx_expr.groupBy("sample_id", "gene").agg(F.min("obs_id").alias("pos"))
    return reports.gene_distribution_report(v.fx_expr, v.fx_obs, genes, "1-URGENT", TECHS, top=6, **options)


@query("job_10_pseudospot_report", f"""
WITH {FULL_SPOT_SQL}, ex AS (SELECT 'pseudospot' AS source, spot_id, gene, cnt FROM sc UNION ALL SELECT 'native', spot_id, gene, cnt FROM {NATIVE}),
nm AS (SELECT source, gene, ln(1 + cnt / sum(cnt) OVER (PARTITION BY source, spot_id) * 1e4) AS norm FROM ex WHERE gene IN (SELECT gene FROM fx_panel)),
z AS (SELECT (SELECT count(*) FROM n) AS np, (SELECT count(*) FROM fx_obs WHERE technology = 'Xenium') AS nn)
SELECT gene, {R("sum(CASE WHEN source = 'pseudospot' THEN norm ELSE 0 END) / max(np)", 'pseudospot_mean')}, {R("sum(CASE WHEN source = 'native' THEN norm ELSE 0 END) / max(nn)", 'native_mean')} FROM nm, z GROUP BY gene""")
def _(v):
    return pseudospot_tables(v, with_separation=False)["gene_shift"].select("gene", r6("pseudospot_mean"), r6("native_mean"))


@query("job_10_separation")
def _(v):
    return rounded(pseudospot_tables(v)["separation"])


@query("job_11_gene_distribution_report", f"""
WITH {SUMMARY_SQL}, best AS (SELECT gene FROM gs WHERE od >= 0.05 ORDER BY abs(vm - xm) DESC, abs(vd - xd) DESC, gene LIMIT 6),
lg AS (SELECT o.technology, b.gene, coalesce(n.norm, 0) AS x FROM fx_obs o CROSS JOIN best b LEFT JOIN nm n ON n.obs_id = o.obs_id AND n.gene = b.gene),
rg AS (SELECT min(x) AS lo, max(x) AS hi FROM lg), bn AS (SELECT gene, technology, CAST(least(floor((x - lo) / ((hi - lo) / 32)), 31) AS INT) AS bin, (hi - lo) / 32 AS w FROM lg, rg)
SELECT gene, technology, bin, count(*) AS n, {R('count(*) / (sum(count(*)) OVER (PARTITION BY gene, technology) * max(w))', 'density', 5)} FROM bn GROUP BY gene, technology, bin""")
def _(v):
    return gene_tables(v, with_separation=False)["density"].select("gene", "technology", "bin", "n", r6("density", digits=5))


@query("job_11_separation")
def _(v):
    return rounded(gene_tables(v)["separation"])


def sampled_pixels(v, outlines):
    # A row for each cell, however small the file: merged, as a broadcast would hold all cells in the driver.
    return v.fx_pixels.join(outlines.select(F.col("cell_id").alias("crop_id"), "sample_id").hint("merge"), "crop_id")


@query("job_12_cell_morphology_report", f"""SELECT technology, sample_id, count(*) AS sampled_cells, {R('median(w * h / 4)', 'area_um2_median')}, {R('avg(w * h / 4)', 'area_um2_mean')}, count(*) * 3 AS total_available_cells
    FROM fx_polygons GROUP BY technology, sample_id""")
def _(v):
    outlines = v.fx_polygons.select("technology", F.concat_ws("/", "technology", "sample_id").alias("sample_id"), "cell_id", F.lit(0.5).alias("pixel_size_um"), ring())
    totals = outlines.groupBy("sample_id").agg((F.count(F.lit(1)) * 3).alias("total"))
    pixels = sampled_pixels(v, outlines)
    out = reports.cell_morphology_report(outlines, pixels, totals, with_separation=False)
    return out["summary"].select("technology", F.element_at(F.split("sample_id", "/"), 2).alias("sample_id"), "sampled_cells", r6("area_um2_median"), r6("area_um2_mean"), "total_available_cells")


@query("job_12_separation")
def _(v):
    outlines = v.fx_polygons.select("technology", "sample_id", "cell_id", F.lit(0.5).alias("pixel_size_um"), ring())
    totals = outlines.groupBy("sample_id").agg(F.count(F.lit(1)).alias("total"))
    pixels = sampled_pixels(v, outlines)
    s = reports.cell_morphology_report(outlines, pixels, totals)["separation"]
    return s.select(r6("silhouette", digits=4), r6("same_label_knn_fraction", digits=4), "pca_components", r6("pca_explained_variance_ratio_sum", digits=4))


MEASURES = ("silhouette", "same_label_knn_fraction", "centroid_distance", "cross_domain_mean_cosine")


@query("job_13_embedding_alignment_report")
def _(v):
    rows = v.fx_embed.withColumn("model", F.when(F.col("id") % 2 == 0, "m1").otherwise("m2")).withColumn("view", F.lit("shared")).withColumn("split", F.col("side"))
    out = reports.embedding_alignment_report(rows, ["m1", "m2"], "alignment")
    return out.select("model", "view", "pca_components", *[r6(c, digits=4) for c in MEASURES])


def stage_rows(v):
    name = F.when(F.col("id") % 2 == 0, "stem").otherwise("final_embedding")
    return v.fx_embed.select("id", "vec", "platform", F.lit("m1").alias("model"), name.alias("stage"))


@query("job_14_layerwise_gap_report")
def _(v):
    table, _ = reports.layerwise_gap_report(stage_rows(v))
    return table.select("model", "stage", *[r6(c, digits=4) for c in MEASURES], r6("platform_auc", digits=3))


@query("job_14_deltas")
def _(v):
    _, deltas = reports.layerwise_gap_report(stage_rows(v))
    return rounded(deltas)


@query("job_15_fold_report", f"""
WITH r AS (SELECT fold, CAST(regexp_extract(line, 'overall=([-0-9.]+)', 1) AS DOUBLE) AS overall, CAST(regexp_extract(line, 'gene=([-0-9.]+)', 1) AS DOUBLE) AS gene FROM (SELECT fold, arg_max(line, pos) AS line FROM fx_logs GROUP BY fold))
SELECT count(*) AS num_folds, {R('avg(overall)', 'overall_mean')}, {R('stddev_pop(overall)', 'overall_std')}, {R('avg(gene)', 'gene_mean')} FROM r""")
def _(v):
    _, out = reports.fold_report(v.spark, write_logs(v), log="*.txt")
    return out.select("num_folds", r6("overall_mean"), r6("overall_std"), r6("gene_mean"))


@query("job_16_convert_10x", "SELECT 'S1' AS sample_id, CAST(obs_id AS VARCHAR) AS obs_id, gene, CAST(cnt AS DOUBLE) AS cnt FROM fx_expr")
def _(v):
    source = scratch_path(v.spark, "triplets")
    write_10x(v, source)
    path = reports.convert_10x(v.spark, source, scratch_path(v.spark, "expression"), "S1")
    return tables.read_expression_long(v.spark, path).select("sample_id", "obs_id", "gene", "cnt")


@query("str_01_stream_cell_gene_counts", """SELECT cell_id, feature_name AS gene, count(*) AS cnt FROM fx_transcripts WHERE cell_id > 0 AND NOT starts_with(feature_name, 'BLANK_') AND overlaps_nucleus = 1
  AND cell_id IN (SELECT cell_id FROM fx_cells) AND feature_name IN (SELECT gene FROM fx_panel) GROUP BY cell_id, feature_name""")
def _(v):
    folder, log, state = (scratch_path(v.spark, n) for n in ("molecules", "counts", "state"))
    v.fx_transcripts.select("cell_id", "feature_name", "overlaps_nucleus").write.parquet(folder)
    stream = molecules.stream_molecules(v.spark, folder, files_per_trigger=3)
    molecules.run_to_log(stream, log, state, cells=v.fx_cells, panel=v.fx_panel, only_nucleus=True)
    molecules.compact(v.spark, log)
    return molecules.latest_counts(v.spark, log)


@query("udf_02_expression_normalization", f"""
WITH t AS (SELECT obs_id, gene, cnt, sum(cnt) OVER (PARTITION BY obs_id) AS total FROM fx_expr)
SELECT 'log1p' AS method, obs_id, gene, {R('ln(1 + cnt)', 'norm')} FROM t UNION ALL SELECT 'log1p_cpm', obs_id, gene, {R('ln(1 + cnt / total * 1e6)', 'norm')} FROM t""")
def _(v):
    parts = [normalization.normalize_long(v.fx_expr, ["obs_id"], m).select(F.lit(m).alias("method"), "obs_id", "gene", r6("norm")) for m in ("log1p", "log1p_cpm")]
    return panels.stack_frames(parts)


@query("udf_03_spot_aggregation", "SELECT spot_id, gene, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT obs_id // 10 AS spot_id, gene, cnt FROM fx_expr) GROUP BY spot_id, gene")
def _(v):
    members = v.fx_obs.select(F.expr("obs_id div 10").alias("spot_id"), F.col("obs_id").alias("cell_id"))
    return cell_jobs.pseudospot_counts(members, v.fx_expr.select(F.col("obs_id").alias("cell_id"), "gene", "cnt"))


@query("udf_04_evaluation_bank", """SELECT 'target' AS mode, id, source FROM (SELECT id, platform AS source FROM fx_embed) WHERE source = 'xenium' UNION ALL SELECT 'joint', id, platform FROM fx_embed""")
def _(v):
    joint = panels.joint_bank({p: v.fx_embed.where(F.col("platform") == p).select("id") for p in ("visium", "xenium")}, {"visium": 0, "xenium": 1})
    return panels.stack_frames([panels.evaluation_bank(joint, m, "xenium").select(F.lit(m).alias("mode"), "id", "source") for m in ("target", "joint")])


@query("udf_05_block_kernels", f"WITH {match_sql('q.id <> b.id', 3)} SELECT query_id, bank_id, {R('score')} FROM mt")
def _(v):
    # Small blocks force many chunks and pivots; the matches must not depend on them.
    return neighbors.topk(v.fx_embed, v.fx_embed, 3, exclude_self=True, block=64).select("query_id", "bank_id", r6("score"))
