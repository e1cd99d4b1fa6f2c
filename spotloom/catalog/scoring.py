"""Pearson scores, fold summaries and loss histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.catalog.basics import NEAR_SQL
from spotloom.catalog.core import R, query, r6
from spotloom.operators import metrics, retrieval, spatial


def r_sql(n: str = "count(*)") -> str:
    """Correlation with the zero rule, as an aggregate over pred and target."""
    return (f"CASE WHEN {n} * sqrt(var_pop(pred)) * sqrt(var_pop(target)) < 1e-12 THEN 0e0 "
            "ELSE covar_pop(pred, target) / (sqrt(var_pop(pred)) * sqrt(var_pop(target))) END")


@query("agg_08_pearson_overall", f"SELECT sample_no, {R(r_sql(), 'overall_pearson')} FROM fx_pred GROUP BY sample_no")
def _(v):
    return metrics.pearson_overall(v.fx_pred, ("sample_no",)).select("sample_no", r6("overall_pearson"))


@query("agg_09_pearson_by_gene", f"SELECT gene, {R(r_sql(), 'pearson')} FROM fx_pred GROUP BY gene")
def _(v):
    return metrics.pearson_by_gene(v.fx_pred).select("gene", r6("pearson"))


@query("agg_10_pearson_by_entity", f"SELECT entity_id, {R(r_sql(), 'pearson')} FROM fx_pred GROUP BY entity_id")
def _(v):
    return metrics.pearson_by_entity(v.fx_pred).select("entity_id", r6("pearson"))


SUMMARY = ("overall_pearson", "mean_gene_pearson", "std_gene_pearson", "mean_cell_pearson", "std_cell_pearson")


def summary_sql(source: str, by: str = "", label: str = "cell") -> str:
    """Overall, gene and entity scores of a pair table, optionally per ``by``."""
    key, group, on = (f"{by}, ", f"GROUP BY {by}", f"USING ({by})") if by else ("", "", "ON true")
    inner = f"{by}, " if by else ""
    return f"""
    so AS (SELECT {key}{r_sql()} AS o FROM {source} {group}),
    sg AS (SELECT {key}avg(r) AS gm, stddev_pop(r) AS gs, count(*) AS ng FROM (SELECT {key}gene, {r_sql()} AS r FROM {source} GROUP BY {inner}gene) {group}),
    se AS (SELECT {key}avg(r) AS em, stddev_pop(r) AS es, count(*) AS ne FROM (SELECT {key}entity_id, {r_sql()} AS r FROM {source} GROUP BY {inner}entity_id) {group}),
    su AS (SELECT {key}{R('o', 'overall_pearson')}, {R('gm', 'mean_gene_pearson')}, {R('gs', 'std_gene_pearson')}, {R('em', f'mean_{label}_pearson')},
           {R('es', f'std_{label}_pearson')}, ng AS num_genes, ne AS num_{label}s FROM so JOIN sg {on} JOIN se {on})"""


def summary_columns(df, *keys: str, label: str = "cell", extra: tuple[str, ...] = ()):
    names = [c.replace("cell", label) for c in SUMMARY]
    return df.select(*keys, *[r6(c) for c in names], "num_genes", f"num_{label}s", *extra)


@query("agg_11_pearson_summary", f"WITH {summary_sql('fx_pred')} SELECT * FROM su")
def _(v):
    return summary_columns(metrics.pearson_summary(v.fx_pred))


@query("agg_12_pearson_summary_by_sample", f"WITH {summary_sql('fx_pred', 'sample_no')} SELECT * FROM su")
def _(v):
    return summary_columns(metrics.pearson_summary(v.fx_pred, by=("sample_no",)), "sample_no")


COVER_SQL = NEAR_SQL + """, cs AS (SELECT p.spot_id, p.sample_no, count(a.cell_id) AS n FROM fx_spots p LEFT JOIN a ON a.spot_id = p.spot_id GROUP BY p.spot_id, p.sample_no)"""


@query("agg_13_coverage_stats", f"""WITH {COVER_SQL} SELECT sample_no, count(CASE WHEN n > 0 THEN 1 END) AS evaluated_spots, count(*) AS candidate_spots,
    {R('avg(CASE WHEN n > 0 THEN 1e0 ELSE 0e0 END)', 'spot_coverage')}, {R('avg(CASE WHEN n > 0 THEN n END)', 'cells_per_spot_mean')}, {R('stddev_pop(CASE WHEN n > 0 THEN n END)', 'cells_per_spot_std')} FROM cs GROUP BY sample_no""")
def _(v):
    assigned = spatial.nearest_within_radius(v.fx_cells, v.fx_spots, 60.0)
    spots = retrieval.cells_per_spot(assigned, v.fx_spots).join(v.fx_spots.select("spot_id", "sample_no"), "spot_id")
    return metrics.coverage_stats(spots, ("sample_no",)).select(
        "sample_no", "evaluated_spots", "candidate_spots", *[r6(c) for c in ("spot_coverage", "cells_per_spot_mean", "cells_per_spot_std")])


@query("agg_14_multi_sample_summary", f"""
WITH m AS (SELECT sample_no, {r_sql()} AS r, avg(target) / 100 AS cov FROM fx_pred GROUP BY sample_no)
SELECT count(*) AS num_samples, {R('avg(r)', 'average_overall_pearson')}, {R('stddev_pop(r)', 'std_overall_pearson')}, {R('avg(r / 2)', 'average_mean_gene_pearson')}, {R('stddev_pop(r / 2)', 'std_mean_gene_pearson')},
  {R('avg(r / 3)', 'average_mean_spot_pearson')}, {R('stddev_pop(r / 3)', 'std_mean_spot_pearson')}, {R('avg(cov)', 'average_spot_coverage')}, bool_and(sample_no < 9) AS count_semantics_verified FROM m""")
def _(v):
    m = v.fx_pred.groupBy("sample_no").agg(metrics.pearson().alias("overall_pearson"), (F.avg("target") / 100).alias("spot_coverage"))
    m = m.select("*", (F.col("overall_pearson") / 2).alias("mean_gene_pearson"), (F.col("overall_pearson") / 3).alias("mean_spot_pearson"), (F.col("sample_no") < 9).alias("count_semantics_verified"))
    out = metrics.multi_sample_summary(m)
    return out.select("num_samples", "count_semantics_verified", *[r6(c) for c in out.columns if c.startswith(("average", "std"))])


@query("agg_15_fold_summary", f"""SELECT platform, count(*) AS num_folds, {R('avg(overall)', 'overall_mean')}, {R('stddev_pop(overall)', 'overall_std')}, {R('avg(mean_gene)', 'mean_gene_mean')}, {R('stddev_pop(mean_gene)', 'mean_gene_std')},
    {R('arg_min(overall, fold)', 'overall_first')}, {R('arg_max(overall, fold)', 'overall_last')} FROM fx_fold_metrics GROUP BY platform""")
def _(v):
    out = metrics.fold_summary(v.fx_fold_metrics, ["overall", "mean_gene"], ("platform",))
    return out.select("platform", "num_folds", *[r6(c) for c in ("overall_mean", "overall_std", "mean_gene_mean", "mean_gene_std")],
                      r6(F.get("overall_values", F.lit(0)), "overall_first"), r6(F.element_at("overall_values", -1), "overall_last"))


@query("agg_20_weighted_mean", f"SELECT run, epoch, {R('sum(loss * n) / greatest(sum(n), 1)', 'mean')} FROM fx_batches GROUP BY run, epoch")
def _(v):
    return metrics.weighted_mean(v.fx_batches, "loss", "n", ["run", "epoch"]).select("run", "epoch", r6("mean"))


@query("agg_32_best_epoch", f"""
WITH h AS (SELECT run, epoch, round(sum(loss * n) / greatest(sum(n), 1), 3) AS loss FROM fx_batches GROUP BY run, epoch)
SELECT run, epoch AS best_epoch, {R('loss', 'best_loss')} FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY loss, epoch) AS r FROM h) WHERE r = 1""")
def _(v):
    h = metrics.weighted_mean(v.fx_batches, "loss", "n", ["run", "epoch"], "loss").withColumn("loss", F.round("loss", 3))
    return metrics.best_epoch(h, ["run"]).select("run", "best_epoch", r6("best_loss"))
