"""Platform-gap measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.catalog.basics import PATCH_SQL, PIXEL_SQL, overlaps
from spotloom.catalog.core import R, query, r6
from spotloom.catalog.sources import ring
from spotloom.catalog.vectors import ASK, COS, DIST, sides
from spotloom.operators import features, gap, normalization, transport
from spotloom.session import stage

NORM_SQL = "nm AS (SELECT *, ln(1 + cnt / sum(cnt) OVER (PARTITION BY sample_id, technology, obs_id) * 1e4) AS norm FROM fx_expr)"
TECHS = ["Visium", "Xenium"]


def normed(v):
    return normalization.normalize_long(v.fx_expr, ["sample_id", "technology", "obs_id"], "cp10k")


SUMMARY_SQL = f"""{NORM_SQL}, z AS (SELECT count(*) AS n, sum(CASE WHEN technology = 'Visium' THEN 1 ELSE 0 END) AS nv, sum(CASE WHEN technology = 'Xenium' THEN 1 ELSE 0 END) AS nx FROM fx_obs),
    gs AS (SELECT gene, sum(CASE WHEN technology = 'Visium' THEN norm ELSE 0 END) / max(nv) AS vm, sum(CASE WHEN technology = 'Xenium' THEN norm ELSE 0 END) / max(nx) AS xm,
      sum(CASE WHEN technology = 'Visium' THEN 1 ELSE 0 END) / max(nv) AS vd, sum(CASE WHEN technology = 'Xenium' THEN 1 ELSE 0 END) / max(nx) AS xd, count(*) / max(n) AS od FROM nm, z GROUP BY gene)"""


@query("agg_16_gene_summary", f"""WITH {SUMMARY_SQL} SELECT gene, {R('vm', 'visium_mean')}, {R('vd', 'visium_detect')}, {R('xm', 'xenium_mean')}, {R('xd', 'xenium_detect')},
    {R('abs(vm - xm)', 'abs_mean_diff')}, {R('abs(vd - xd)', 'abs_detect_diff')}, {R('od', 'overall_detect')} FROM gs WHERE od >= 0.05""")
def _(v):
    s = gap.gene_summary(normed(v), v.fx_obs, TECHS)
    return s.select("gene", *[r6(c) for c in s.columns if c != "gene"])


@query("agg_17_gene_mean_shift", f"WITH {SUMMARY_SQL} SELECT gene, {R('vm', 'Visium_mean')}, {R('xm', 'Xenium_mean')}, {R('abs(vm - xm)', 'abs_mean_diff')} FROM gs")
def _(v):
    s = gap.gene_mean_shift(normed(v), v.fx_obs, "Visium", "Xenium", group="technology")
    return s.select("gene", *[r6(c) for c in s.columns if c != "gene"])


def records(v):
    return gap.polygon_stats(v.fx_polygons.select("technology", "sample_id", "cell_id", ring()), 0.5)


@query("agg_18_sample_summary", f"""SELECT technology, sample_id, count(*) AS sampled_cells, {R('avg(w * h / 4)', 'area_um2_mean')}, {R('median(w * h / 4)', 'area_um2_median')},
    {R('avg(sqrt(w * h * 4 / pi()) / 2)', 'diameter_um_mean')}, {R('avg(w / 2)', 'bbox_width_um_mean')}, {R('avg(h / 2)', 'bbox_height_um_mean')} FROM fx_polygons GROUP BY technology, sample_id""")
def _(v):
    s = gap.sample_summary(records(v))
    return s.select("technology", "sample_id", "sampled_cells", *[r6(c) for c in s.columns if c.endswith(("mean", "median"))])


@query("agg_19_sampled_by_sample", "SELECT sample_id, count(*) AS n FROM fx_polygons GROUP BY sample_id")
def _(v):
    return gap.sampled_by_sample(v.fx_polygons).select(F.explode("sampled_by_sample").alias("sample_id", "n"))


POOL_SQL = PATCH_SQL + """, l AS (SELECT cell_id, overlap_area, unnest(token) AS v, unnest(range(64)) AS dim FROM o JOIN fx_tokens USING (patch_idx)),
    pp AS (SELECT cell_id, dim, {agg} AS v FROM l GROUP BY cell_id, dim)"""
POOL = {"mean": "avg(v)", "max": "max(v)", "weighted_mean": "coalesce(sum(v * overlap_area) / nullif(sum(overlap_area), 0), 0)"}


def pooled(v, mode: str, met=None):
    out = gap.patch_pool(overlaps(v) if met is None else met, v.fx_tokens, v.fx_polygons.select("cell_id"), 64, mode)
    return out.select("cell_id", F.posexplode("features").alias("dim", "v")).select("cell_id", "dim", r6("v"))


@query("agg_21_patch_pool", f"WITH {POOL_SQL.format(agg=POOL['weighted_mean'])} SELECT cell_id, dim, {R('v')} FROM pp")
def _(v):
    return pooled(v, "weighted_mean")


MODES = ("mean", "max")


@query("udf_01_patch_aggregation", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, cell_id, dim, {R('v')} FROM (WITH {POOL_SQL.format(agg=POOL[m])} SELECT * FROM pp)" for m in MODES))
def _(v):
    # Both modes pool the same overlaps; clipping is most of the work.
    met = stage(overlaps(v))
    a, b = (pooled(v, m, met).withColumn("mode", F.lit(m)) for m in MODES)
    return a.unionByName(b)


UNIT_SQL = """u AS (SELECT id, platform, unnest(range(64)) AS dim, unnest(CAST(vec AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS n FROM fx_embed),
    m AS (SELECT dim, avg(CASE WHEN platform = 'visium' THEN x END) AS a, avg(CASE WHEN platform = 'xenium' THEN x END) AS b, avg(CASE WHEN platform = 'visium' THEN x / n END) AS ua,
      avg(CASE WHEN platform = 'xenium' THEN x / n END) AS ub FROM u GROUP BY dim)"""


@query("agg_23_centroid_distance", f"WITH {UNIT_SQL} SELECT {R('sqrt(sum((a - b) * (a - b)))', 'centroid_distance')} FROM m")
def _(v):
    return gap.centroid_distance(v.fx_embed, "platform", "visium", "xenium").select(r6("centroid_distance"))


@query("agg_24_cross_group_mean_cosine", f"SELECT {R('avg(' + COS.format(a='p.vec', b='q.vec') + ')', 'cross_domain_mean_cosine')} FROM fx_embed p, fx_embed q WHERE p.platform = 'visium' AND q.platform = 'xenium'")
def _(v):
    return gap.cross_group_mean_cosine(v.fx_embed, "platform", "visium", "xenium").select(r6("cross_domain_mean_cosine"))


KNN_SQL = f"""kn AS (SELECT same FROM (SELECT q.label = b.label AS same, row_number() OVER (PARTITION BY q.id ORDER BY round({DIST.format(a='q.vec', b='b.vec')}, 12), b.id) AS rank
    FROM fx_embed q, fx_embed b WHERE q.id <> b.id) WHERE rank <= 15)"""


@query("agg_25_same_label_knn_fraction", f"WITH {KNN_SQL} SELECT {R('avg(CASE WHEN same THEN 1e0 ELSE 0e0 END)', 'same_label_knn_fraction')} FROM kn")
def _(v):
    return gap.same_label_knn_fraction(v.fx_embed, 15).select(r6("same_label_knn_fraction"))


SIL_SQL = f"""dd AS (SELECT q.id, q.label, b.label AS other, sum({DIST.format(a='q.vec', b='b.vec')}) AS s, count(*) AS n FROM fx_embed q, fx_embed b GROUP BY q.id, q.label, b.label),
    ab AS (SELECT id, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM dd GROUP BY id)"""


@query("agg_26_silhouette", f"WITH {SIL_SQL} SELECT {R('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 'silhouette')} FROM ab")
def _(v):
    return gap.silhouette(v.fx_embed).select(r6("silhouette"))


@query("agg_27_binned_density", f"""WITH {PIXEL_SQL}, q AS (SELECT 'gray' AS channel, gray AS val FROM gr UNION ALL SELECT 'gradient', gradient FROM gr),
    b AS (SELECT channel, CAST(least(floor(val * 8), 7) AS INT) AS bin FROM q WHERE val >= 0 AND val <= 1)
    SELECT channel, bin, count(*) AS n, {R('count(*) / (sum(count(*)) OVER (PARTITION BY channel) * 0.125e0)', 'density')} FROM b GROUP BY channel, bin""")
def _(v):
    g = gap.pixel_gradient(v.fx_pixels)
    long = g.unpivot(["crop_id"], ["gray", "gradient"], "channel", "val")
    return gap.binned_density(long, "val", ["channel"], 8, 0.0, 1.0).select("channel", "bin", "n", r6("density"))


def cov_sql(a: str, b: str) -> str:
    return f"""(SELECT avg(m) FROM (SELECT platform, avg(c * c) AS m FROM (SELECT x.platform, x.d AS da, y.d AS db, covar_samp(x.v, y.v) AS c
      FROM (SELECT id, platform, unnest(CAST({a} AS DOUBLE[])) AS v, unnest(range(16)) AS d FROM fx_embed) x JOIN (SELECT id, unnest(CAST({b} AS DOUBLE[])) AS v, unnest(range(16)) AS d FROM fx_embed) y USING (id)
      GROUP BY x.platform, x.d, y.d) GROUP BY platform))"""


@query("agg_28_cross_covariance_norm", f"SELECT {R('(' + cov_sql('vec[1:16]', 'vec[17:32]') + ' + ' + cov_sql('vec[33:48]', 'vec[49:64]') + ') / 2', 'orthogonality')}")
def _(v):
    part = lambda start: F.slice("vec", start, 16)
    rows = v.fx_embed.select("id", "platform", part(1).alias("image_shared"), part(17).alias("image_private"), part(33).alias("gene_shared"), part(49).alias("gene_private"))
    return gap.shared_private_overlap(rows).select(r6("orthogonality"))


@query("agg_29_soft_topk_cross_entropy", f"""
WITH s AS (SELECT q.id, {COS.format(a='q.vec', b='b.vec')} / 0.2e0 AS l, row_number() OVER (PARTITION BY q.id ORDER BY {COS.format(a='q.vec', b='b.vec')} DESC) AS r,
    (SELECT ceil(count(*) * 7 / 100e0) FROM fx_embed WHERE side = 'bank') AS k FROM fx_embed q, fx_embed b WHERE {ASK}),
t AS (SELECT id, ln(sum(exp(l - 5))) + 5 - sum(CASE WHEN r <= k THEN exp(l - 5) * l END) / sum(CASE WHEN r <= k THEN exp(l - 5) END) AS loss FROM s GROUP BY id)
SELECT {R('avg(loss)', 'soft_topk_cross_entropy')} FROM t""")
def _(v):
    q, b = sides(v)
    return gap.soft_topk_cross_entropy(q, b, 7.0, 0.2).select(r6("soft_topk_cross_entropy"))


@query("agg_30_platform_auc")
def _(v):
    return features.platform_auc(v.fx_embed, "platform").select(r6("platform_auc", digits=3))


ITERS = 50


def sinkhorn_sql(power: str, final: str) -> str:
    steps, last = [], "(SELECT j, 1e0 AS v FROM (SELECT DISTINCT j FROM kk))"
    for i in range(ITERS):
        steps.append(f"u{i} AS MATERIALIZED (SELECT i, power((1e0 / (SELECT count(DISTINCT i) FROM kk)) / greatest(sum(k * v), 1e-8), {power}) AS u FROM kk JOIN {last} USING (j) GROUP BY i)")
        steps.append(f"v{i} AS MATERIALIZED (SELECT j, power((1e0 / (SELECT count(DISTINCT j) FROM kk)) / greatest(sum(k * u), 1e-8), {power}) AS v FROM kk JOIN u{i} USING (i) GROUP BY j)")
        last = f"v{i}"
    return f"""WITH kk AS MATERIALIZED (SELECT *, greatest(exp(-c / 0.5e0), 1e-8) AS k FROM (SELECT a.id AS i, b.id AS j, 1 - greatest(least({COS.format(a='a.vec', b='b.vec')}, 1), -1) AS c
      FROM fx_embed a, fx_embed b WHERE a.platform = 'visium' AND b.platform = 'xenium')), {', '.join(steps)},
      pl AS MATERIALIZED (SELECT i, j, u * k * v AS p, c FROM kk JOIN u{ITERS - 1} USING (i) JOIN v{ITERS - 1} USING (j)) {final}"""


KL = """(SELECT sum(greatest(m, 1e-8) * (ln(greatest(m, 1e-8)) - ln(r)) - greatest(m, 1e-8) + r) FROM (SELECT sum(p) AS m, 1e0 / (SELECT count(DISTINCT {k}) FROM kk) AS r FROM pl GROUP BY {k}))"""
BALANCED = sinkhorn_sql("1e0", f"SELECT 'balanced' AS form, {R('sum(p * c)', 'transport_cost', 5)} FROM pl")
UNBALANCED = sinkhorn_sql("(2e0 / 2.5e0)", f"SELECT 'unbalanced' AS form, {R('sum(p * c) + 2 * (' + KL.format(k='i') + ' + ' + KL.format(k='j') + ')', 'transport_cost', 5)} FROM pl")


@query("agg_31_sinkhorn_cost", f"SELECT * FROM ({BALANCED}) UNION ALL SELECT * FROM ({UNBALANCED})")
def _(v):
    a, b = (v.fx_embed.where(F.col("platform") == p).select("id", "vec") for p in ("visium", "xenium"))
    forms = [transport.sinkhorn_cost(a, b, 0.5, rho=rho).select(F.lit(n).alias("form"), r6("transport_cost", digits=5)) for n, rho in (("balanced", None), ("unbalanced", 2.0))]
    return forms[0].unionByName(forms[1])
