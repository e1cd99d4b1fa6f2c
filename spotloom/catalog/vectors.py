"""Vector functions, nearest neighbours and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotloom.catalog.core import R, query, r6
from spotloom.functions import vectors
from spotloom.operators import features, gap, metrics, neighbors, retrieval
from spotloom.session import one_row, scratch_path
from spotloom.sources import tables, writers

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
DIST = "list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
SIM = COS.format(a="q.vec", b="b.vec")


def sides(v):
    e = v.fx_embed
    return e.where(F.col("side") == "query"), e.where(F.col("side") == "bank")


def match_sql(where: str, k: int, extra: str = "", source: str = "fx_embed") -> str:
    """Matches of each query by brute force, ties by bank id."""
    part = f"{extra}, " if extra else ""
    pick = f"q.{extra}, " if extra else ""
    return f"""mt AS (SELECT {part}query_id, bank_id, score, rank FROM (SELECT {pick}q.id AS query_id, b.id AS bank_id, {SIM} AS score,
        row_number() OVER (PARTITION BY q.id ORDER BY round({SIM}, 12) DESC, b.id) AS rank FROM {source} q, {source} b WHERE {where}) WHERE rank <= {k})"""


ASK = "q.side = 'query' AND b.side = 'bank'"


@query("vec_01_l2_normalize", f"""
WITH u AS (SELECT id, unnest(range(64)) AS dim, unnest(CAST(vec AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS n FROM fx_embed)
SELECT id, CAST(dim AS INT) AS dim, {R('x / greatest(n, 1e-12)', 'x')} FROM u""")
def _(v):
    return v.fx_embed.select("id", F.posexplode(vectors.l2_normalize("vec")).alias("dim", "x")).select("id", "dim", r6("x"))


@query("vec_02_dot", f"SELECT id, {R('list_dot_product(CAST(vec AS DOUBLE[]), list_reverse(CAST(vec AS DOUBLE[])))', 'd')} FROM fx_embed")
def _(v):
    return v.fx_embed.select("id", r6(vectors.dot("vec", F.reverse("vec")), "d"))


@query("vec_03_nonzero_tokens", f"""
WITH w AS (SELECT count(*) AS w FROM fx_panel), n AS (SELECT obs_id, row_number() OVER (ORDER BY obs_id) AS _x FROM fx_obs),
p AS (SELECT gene, row_number() OVER (ORDER BY pos) - 1 AS pos FROM fx_panel),
e AS (SELECT obs_id, pos, cnt, sum(cnt) OVER (PARTITION BY obs_id) AS total FROM fx_expr JOIN p USING (gene)),
t AS (SELECT obs_id, pos, ln(1 + cnt / total * 1e4) AS v FROM e
  UNION ALL SELECT obs_id, w, log10(max(total) * 2e0) FROM e, w GROUP BY obs_id, w UNION ALL SELECT obs_id, w + 1, log10(max(total)) FROM e, w GROUP BY obs_id, w HAVING max(total) > 1),
z AS (SELECT obs_id, count(*) AS length, max(count(*)) OVER () AS padded, sum(v * (pos + 1)) AS s FROM t GROUP BY obs_id)
SELECT obs_id, CAST(length AS INT) AS length, CAST(padded AS INT) AS padded, {R('s', 'checksum', 4)} FROM z""")
def _(v):
    from spotloom.operators import panels

    t = features.nonzero_tokens(v.fx_expr, panels.renumber(v.fx_panel.select("pos", "gene")), ["obs_id"], "f2")
    terms = F.transform("tokens", lambda x: x["v"] * (x["pos"] + 1))
    return t.select("obs_id", "length", F.size("tokens").alias("padded"), r6(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), "checksum", 4))


@query("vec_04_standardize", f"""
WITH u AS (SELECT id, unnest(range(64)) AS dim, unnest(CAST(vec AS DOUBLE[])) AS x FROM fx_embed)
SELECT id, CAST(dim AS INT) AS dim, {R('(x - avg(x) OVER (PARTITION BY dim)) / stddev_pop(x) OVER (PARTITION BY dim)', 'x', 5)} FROM u""")
def _(v):
    return features.standardize(v.fx_embed.select("id", "vec")).select("id", F.posexplode("vec").alias("dim", "x")).select("id", "dim", r6("x", digits=5))


def component_lengths(v, k: int | None):
    """Components are free in sign: each point's squared length and the explained share are reported."""
    projected, info = features.pca(v.fx_embed.select("id", "vec"), k)
    return projected.withColumn("_i", one_row(info)).select(
        "id", r6(vectors.dot("vec", "vec"), "squared_length", 4), F.col("_i.pca_components").alias("pca_components"),
        r6("_i.pca_explained_variance_ratio_sum", "explained", 4))


@query("vec_05_pca", f"""
WITH u AS (SELECT id, unnest(range(64)) AS dim, unnest(CAST(vec AS DOUBLE[])) AS x FROM fx_embed),
z AS (SELECT id, dim, (x - avg(x) OVER (PARTITION BY dim)) / stddev_pop(x) OVER (PARTITION BY dim) AS x FROM u)
SELECT id, {R('sum(x * x)', 'squared_length', 4)}, 64 AS pca_components, 1e0 AS explained FROM z GROUP BY id""")
def _(v):
    return component_lengths(v, 64)


@query("vec_05_pca_default")
def _(v):
    return component_lengths(v, None)


@query("vec_06_concat_features", f"""SELECT id, {R('label + 2 * (id % 7) + list_sum(list_transform(CAST(vec AS DOUBLE[]), lambda x, i: x * (i + 2)))', 'checksum', 5)}, CAST(len(vec) + 2 AS INT) AS width FROM fx_embed""")
def _(v):
    e = v.fx_embed.withColumn("bias", (F.col("id") % 7).cast("double"))
    f = e.withColumn("f", vectors.concat_features(["label", "bias"], "vec"))
    terms = F.transform("f", lambda x, i: x * (i + 1))
    return f.select("id", r6(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), "checksum", 5), F.size("f").alias("width"))


@query("joi_08_retrieve_topk", f"WITH {match_sql(ASK, 10)} SELECT query_id, bank_id, {R('score')}, CAST(rank AS INT) AS rank FROM mt")
def _(v):
    q, b = sides(v)
    return neighbors.topk(q, b, 10).select("query_id", "bank_id", r6("score"), "rank")


@query("joi_09_retrieve_topk_exclude_self", f"WITH {match_sql('q.id <> b.id', 5)} SELECT query_id, bank_id, {R('score')}, CAST(rank AS INT) AS rank FROM mt")
def _(v):
    return neighbors.topk(v.fx_embed, v.fx_embed, 5, exclude_self=True).select("query_id", "bank_id", r6("score"), "rank")


@query("joi_10_knn_self_join", f"""SELECT query_id, bank_id, {R('score')}, CAST(rank AS INT) AS rank FROM (SELECT q.id AS query_id, b.id AS bank_id, {DIST.format(a='q.vec', b='b.vec')} AS score,
    row_number() OVER (PARTITION BY q.id ORDER BY round({DIST.format(a='q.vec', b='b.vec')}, 12), b.id) AS rank FROM fx_embed q, fx_embed b WHERE q.id <> b.id) WHERE rank <= 15""")
def _(v):
    return gap.knn_self_join(v.fx_embed, 15).select("query_id", "bank_id", r6("score"), "rank")


@query("joi_15_gather_expression", f"WITH {match_sql(ASK, 3)} SELECT query_id, bank_id, gene, {R('value')} FROM mt JOIN fx_values ON bank_id = id")
def _(v):
    q, b = sides(v)
    # The bank's expression is laid out once; a search then shuffles its matches only.
    bank = tables.open_bank_expression(v.spark, writers.write_bank_expression(v.fx_values, scratch_path(v.spark, "bank_expression")))
    return retrieval.gather_expression(neighbors.topk(q, b, 3), bank).select("query_id", "bank_id", "gene", r6("value"))


SOFT = "exp(score - max(score) OVER (PARTITION BY query_id)) AS e FROM mt"


@query("win_05_softmax_over_matches", f"WITH {match_sql(ASK, 8)}, x AS (SELECT *, {SOFT}) SELECT query_id, bank_id, {R('e / sum(e) OVER (PARTITION BY query_id)', 'weight')} FROM x")
def _(v):
    q, b = sides(v)
    return metrics.softmax_weights(neighbors.topk(q, b, 8), ["query_id"]).select("query_id", "bank_id", r6("weight"))


@query("srt_01_topk", f"""SELECT query_id, {R('min(score)', 'kth_score')}, count(*) AS k FROM (WITH {match_sql("q.side = 'query' AND b.side = 'bank' AND q.platform = b.platform", 20)} SELECT * FROM mt) GROUP BY query_id""")
def _(v):
    q, b = sides(v)
    return neighbors.topk(q, b, 20, within=["platform"]).groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("k")).select("query_id", r6("s", "kth_score"), "k")


PRED_SQL = f"""x AS (SELECT *, {SOFT}), sw AS (SELECT query_id, bank_id, e / sum(e) OVER (PARTITION BY query_id) AS weight FROM x),
    pr AS (SELECT query_id, gene, sum(weight * value) AS pred FROM sw JOIN fx_values ON bank_id = id GROUP BY query_id, gene)"""


@query("agg_22_knn_softmax_predict", f"WITH {match_sql(ASK, 10)}, {PRED_SQL} SELECT query_id, gene, {R('pred')} FROM pr")
def _(v):
    q, b = sides(v)
    return retrieval.predict(neighbors.topk(q, b, 10), v.fx_values).select("query_id", "gene", r6("pred"))
