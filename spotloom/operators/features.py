"""Standardised features, principal components, ragged tokens and the platform classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spotloom.constants import CP10K_SCALE
from spotloom.functions import scalars, vectors
from spotloom.functions.scalars import dbl
from spotloom.operators import ranking, splits, sums
from spotloom.session import one_row, stage


def standardize(points: DataFrame, vec: str = "vec", by: tuple[str, ...] = ()) -> DataFrame:
    """(v − mean) / population deviation per dimension; a constant dimension divides by 1."""
    keys = list(by)
    wide = points.withColumn(vec, vectors.as_doubles(vec))
    means = sums.vector_sums(wide, keys, vec).select(*keys, F.transform("sums", lambda s: s / F.col("n")).alias("_m"))
    attach = lambda df, side: df.join(side, keys) if keys else df.withColumn("_f", one_row(side)).select("*", "_f.*").drop("_f")
    centred = attach(wide, means).withColumn(vec, F.zip_with(vec, "_m", lambda x, m: x - m)).drop("_m")
    squares = centred.withColumn(vec, F.transform(vec, lambda x: x * x))
    spread = sums.vector_sums(squares, keys, vec).select(*keys, F.transform("sums", lambda s: F.sqrt(s / F.col("n"))).alias("_s"))
    return attach(centred, spread).withColumn(vec, F.zip_with(vec, "_s", lambda x, s: x / F.when(s > 0, s).otherwise(dbl(1)))).drop("_s")


def components(gram: np.ndarray, n: int, k: int | None) -> tuple[np.ndarray, float]:
    """Principal components (rows) of centred points from their product sums, and the share of variance they explain.

    A component's largest coefficient is positive, so its sign is the same wherever it is computed.
    """
    d = len(gram)
    k = min(k or max(2, min(32, n - 1, d)), d)
    values, axes = np.linalg.eigh(gram / max(n - 1, 1))
    values, axes = np.maximum(values[::-1], 0.0), axes.T[::-1][:k]
    turn = np.sign(axes[np.arange(k), np.abs(axes).argmax(axis=1)])
    return axes * np.where(turn == 0, 1.0, turn)[:, None], float(values[:k].sum() / values.sum()) if values.sum() > 0 else 0.0


def pca(points: DataFrame, k: int | None = None, vec: str = "vec", by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Standardised points projected on k = max(2, min(32, n−1, d)) components, and (by…, number of them, explained share).

    All groups of ``by`` are fitted in one job from their product sums; a group's sums are reduced to its components in a
    task of its own. The driver holds the components (k × d numbers a group), as it holds a model's coefficients.
    """
    keys = list(by)
    # The products and the projection read it.
    scaled = stage(standardize(points, vec, by))
    fields = [points.schema[c] for c in keys]
    shape = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("share", T.DoubleType()), T.StructField("axes", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(shape)

    def fit(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                gram = np.array(row["sums"])
                axes, share = components(gram.reshape(int(round(len(gram) ** 0.5)), -1), row["n"], k)
                rows.append({**{c: row[c] for c in keys}, "k": len(axes), "share": share, "axes": axes.reshape(-1).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    fitted = sums.product_sums(scaled, keys, vec, vec).mapInArrow(fit, shape).collect()
    axes = {tuple(r[c] for c in keys): np.array(r["axes"]).reshape(r["k"], -1) for r in fitted}

    def project(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([*columns], names=[*keys, vec])
        out: list = [None] * len(batch)
        for key, rows in sums.grouped(batch, keys):
            for place, row in zip(rows.tolist(), sums.matrix(batch.column(vec).take(pa.array(rows))) @ axes[key].T):
                out[place] = row
        return pa.array(out, pa.list_(pa.float64()))

    projected = scaled.withColumn(vec, F.arrow_udf(project, "array<double>")(*[F.col(c) for c in (*keys, vec)]))
    info = points.sparkSession.createDataFrame([(*(r[c] for c in keys), r["k"], r["share"]) for r in fitted], T.StructType([*fields, T.StructField("pca_components", T.IntegerType()), T.StructField("pca_explained_variance_ratio_sum", T.DoubleType())]))
    return projected, info


def nonzero_tokens(expr: DataFrame, panel: DataFrame, keys: list[str], spec: str = "", value: str = "cnt") -> DataFrame:
    """Ragged non-zero values with their panel positions, then the target and source depth
    tokens at the two positions after the panel; padded with (0, −1) to the longest cell."""
    clean = expr.join(panel, "gene").groupBy(*keys, "pos").agg(F.max(F.greatest(F.col(value).cast("double"), dbl(0))).alias("v")).where(F.col("v") > 0)
    # At most one entry per panel gene and entity.
    packed = clean.groupBy(*keys).agg(F.sum("v").alias("total"), F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "v"))).alias("_t"))
    width = panel.agg(F.count(F.lit(1)).alias("n")).scalar()
    norm = F.transform("_t", lambda t: F.struct(t["pos"].alias("pos"), F.log1p(t["v"] / F.col("total") * dbl(CP10K_SCALE)).alias("v")))
    depth = F.array(
        F.struct(F.col("_w").alias("pos"), scalars.target_depth("total", F.lit(spec)).alias("v")),
        F.struct((F.col("_w") + 1).alias("pos"), scalars.source_depth("total").alias("v")))
    ragged = packed.withColumn("_w", width).withColumn("tokens", F.concat(norm, F.filter(depth, lambda t: t["v"] > 0)))
    longest = ragged.agg(F.max(F.size("tokens")).alias("n")).scalar()
    pad = F.array_repeat(F.struct(F.lit(-1).cast("long").alias("pos"), dbl(0).alias("v")), F.col("_max") - F.size("tokens"))
    return ragged.withColumn("_max", longest).select(*keys, "total", F.size("tokens").alias("length"), F.concat("tokens", pad).alias("tokens"))


def platform_auc(points: DataFrame, label: str = "label", seed: int = 0, c: float = 1.0, by: tuple[str, ...] = (), iterations: int = 50) -> DataFrame:
    """(by…, platform_auc): mean ROC AUC of a logistic regression over stratified folds, for all groups at once.

    Two to five folds, dealt by id hash; null unless a group has two labels with two rows each. Rows with a null label or
    vector take no part. Every Newton step is one pass over the points: a task adds up gradient and Hessian of each (group,
    fold) that is not yet at its optimum, and the driver solves for the next coefficients, which are all it holds.
    """
    keys = list(by)
    usable = points.where(F.col(label).isNotNull() & F.col("vec").isNotNull())
    counts = usable.groupBy(*keys, F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("n"))
    folds = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_labels"), F.max("_label").alias("_one"), F.greatest(F.lit(2), F.least(F.lit(5), F.min("n"))).cast("int").alias("_folds"), F.min("n").alias("_least"))
    folds = folds.where((F.col("_labels") == 2) & (F.col("_least") >= 2)).select(*keys, "_one", "_folds")
    if not keys:
        usable, folds, counts = (d.withColumn("_all", F.lit(0)) for d in (usable, folds, counts))
    groups = keys or ["_all"]
    dealt = usable.join(folds, groups).select(*groups, "id", vectors.as_doubles("vec").alias("vec"), (F.col(label) == F.col("_one")).cast("double").alias("y"), "_folds")
    # Every step reads the dealt rows.
    dealt = stage(splits.stratified_folds(dealt, "y", F.col("_folds"), seed, "id", by=tuple(groups)))
    listed = dealt.groupBy(*groups).agg(F.max("_folds").alias("folds"), F.max(F.size("vec")).alias("d")).collect()
    weights = {(*(r[g] for g in groups), f): np.zeros(r["d"] + 1) for r in listed for f in range(r["folds"])}
    weights = _newton(dealt, groups, weights, c, iterations)

    def held_out(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([*columns], names=[*groups, "fold", "vec"])
        out = np.zeros(len(batch))
        for key, rows in sums.grouped(batch, [*groups, "fold"]):
            w = weights[key]
            out[rows] = sums.matrix(batch.column("vec").take(pa.array(rows))) @ w[:-1] + w[-1]
        return pa.array(out)

    score = F.arrow_udf(held_out, "double")(*[F.col(g) for g in groups], F.col("fold"), F.col("vec"))
    scored = dealt.select(*groups, "fold", F.col("y").cast("int").alias("label"), score.alias("score"))
    aucs = ranking.auc_by_rank(scored, group=[*groups, "fold"]).groupBy(*groups).agg(F.avg("auc").alias("platform_auc"))
    every = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select(F.lit(0).alias("_all"))
    return every.join(aucs, groups, "left").select(*keys, "platform_auc")


def _newton(dealt: DataFrame, groups: list[str], weights: dict[tuple, np.ndarray], c: float, iterations: int) -> dict[tuple, np.ndarray]:
    """Coefficients (intercept last, not penalised) that minimise log loss + |w|² / 2c over the rows outside each fold."""
    fold = T.StructField("_model", T.IntegerType())

    def objective(tried: dict[tuple, np.ndarray]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
        def terms(key, columns):
            x = np.column_stack([columns["vec"], np.ones(len(columns["vec"]))])
            for f in sorted(k[-1] for k in tried if k[:-1] == key):
                rows = columns["fold"] != f
                z = x[rows] @ tried[(*key, f)]
                p, y = 1 / (1 + np.exp(-np.clip(z, -500, 500))), columns["y"][rows]
                loss = np.logaddexp(0.0, z) - y * z
                yield (f,), np.concatenate([[loss.sum()], x[rows].T @ (p - y), ((x[rows] * (p * (1 - p))[:, None]).T @ x[rows]).reshape(-1)]), int(rows.sum())

        out = {}
        for r in sums.sums_of(dealt, groups, terms, ["vec", "y", "fold"], [fold]).collect():
            key = (*(r[g] for g in groups), r["_model"])
            w, s = tried[key], np.array(r["sums"])
            penalty = np.append(w[:-1], 0.0) / c
            size = len(w)
            hessian = s[1 + size:].reshape(size, size) + np.diag(np.append(np.full(size - 1, 1 / c), 0.0))
            out[key] = s[0] + float(w[:-1] @ w[:-1]) / (2 * c), s[1:1 + size] + penalty, hessian
        return out

    now = objective(weights) if weights else {}
    open_ = set(now)
    step = {k: 1.0 for k in open_}
    for _ in range(iterations):
        open_ = {k for k in open_ if np.abs(now[k][1]).max() > 1e-8 * max(1.0, abs(now[k][0])) and step[k] > 1e-6}
        if not open_:
            break
        tried = {k: weights[k] - step[k] * np.linalg.lstsq(now[k][2], now[k][1], rcond=None)[0] for k in open_}
        for key, found in objective(tried).items():
            if found[0] <= now[key][0]:
                weights[key], now[key], step[key] = tried[key], found, 1.0
            else:
                step[key] /= 2
    return weights
