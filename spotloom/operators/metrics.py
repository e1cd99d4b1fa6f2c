"""Pearson scores, coverage, fold summaries and loss histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.constants import NORM_FLOOR
from spotloom.functions.scalars import dbl
from spotloom.session import one_row


def _safe_ratio(cov: Column, var_x: Column, var_y: Column, n: Column) -> Column:
    """Correlation, 0 when the norms of the centred vectors multiply to almost nothing."""
    spread = F.sqrt(var_x) * F.sqrt(var_y)
    return F.when(n * spread < dbl(NORM_FLOOR), dbl(0)).otherwise(F.coalesce(cov / F.nullif(spread, dbl(0)), dbl(0)))


def pearson(pred: str = "pred", target: str = "target") -> Column:
    x, y = F.col(pred).cast("double"), F.col(target).cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.coalesce(_safe_ratio(F.covar_pop(x, y), F.var_pop(x), F.var_pop(y), F.count(x).cast("double")), dbl(0))


def pearson_overall(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by).agg(pearson().alias("overall_pearson"))


def pearson_by_gene(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return pairs.groupBy(*by, "gene").agg(pearson().alias("pearson"))


def pearson_by_entity(pairs: DataFrame, by: tuple[str, ...] = (), entity: str = "entity_id") -> DataFrame:
    return pairs.groupBy(*by, entity).agg(pearson().alias("pearson"))


def _moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, means, variances and covariance of the pairs that have both values."""
    x, y = F.col("pred").cast("double"), F.col("target").cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return pairs.groupBy(*keys).agg(
        F.count(x).cast("double").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))


def _with_zeros(moments: DataFrame, size: Column) -> DataFrame:
    """Moments after zero pairs have filled each group up to ``size``: a block of mean 0 is merged in."""
    share = F.col("n") * (size - F.col("n")) / size
    spread = lambda v, a, b: ((F.col("n") * F.col(v) + share * F.col(a) * F.col(b)) / size).alias(v)
    mean = lambda m: (F.col(m) * F.col("n") / size).alias(m)
    rest = [c for c in moments.columns if c not in ("n", "mx", "my", "vx", "vy", "cxy")]
    return moments.select(*rest, size.alias("n"), mean("mx"), mean("my"), spread("vx", "mx", "mx"), spread("vy", "my", "my"), spread("cxy", "mx", "my"))


def _attach(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    return df.join(facts, by) if by else df.withColumn("_f", one_row(facts)).select("*", "_f.*").drop("_f")


def pearson_summary(pairs: DataFrame, label: str = "cell", by: tuple[str, ...] = (), entity: str = "entity_id", sizes: DataFrame | None = None) -> DataFrame:
    """One row per ``by``: overall, mean and population spread over genes and over entities, sizes.

    The overall value is pooled from the per-gene moments, so the table is aggregated
    twice (by gene, by entity), not three times. With ``sizes`` (by…, entities, genes)
    the pairs are the stored ones of a full grid whose other slots are zero; those slots
    enter through their numbers.
    """
    by = list(by)
    gene, ent = _moments(pairs, [*by, "gene"]), _moments(pairs, [*by, entity])
    if sizes is not None:
        sizes = sizes.select(*by, F.col("entities").cast("double").alias("_entities"), F.col("genes").cast("double").alias("_genes"))
        gene = _with_zeros(_attach(gene, sizes, by), F.col("_entities"))
        ent = _with_zeros(_attach(ent, sizes, by), F.col("_genes"))
    ratio = _safe_ratio(F.col("cxy"), F.col("vx"), F.col("vy"), F.col("n"))
    gene, ent = gene.withColumn("r", ratio), ent.withColumn("r", F.coalesce(ratio, dbl(0)))
    # Slots of genes and entities without any stored pair.
    grid = F.sum("n") if sizes is None else F.max("_entities") * F.max("_genes")
    center = gene.groupBy(*by).agg(
        grid.alias("total"), (F.sum(F.col("n") * F.col("mx")) / grid).alias("gx"), (F.sum(F.col("n") * F.col("my")) / grid).alias("gy"))
    gene = _attach(gene, center, by)
    dx, dy, n = F.col("mx") - F.col("gx"), F.col("my") - F.col("gy"), F.col("n")
    bare = F.max("total") - F.sum("n")
    part = lambda v, a, b, ga, gb: (F.sum(n * (F.col(v) + a * b)) + bare * F.max(ga) * F.max(gb)) / F.max("total")
    pooled = _safe_ratio(part("cxy", dx, dy, "gx", "gy"), part("vx", dx, dx, "gx", "gx"), part("vy", dy, dy, "gy", "gy"), F.max("total"))

    def over(rows: DataFrame, all_of: str, name: str, count: str, *more: Column) -> DataFrame:
        stored = F.count("r").cast("double")
        whole = stored if sizes is None else F.max(all_of)
        mean = F.coalesce(F.sum("r") / F.nullif(whole, dbl(0)), dbl(0))
        square = stored * F.var_pop("r") + stored * (whole - stored) / whole * F.avg("r") * F.avg("r")
        number = F.count(F.lit(1)) if sizes is None else F.max(all_of).cast("long")
        return rows.groupBy(*by).agg(*more, mean.alias(f"mean_{name}_pearson"), F.coalesce(F.sqrt(square / whole), dbl(0)).alias(f"std_{name}_pearson"), number.alias(count))

    genes = over(gene, "_genes", "gene", "num_genes", F.coalesce(pooled, dbl(0)).alias("overall_pearson"))
    entities = over(ent, "_entities", label, f"num_{label}s")
    columns = [*by, "overall_pearson", "mean_gene_pearson", "std_gene_pearson", "num_genes"]
    if sizes is None:
        return _attach(genes.select(*columns), entities, by)
    # A group without stored pairs scores zero.
    both = _attach(genes.select(*columns), entities, by)
    if by:
        out = sizes.join(both, by, "left")
    else:
        out = sizes.withColumn("_b", one_row(both)).select("*", "_b.*").drop("_b")
    filled = out.withColumn("num_genes", F.col("_genes").cast("long")).withColumn(f"num_{label}s", F.col("_entities").cast("long")).drop("_entities", "_genes")
    return filled.fillna(0.0).select(*both.columns)


def coverage_stats(spots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``spots``: one row per candidate spot with ``cells_per_spot``."""
    covered = F.col("cells_per_spot") > 0
    cells = F.when(covered, F.col("cells_per_spot").cast("double"))
    return spots.groupBy(*by).agg(
        F.count_if(covered).alias("evaluated_spots"), F.count(F.lit(1)).alias("candidate_spots"),
        F.avg(covered.cast("double")).alias("spot_coverage"),
        F.avg(cells).alias("cells_per_spot_mean"), F.stddev_pop(cells).alias("cells_per_spot_std"))


def multi_sample_summary(metrics: DataFrame) -> DataFrame:
    names = ("overall_pearson", "mean_gene_pearson", "mean_spot_pearson")
    stats = [f(F.col(c)).alias(f"{p}_{c}") for c in names for p, f in (("average", F.avg), ("std", F.stddev_pop))]
    return metrics.agg(
        F.count(F.lit(1)).alias("num_samples"), *stats, F.avg("spot_coverage").alias("average_spot_coverage"),
        F.bool_and("count_semantics_verified").alias("count_semantics_verified"))


def fold_summary(metrics: DataFrame, values: list[str], by: tuple[str, ...] = (), fold: str = "fold") -> DataFrame:
    """Mean, population spread and the values in fold order, per group. One row per fold goes in."""
    parts = [F.count(F.lit(1)).alias("num_folds")]
    for v in values:
        parts += [
            F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std"),
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(fold), F.col(v)))), lambda s: s[v]).alias(f"{v}_values"),
        ]
    return metrics.groupBy(*by).agg(*parts)


def weighted_mean(df: DataFrame, value: str, weight: str | Column, by: list[str], name: str = "mean") -> DataFrame:
    """Sum of value·weight over a weight sum of at least one."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    return df.groupBy(*by).agg(
        (F.sum(F.col(value) * weight) / F.greatest(F.sum(weight).cast("double"), dbl(1))).alias(name))


def best_epoch(history: DataFrame, by: list[str], loss: str = "loss", epoch: str = "epoch") -> DataFrame:
    best = F.min(F.struct(loss, epoch))
    return history.groupBy(*by).agg(best.alias("_b")).select(*by, F.col(f"_b.{epoch}").alias("best_epoch"), F.col(f"_b.{loss}").alias("best_loss"))


def metric_delta(metrics: DataFrame, first: str, last: str, values: list[str], keys: list[str], stage: str = "stage") -> DataFrame:
    """Last-stage minus first-stage value per (keys, metric); pairs with a missing end are skipped."""
    long = metrics.unpivot([*keys, stage], values, "metric", "value")
    return (
        long.groupBy(*keys, "metric")
        .agg((F.max(F.when(F.col(stage) == last, F.col("value"))) - F.max(F.when(F.col(stage) == first, F.col("value")))).alias("delta"))
        .where(F.col("delta").isNotNull())
    )


def history_curves(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """Train and test loss side by side; the shorter curve is padded with nulls."""
    return train.join(test, [*by, "epoch"], "full_outer").select(*by, "epoch", "train_loss", "test_loss")


def softmax_weights(matches: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Softmax of the matched similarities of one query (k rows)."""
    w = Window.partitionBy(*keys)
    shifted = F.exp(F.col(score) - F.max(score).over(w))
    return matches.withColumn("_e", shifted).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def stage_order(df: DataFrame, stages: tuple[str, ...], stage: str = "stage", then: str = "model") -> DataFrame:
    """Adds ``stage_pos`` and sorts by it, unknown stages last."""
    pos = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage))
    return df.withColumn("stage_pos", F.when(pos == 0, F.lit(len(stages) + 1)).otherwise(pos)).orderBy("stage_pos", then)
