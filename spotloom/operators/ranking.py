"""Ranks, prefix sums and quantiles that never funnel a group through one task.

A plain window over ``(group)`` or over the whole table sorts the group in one
task. Here the order is first cut into ranges; ranges are ranked on their own and
shifted by the totals of the ranges before them, so a group holding a third of
all rows is spread over as many tasks as it has ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.session import stage


def _before(group: list[str], order: str):
    return Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(side, keys)


def prefix_sums(df: DataFrame, group: list[str], rng: str, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """Adds, per entry ``new: value`` of ``sums``, the sum of ``value`` over all earlier rows of the group.

    ``rng`` is a range column that never decreases along ``order`` inside a group.
    """
    totals = df.groupBy(*group, rng).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()])
    starts = totals.select(
        *group, rng, *[F.coalesce(F.sum(f"_t_{n}").over(_before(group, rng)), F.lit(0)).alias(f"_s_{n}") for n in sums]
    )
    inner = Window.partitionBy(*group, rng).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = _attach(df, starts, [*group, rng])
    for name, value in sums.items():
        out = out.withColumn(name, F.col(f"_s_{name}") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.drop(*[f"_s_{n}" for n in sums])


def spread_rank(df: DataFrame, group: list[str], rng: str, order: list[Column | str], name: str) -> DataFrame:
    """0-based dense row number inside the group."""
    counts = df.groupBy(*group, rng).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*group, rng, F.coalesce(F.sum("_n").over(_before(group, rng)), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(*group, rng).orderBy(*order)
    return (
        _attach(df, starts, [*group, rng])
        .withColumn(name, F.col("_start") + F.row_number().over(inner) - 1)
        .drop("_start")
    )


def range_of(df: DataFrame, value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds a range number from approximate quantiles of ``value``.

    Where the cuts fall changes only the balance of the tasks, not any result.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    cuts = df.agg(F.percentile_approx(value, shares, 1000).alias("cuts")).scalar()
    return (
        df.withColumn("_cuts", cuts)
        .withColumn(name, F.size(F.filter("_cuts", lambda c: c <= F.col(value))))
        .drop("_cuts")
    )


def exact_median(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group without holding a group's values in one buffer.

    Counts and their ranges are staged: the cuts, the totals, the ranks and the sizes read them, and each would compute
    ``value`` and the ranges of all rows again.
    """
    counts = stage(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n")))
    ranked = prefix_sums(stage(range_of(counts, value, "_rng")), group, "_rng", [value], {"_below": "_n"})
    sizes = counts.groupBy(*group).agg(F.sum("_n").alias("_size"))
    low, high = F.expr("(_size - 1) div 2"), F.expr("_size div 2")
    covers = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("_n"))
    return (
        ranked.join(sizes, group)
        .groupBy(*group)
        .agg(((F.max(F.when(covers(low), F.col(value))) + F.max(F.when(covers(high), F.col(value)))) / F.lit(2.0)).alias(name))
    )


def auc_by_rank(scores: DataFrame, score: str = "score", label: str = "label", group: list[str] | None = None) -> DataFrame:
    """ROC AUC (ties count half) from counts per distinct score; null unless both classes occur."""
    group = group or []
    tied = scores.groupBy(*group, score).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("_pos"), F.sum((F.col(label) != 1).cast("long")).alias("_neg")
    )
    ranked = prefix_sums(range_of(tied, score, "_rng"), group, "_rng", [score], {"_neg_below": "_neg"})
    wins = F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.nullif(F.sum("_pos").cast("double") * F.sum("_neg").cast("double"), F.lit(0.0))
    return ranked.groupBy(*group).agg((wins / pairs).alias("auc"))


def head_per_group(df: DataFrame, group: list[str], order: list[Column | str], n: int | None) -> DataFrame:
    """First ``n`` rows per group; 0 or None means no cap.

    The rank filter plans as a partial group limit before the shuffle.
    """
    if not n:
        return df
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= int(n)).drop("_rank")
