"""Folds, train/test splits and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.constants import NORM_FLOOR
from spotloom.functions.scalars import dbl
from spotloom.operators import ranking
from spotloom.session import one_row


def fold_edges(df: DataFrame, x: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by…, x_min, x_max, edges) of ``n`` equal-width bands."""
    ext = df.groupBy(*by).agg(F.min(x).cast("double").alias("x_min"), F.max(x).cast("double").alias("x_max"))
    lo, hi = F.col("x_min"), F.col("x_max")
    step = (hi - lo) / dbl(max(n, 1))
    edges = F.transform(F.sequence(F.lit(0), F.lit(max(n, 1))), lambda i: F.when(i == max(n, 1), hi).otherwise(lo + i * step))
    return ext.withColumn("edges", edges)


def position_folds(df: DataFrame, x: str, n: int, name: str = "fold", by: tuple[str, ...] = ()) -> DataFrame:
    """Band of ``x``: the number of interior edges not above it; one band when n ≤ 1 or x is constant."""
    edges = fold_edges(df, x, n, by)
    if by:
        out = df.join(edges.select(*by, F.struct("x_min", "x_max", "edges").alias("_b")), list(by))
    else:
        out = df.withColumn("_b", one_row(edges))
    flat = F.abs(F.col("_b.x_max") - F.col("_b.x_min")) < dbl(NORM_FLOOR)
    if n <= 1:
        fold = F.lit(0)
    else:
        passed = [(F.get("_b.edges", F.lit(i)) <= F.col(x)).cast("int") for i in range(1, n)]
        fold = F.when(flat, F.lit(0)).otherwise(sum(passed[1:], passed[0]))
    return out.withColumn(name, fold.cast("int")).drop("_b")


def fold_sizes(df: DataFrame, fold: str = "fold") -> DataFrame:
    return df.groupBy(F.concat(F.lit("fold_"), F.col(fold).cast("string")).alias("fold_key")).agg(F.count(F.lit(1)).alias("n"))


def leave_one_out_split(obs: DataFrame, test_samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Adds ``split``: test when the sample is listed, train otherwise."""
    listed = test_samples.select(sample).distinct().withColumn("_test", F.lit(True))
    return obs.join(listed, sample, "left").withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def two_set_split(obs: DataFrame, test_samples: DataFrame, train_samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Test list first, then train list; samples on neither are dropped."""
    roles = (
        test_samples.select(sample, F.lit(0).alias("_r"))
        .unionByName(train_samples.select(sample, F.lit(1).alias("_r")))
        .groupBy(sample).agg(F.min("_r").alias("_r"))
    )
    return obs.join(roles, sample).withColumn("split", F.when(F.col("_r") == 0, "test").otherwise("train")).drop("_r")


def require_both_sides(split: DataFrame) -> DataFrame:
    """Fails the query when train or test is empty."""
    sizes = split.agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    return split.withColumn("_s", one_row(sizes)).where(
        F.when((F.col("_s.train") > 0) & (F.col("_s.test") > 0), F.lit(True)).otherwise(
            F.raise_error(F.lit("train or test split is empty")).cast("boolean"))
    ).drop("_s")


def leave_one_out_plan(samples: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One fold per sample: (fold_index, held_out, sample_id, role), samples numbered in order.

    The list is one value handed to every fold row, so it must stay a list of samples.
    """
    ids = samples.agg(F.array_sort(F.collect_set(sample)).alias("ids"))
    return (
        ids.select("ids", F.posexplode("ids").alias("fold_index", "held_out"))
        .select("fold_index", "held_out", F.explode("ids").alias(sample))
        .withColumn("role", F.when(F.col(sample) == F.col("held_out"), "test").otherwise("train"))
    )


def skip_completed(folds: DataFrame, done: DataFrame, key: str = "fold") -> DataFrame:
    return folds.join(done.select(key), key, "left_anti")


def sample_key(ident: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f"|{seed}")))


def sample_n(df: DataFrame, n: int, seed: int, ident: str, held: int = 4096) -> DataFrame:
    """Uniform sample of ``n`` rows without replacement, by hash of the id; everything when ``n`` ≤ 0.

    Rows are not ordered: counts by the first figures of the hash tell where the sample ends, and are refined there until
    at most ``held`` hashes are left to look at. The sample is then a comparison with the last hash that belongs to it.
    """
    if n <= 0:
        return df
    keyed = df.withColumn("_key", sample_key(ident, seed))
    prefix, taken = "", 0
    while True:
        figures = len(prefix) + 3
        counts = keyed.where(F.col("_key").startswith(prefix)).groupBy(F.substring("_key", 1, figures).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        for p, size in sorted(map(tuple, counts.collect())):  # at most 4,096 rows
            if taken + size >= n:
                break
            taken += size
        else:
            return df
        prefix = p
        if size <= held or figures >= 32:
            break
    if taken + size == n:
        return keyed.where(F.col("_key") < prefix + "g").drop("_key")  # all of them: "g" is after every figure
    ends = keyed.where(F.col("_key").startswith(prefix)).groupBy("_key").agg(F.count(F.lit(1)).alias("n")).collect()
    for last, size in sorted(map(tuple, ends)):
        if taken + size >= n:
            break
        taken += size
    if taken + size == n:
        return keyed.where(F.col("_key") <= last).drop("_key")
    # An id that repeats: some of its rows complete the sample.
    return keyed.where(F.col("_key") < last).unionByName(keyed.where(F.col("_key") == last).limit(n - taken)).drop("_key")


def sample_n_per(df: DataFrame, keys: list[str], n: int, seed: int, ident: str) -> DataFrame:
    """As ``sample_n`` within each group of ``keys``; the groups enter the hash, so equal ids draw apart."""
    if n <= 0:
        return df
    key = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in (*keys, ident)], F.lit(str(seed))))
    return ranking.head_per_group(df, keys, [key, ident], n)


def sample_per_stratum(df: DataFrame, keys: list[str], caps: dict[tuple, int], seed: int, ident: str) -> DataFrame:
    """Caps per stratum; a stratum without a cap, or with cap 0, is kept whole."""
    cap = F.lit(0)
    for values, limit in caps.items():
        match = F.lit(True)
        for key, value in zip(keys, values):
            match = match & (F.col(key) == F.lit(value))
        cap = F.when(match, F.lit(int(limit))).otherwise(cap)
    marked = df.withColumn("_cap", cap)
    largest = max([0, *caps.values()])
    open_rows = marked.where(F.col("_cap") <= 0)
    if largest == 0:
        return open_rows.drop("_cap")
    w = Window.partitionBy(*keys).orderBy(sample_key(ident, seed), ident)
    # The constant bound lets the rank filter run as a partial limit before the shuffle.
    capped = (
        marked.where(F.col("_cap") > 0).withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= largest).where(F.col("_r") <= F.col("_cap")).drop("_r")
    )
    return open_rows.unionByName(capped).drop("_cap")


def stratified_folds(df: DataFrame, label: str, n: int | Column, seed: int, ident: str, name: str = "fold", by: tuple[str, ...] = ()) -> DataFrame:
    """Balanced folds inside each label, dealt out in hash order."""
    keyed = df.withColumn("_key", sample_key(ident, seed)).withColumn("_slice", F.substring("_key", 1, 3))
    ranked = ranking.spread_rank(keyed, [*by, label], "_slice", ["_key", ident], "_r")
    return ranked.withColumn(name, (F.col("_r") % F.lit(n)).cast("int")).drop("_key", "_slice", "_r")
