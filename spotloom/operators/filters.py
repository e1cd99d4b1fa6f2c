"""Row filters and data checks (all native expressions, so they reach the scan)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spotloom.constants import CONTROL_PREFIXES
from spotloom.functions.scalars import dbl, whole_or


def is_control(name: str = "feature_name") -> Column:
    return reduce(lambda a, b: a | b, [F.col(name).startswith(p) for p in CONTROL_PREFIXES])


def drop_control_features(df: DataFrame, name: str = "feature_name") -> DataFrame:
    return df.where(~is_control(name))


def valid_cell_ids(df: DataFrame, name: str = "cell_id") -> DataFrame:
    """Keeps ids above zero. Integer columns compare directly (and push down);
    text and fractional ids are coerced first, bad ones dropping out."""
    if df.schema[name].dataType.typeName() not in ("byte", "short", "integer", "long"):
        df = df.withColumn(name, whole_or(name, "bigint", -1))
    return df.where(F.col(name) > 0)


def nucleus_only(df: DataFrame, name: str = "overlaps_nucleus") -> DataFrame:
    if df.schema[name].dataType.typeName() in ("byte", "short", "integer", "long"):
        return df.where(F.col(name) == 1)
    return df.where(whole_or(name, "int", 0) == 1)


def drop_zero_expression(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("transcript_count") > 0)


def in_tissue_only(df: DataFrame, enabled: bool = True) -> DataFrame:
    if enabled and "in_tissue" in df.columns:
        return df.where(F.col("in_tissue") > 0)
    return df


def having_min_cells(spots: DataFrame, n: int = 3) -> DataFrame:
    return spots.where(F.col("cell_count") >= max(1, int(n)))


def min_detect_fraction(summary: DataFrame, fraction: float = 0.05) -> DataFrame:
    return summary.where(F.col("overall_detect") >= dbl(fraction))


def count_like_check(expr: DataFrame, value: str = "cnt", by: tuple[str, ...] = (), limit: float = 0.001) -> DataFrame:
    """Share of positive values further than 1e-6 from a whole number, over the whole table."""
    positive = F.col(value) > 0
    off = F.abs(F.col(value).cast("double") - F.rint(F.col(value).cast("double"))) > dbl(1e-6)
    share = F.coalesce(F.sum((positive & off).cast("long")) / F.nullif(F.sum(positive.cast("long")), F.lit(0)), dbl(0))
    return (
        expr.groupBy(*by)
        .agg(share.alias("non_integer_fraction"))
        .withColumn("count_semantics_verified", F.col("non_integer_fraction") <= dbl(limit))
    )


def assert_count_like(expr: DataFrame, value: str = "cnt", by: tuple[str, ...] = ()) -> DataFrame:
    checked = count_like_check(expr, value, by)
    return checked.withColumn(
        "count_semantics_verified",
        F.when(F.col("count_semantics_verified"), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("values are not raw counts; non-integer share "),
                                   F.col("non_integer_fraction").cast("string")))
        ),
    )


def split_filter(df: DataFrame, split: str, test_fold: int, fold: str = "fold") -> DataFrame:
    if split == "train":
        return df.where(F.col(fold) != int(test_fold))
    if split == "test":
        return df.where(F.col(fold) == int(test_fold))
    if split == "all":
        return df
    raise ValueError("split must be one of: train, test, all")


def select_view(df: DataFrame, model: str | list[str] | None, view: str) -> DataFrame:
    """Rows of one view (``alignment`` is the shared one) of a model, of several, or of all."""
    view = {"alignment": "shared"}.get(view, view)
    if view not in ("fused", "shared", "private"):
        raise ValueError("view must be one of: fused, shared, private, alignment")
    chosen = df.where(F.col("view") == view)
    return chosen if model is None else chosen.where(F.col("model").isin([model] if isinstance(model, str) else list(model)))


def covered_spots(spots: DataFrame) -> DataFrame:
    return spots.where(F.col("cells_per_spot") > 0)


def usable_samples(samples: DataFrame, expr: DataFrame, panel: DataFrame, matched: DataFrame) -> DataFrame:
    """Samples with at least one panel gene and at least one matched barcode."""
    with_gene = expr.join(panel.select("gene"), "gene", "left_semi").select("sample_id").distinct()
    return (
        samples.join(with_gene, "sample_id", "left_semi")
        .join(matched.select("sample_id").distinct(), "sample_id", "left_semi")
    )
