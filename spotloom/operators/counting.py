"""Molecules into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotloom.operators import filters


def keep_panel(transcripts: DataFrame, panel: DataFrame) -> DataFrame:
    """Molecules whose feature is on the panel, the feature renamed to ``gene``."""
    return transcripts.withColumnRenamed("feature_name", "gene").join(panel.select("gene"), "gene", "left_semi")


def keep_cells(df: DataFrame, cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return df.join(cells.select(*by, "cell_id"), [*by, "cell_id"], "left_semi")


def cell_gene_counts(
    transcripts: DataFrame,
    cells: DataFrame | None = None,
    panel: DataFrame | None = None,
    *,
    remove_control: bool = True,
    only_nucleus: bool = False,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Molecules per (by…, cell, gene).

    Counting happens before the lookups, so a cell or feature with a very large
    share of the molecules is already one row per pair when it is shuffled to a join.
    With ``by`` (a sample, say) cell ids count within their group; a panel with these columns holds per group.
    """
    rows = filters.valid_cell_ids(transcripts)
    if remove_control:
        rows = filters.drop_control_features(rows)
    if only_nucleus:
        rows = filters.nucleus_only(rows)
    counts = rows.groupBy(*by, "cell_id", F.col("feature_name").alias("gene")).agg(F.count(F.lit(1)).alias("cnt"))
    if panel is not None:
        on = [*(c for c in by if c in panel.columns), "gene"]
        counts = counts.join(panel.select(*on), on, "left_semi")
    if cells is not None:
        counts = keep_cells(counts, cells, by)
    return counts.select(*by, "cell_id", "gene", "cnt")


def cell_qc(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return counts.groupBy(*by, "cell_id").agg(F.sum("cnt").alias("transcript_count"))


def attach_counts(cells: DataFrame, counts: DataFrame, drop_zero: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells with their molecule total; the zero filter runs before folds are drawn."""
    joined = cells.join(cell_qc(counts, by), [*by, "cell_id"], "inner" if drop_zero else "left")
    joined = joined.withColumn("transcript_count", F.coalesce("transcript_count", F.lit(0).cast("long")))
    return filters.drop_zero_expression(joined) if drop_zero else joined
