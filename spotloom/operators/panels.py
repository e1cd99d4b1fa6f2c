"""Gene panels: set operations, alignment, and long/vector reshaping.

A panel is ``(pos, gene)``. Dense output holds the panel once per entity, so there the
panel may travel as one array value too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spotloom.functions.scalars import dbl
from spotloom.operators import filters, ranking


def distinct_keep_order(df: DataFrame, value: str, pos: str = "pos") -> DataFrame:
    """One row per value at its first position."""
    return df.groupBy(value).agg(F.min(pos).alias(pos))


def renumber(panel: DataFrame) -> DataFrame:
    """Positions 0..n-1 in the present order (range by range, no single-task sort)."""
    ranged = ranking.range_of(panel, "pos", "_rng")
    return ranking.spread_rank(ranged, [], "_rng", ["pos", "gene"], "_new").select(
        F.col("_new").alias("pos"), "gene")


def shared_genes(samples: DataFrame, first_sample, *, remove_control: bool = False, sample: str = "sample_id") -> DataFrame:
    """Genes found in every sample, ordered as in ``first_sample``. ``samples``: sample, pos, gene."""
    rows = filters.drop_control_features(samples, "gene") if remove_control else samples
    total = samples.agg(F.count_distinct(sample).alias("n")).scalar()
    return (
        rows.groupBy("gene")
        .agg(F.count_distinct(sample).alias("_in"),
             F.min(F.when(F.col(sample) == F.lit(first_sample), F.col("pos"))).alias("pos"))
        .withColumn("_all", total)
        .where(F.col("_in") == F.col("_all"))
        .select("pos", "gene")
    )


def overlap_genes(panel: DataFrame, sample_genes: DataFrame) -> DataFrame:
    """Panel genes that the sample measured, panel positions kept."""
    return panel.join(sample_genes.select("gene"), "gene", "left_semi").select("pos", "gene")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fails the query when ``df`` has no rows; otherwise returns it unchanged."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        df.withColumn("_n", n)
        .unionByName(
            df.sparkSession.range(1).select(
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields],
                F.when(n == 0, F.raise_error(F.lit(message)).cast("long")).alias("_n"))
            .where(F.col("_n").isNotNull())
        )
        .drop("_n")
    )


def panel_array(panel: DataFrame) -> Column:
    """The panel's genes in order, as a scalar-subquery array."""
    genes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda g: g["gene"])
    return panel.agg(genes.alias("genes")).scalar()


def last_value_per_gene(expr: DataFrame, keys: list[str], value: str = "cnt", pos: str | None = None) -> DataFrame:
    """One value per (entity, gene): where a source repeats a gene name, the later column wins."""
    best = F.max_by(value, pos) if pos else F.max(value)
    return expr.groupBy(*keys, "gene").agg(best.alias(value))


def to_dense(expr: DataFrame, panel: DataFrame, keys: list[str], value: str = "cnt", name: str = "expression") -> DataFrame:
    """Long rows to one panel-ordered vector per entity, missing genes 0.

    The per-entity collection holds at most one entry per panel gene.
    """
    on_panel = expr.join(panel.select("gene"), "gene", "left_semi")
    single = on_panel.groupBy(*keys, "gene").agg(F.max(value).cast("double").alias(value))
    packed = single.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("gene", value))).alias("_m"))
    entities = expr.select(*keys).distinct()
    return (
        entities.join(packed, keys, "left")
        .withColumn("_panel", panel_array(panel))
        .select(*keys, F.transform("_panel", lambda g: F.coalesce(F.try_element_at("_m", g), dbl(0))).alias(name))
    )


def align_to_panel(expr: DataFrame, panel: DataFrame, keys: list[str], value: str = "cnt", pos: str | None = None) -> DataFrame:
    """Long rows with one slot per (entity, panel gene): (keys…, pos, gene, value)."""
    source = last_value_per_gene(expr, keys, value, pos)
    dense = to_dense(source, panel, keys, value, "_dense")
    return (
        dense.withColumn("_panel", panel_array(panel))
        .select(*keys, F.posexplode(F.arrays_zip(F.col("_panel").alias("gene"), F.col("_dense").alias("value"))).alias("pos", "_slot"))
        .select(*keys, F.col("pos").cast("long").alias("pos"), F.col("_slot.gene").alias("gene"), F.col("_slot.value").alias(value))
    )


def wide_to_long(df: DataFrame, keys: list[str], genes: list[str], value: str = "expression") -> DataFrame:
    return df.unpivot(keys, genes, "gene", value)


def to_wide(expr: DataFrame, keys: list[str], genes: list[str], value: str = "cnt") -> DataFrame:
    """One column per listed gene; for short lists."""
    return expr.groupBy(*keys).pivot("gene", genes).agg(F.max(value)).fillna(0, genes)


def stack_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def joint_bank(frames: dict[str, DataFrame], codes: dict[str, int]) -> DataFrame:
    """Union of the platforms' tables with ``platform_id`` and ``source``."""
    return stack_frames([
        df.withColumn("platform_id", F.lit(codes[name])).withColumn("source", F.lit(name)) for name, df in frames.items()
    ])


def evaluation_bank(joint: DataFrame, mode: str, target: str) -> DataFrame:
    if mode == "joint":
        return joint
    if mode == "target":
        return joint.where(F.col("source") == target)
    raise ValueError("evaluation bank must be target or joint")


def rename_for_compare(df: DataFrame, source: str) -> DataFrame:
    """Columns of a spot table under the names the comparison uses; ``n_counts`` stands in for a missing total."""
    df = df.withColumnsRenamed({"spot_id": "obs_name", "transcript_count": "total_counts"})
    if "n_counts" in df.columns:
        total = F.coalesce("total_counts", "n_counts") if "total_counts" in df.columns else F.col("n_counts")
        df = df.withColumn("total_counts", total)
    for missing in ("total_counts", "n_genes_by_counts", "cell_count"):
        if missing not in df.columns:
            df = df.withColumn(missing, F.lit(None).cast("long"))
    return df.select("obs_name", F.lit(source).alias("source"), "total_counts", "n_genes_by_counts", "cell_count")
