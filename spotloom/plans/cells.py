"""Jobs from molecules to cells and pseudo-spots, and the measured-spot index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from spotloom.operators import counting, filters, normalization, spatial, splits
from spotloom.session import one_row, stage
from spotloom.sources.tables import gene_panel_from_transcripts


@dataclass
class CellTables:
    counts: DataFrame
    cells: DataFrame
    panel: DataFrame
    manifest: DataFrame


@dataclass
class SpotTables:
    spots: DataFrame
    membership: DataFrame
    counts: DataFrame
    manifest: DataFrame


@dataclass
class GridParameters:
    """Pixel geometry of the pseudo-spot grid."""

    radius: float
    spacing: float
    layout: str


def _beside(df: DataFrame, facts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """``df`` with the columns of ``facts``: one row, or one row a group."""
    return df.join(facts, list(by), "left") if by else df.withColumn("_f", one_row(facts)).select("*", "_f.*").drop("_f")


def prepare_cells(
    transcripts: DataFrame, cells: DataFrame, panel: DataFrame | None = None, *, remove_control: bool = True,
    only_nucleus: bool = False, drop_zero: bool = True, folds: int = 5, order: str | None = None, by: tuple[str, ...] = (),
) -> CellTables:
    """Counts per (cell, gene), cells with totals and position folds, the panel and a manifest row.

    ``cells`` carries cell_id, centroid_x, centroid_y. Cells without molecules leave
    before the folds are drawn. Counts and kept cells are staged, so the molecules are
    scanned once however many results are read. Without a ``panel`` it is every feature of the
    molecules in first-seen order, by the column ``order`` or by the order of the scan.
    With ``by`` (columns of both tables, such as sample_id) all samples are prepared in one job, each as if alone.
    """
    keys = list(by)
    counts = stage(counting.cell_gene_counts(transcripts, cells, panel, remove_control=remove_control, only_nucleus=only_nucleus, by=by))
    kept = stage(counting.attach_counts(cells, counts, drop_zero, by))
    folded = splits.position_folds(kept, "centroid_x", folds, "position_fold", by)
    if panel is None:
        rows = transcripts if order else transcripts.withColumn("_row", F.monotonically_increasing_id())
        genes = gene_panel_from_transcripts(rows, order or "_row", remove_control, by)
    else:
        genes = panel
    own = [c for c in keys if c in genes.columns]
    numbers = genes.groupBy(*own).agg(F.count_distinct("gene").alias("num_genes"))
    sizes = folded.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_cells_after_filtering"))
    facts = _beside(_beside(sizes, numbers, tuple(own)), splits.fold_edges(kept, "centroid_x", folds, by), by)
    manifest = facts.select(
        *keys, "num_cells_after_filtering", "num_genes", F.col("edges").alias("position_fold_edges"),
        F.coalesce("x_min", F.lit(0.0)).alias("x_low"), F.coalesce("x_max", F.lit(0.0)).alias("x_high"),
        F.lit(remove_control).alias("remove_control_features"), F.lit(only_nucleus).alias("nucleus_only"),
        F.lit(drop_zero).alias("drop_zero_expression"))
    return CellTables(counts, folded, genes, manifest)


def grid_parameters(reference: DataFrame, imaging: DataFrame, layout: str = "auto", use_inter_spot: bool = True) -> GridParameters:
    """Geometry from the two resolved sample-metadata rows (one row each, read on the driver)."""
    ref, img = reference.first(), imaging.first()
    pixel = img["pixel_size_um"]
    spacing_um = ref["inter_spot_dist_um"] if use_inter_spot else ref["spot_diameter_um"]
    name = layout.strip().lower()
    if name == "auto":
        name = "hex" if "visium" in ref["technology"].lower() else "square"
    if name not in ("square", "hex"):
        raise ValueError("layout must be auto, square or hex")
    return GridParameters(ref["spot_diameter_um"] / pixel / 2.0, spacing_um / pixel, name)


def grid_table(reference: DataFrame, imaging: DataFrame, layout: str = "auto", use_inter_spot: bool = True) -> DataFrame:
    """(sample_id, radius, spacing, layout) for every sample of ``imaging`` from resolved metadata; ``reference`` has one row."""
    name = layout.strip().lower()
    if name not in ("auto", "square", "hex"):
        raise ValueError("layout must be auto, square or hex")
    ref, pixel = F.col("_r"), F.col("pixel_size_um")
    kind = F.when(F.contains(F.lower(ref["technology"]), F.lit("visium")), "hex").otherwise("square") if name == "auto" else F.lit(name)
    spacing = ref["inter_spot_dist_um" if use_inter_spot else "spot_diameter_um"] / pixel
    return imaging.withColumn("_r", one_row(reference.limit(1))).select("sample_id", (ref["spot_diameter_um"] / pixel / F.lit(2.0)).alias("radius"), spacing.alias("spacing"), kind.alias("layout"))


def build_pseudospots(cells: DataFrame, counts: DataFrame, grid: GridParameters | DataFrame, *, min_cells: int = 3, folds: int = 5, by: tuple[str, ...] = ()) -> SpotTables:
    """Pseudo-spots over the extent of ``cells``: spot table, membership, spot × gene counts, manifest row.

    With ``by`` all samples are built in one job: each has a grid over its own extent, spots numbered from 0, folds and
    offsets of its own. ``grid`` may then be a table (by…, radius, spacing, layout), one geometry a sample.
    """
    keys, at = list(by), [*by, "grid_row", "grid_col"]
    table = grid if isinstance(grid, DataFrame) else None
    if table is not None and not by:
        raise ValueError("a table of grids needs the columns it is keyed by")
    shape = (0.0, 1.0, "square") if table is not None else (grid.radius, grid.spacing, grid.layout)
    hits = stage(spatial.nearest_grid_center(cells, *shape, by=by, grids=table))
    sizes = hits.groupBy(*at).agg(
        F.first("center_x").alias("center_x"), F.first("center_y").alias("center_y"), F.count(F.lit(1)).alias("cell_count"))
    kept = stage(spatial.number_spots(filters.having_min_cells(sizes, min_cells), by))
    members = hits.select("cell_id", *at).join(kept.select(*at, "spot_id"), at).select(*keys, "spot_id", "cell_id")
    spot_counts = pseudospot_counts(members, counts, by)
    qc = spot_counts.groupBy(*keys, "spot_id").agg(F.sum("cnt").alias("transcript_count"), F.count_if(F.col("cnt") > 0).alias("n_genes_by_counts"))
    spots = splits.position_folds(
        kept.join(qc, [*keys, "spot_id"], "left").fillna(0, ["transcript_count", "n_genes_by_counts"]), "center_x", folds, "position_fold", by)
    facts = _beside(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_cells_total")), kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("spots"), F.sum("cell_count").alias("cells")), by)
    if table is None:
        facts = facts.withColumns({"radius": F.lit(grid.radius), "spacing": F.lit(grid.spacing), "layout": F.lit(grid.layout)})
    else:
        facts = facts.join(table.select(*keys, "radius", "spacing", "layout"), keys)
    assigned = F.coalesce("cells", F.lit(0)) if by else F.col("cells")
    manifest = facts.select(
        *keys, "num_cells_total", assigned.alias("num_cells_assigned"), F.coalesce("spots", F.lit(0)).alias("num_pseudospots"),
        F.col("radius").alias("spot_radius_px"), F.col("spacing").alias("center_spacing_px"),
        F.col("layout").alias("grid_layout"), F.lit(min_cells).alias("min_cells_per_spot"), F.lit(folds).alias("num_position_folds"))
    return SpotTables(spots, spatial.membership_order(members, by=by), spot_counts, manifest)


def pseudospot_counts(members: DataFrame, counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Member cells' counts summed per (by…, spot, gene)."""
    return members.join(counts, [*by, "cell_id"]).groupBy(*by, "spot_id", "gene").agg(F.sum("cnt").alias("cnt"))


def join_tiles(tiles: DataFrame, obs: DataFrame, max_per_sample: int | None = None) -> DataFrame:
    """Tiles with a measured spot of the same barcode in the same sample, in tile order."""
    from spotloom.operators.ranking import head_per_group

    joined = tiles.join(obs, ["sample_id", "barcode"])
    return head_per_group(joined, ["sample_id"], ["patch_idx"], max_per_sample)


def index_spots(
    expr: DataFrame, tiles: DataFrame, obs: DataFrame, panel: DataFrame, *, method: str = "log1p",
    max_per_sample: int | None = None, total_scope: str = "panel",
) -> tuple[DataFrame, DataFrame]:
    """(index, expression): the aligned spot index and its normalised panel expression in long form.

    ``expr``: sample_id, obs_id, gene, cnt; ``obs``: sample_id, obs_id, barcode, …
    """
    matched = join_tiles(tiles, obs, max_per_sample)
    usable = filters.usable_samples(obs.select("sample_id").distinct(), expr, panel, matched)
    index = matched.join(usable, "sample_id", "left_semi")
    norm = normalization.normalize_long(expr, ["sample_id", "obs_id"], method, panel=panel, total_scope=total_scope)
    return index, norm.join(index.select("sample_id", "obs_id"), ["sample_id", "obs_id"], "left_semi")
