"""Differences between platforms: expression, shape, colour and embedding space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spotloom.constants import MORPHOLOGY_COLUMNS
from spotloom.functions import polygons, vectors
from spotloom.functions.scalars import dbl
from spotloom.operators import neighbors, ranking, sums
from spotloom.session import one_row


# -- expression ---------------------------------------------------------------

def gene_summary(
    expr: DataFrame, entities: DataFrame, groups: list[str], *, group: str = "technology", value: str = "cnt",
    norm: str = "norm", min_detect: float = 0.05,
) -> DataFrame:
    """Mean normalised value and detection share per gene and technology, their spread, and overall detection.

    ``expr`` holds non-zero rows only; zeros enter through the entity counts of ``entities``.
    Ordered by both differences, largest first, then gene.
    """
    sizes = entities.agg(F.count(F.lit(1)).cast("double").alias("all"), *[
        F.count_if(F.col(group) == g).cast("double").alias(f"n{i}") for i, g in enumerate(groups)])
    seen = F.col(value) > 0
    sums = expr.groupBy("gene").agg(
        F.count_if(seen).alias("_seen"),
        *[F.sum(F.when(F.col(group) == g, F.col(norm))).alias(f"_s{i}") for i, g in enumerate(groups)],
        *[F.count_if(seen & (F.col(group) == g)).alias(f"_d{i}") for i, g in enumerate(groups)],
    ).withColumn("_n", one_row(sizes))
    share = lambda part, i: F.coalesce(F.col(f"{part}{i}"), F.lit(0)) / F.nullif(F.col(f"_n.n{i}"), dbl(0))
    means = [share("_s", i) for i in range(len(groups))]
    detects = [share("_d", i) for i in range(len(groups))]
    spread = lambda cols: F.greatest(*cols) - F.least(*cols)
    out = sums.select(
        "gene",
        *[m.alias(f"{g.lower()}_mean") for g, m in zip(groups, means)],
        *[d.alias(f"{g.lower()}_detect") for g, d in zip(groups, detects)],
        spread(means).alias("abs_mean_diff"), spread(detects).alias("abs_detect_diff"),
        (F.col("_seen") / F.col("_n.all")).alias("overall_detect"),
    )
    return out.where(F.col("overall_detect") >= dbl(min_detect)).orderBy(
        F.desc("abs_mean_diff"), F.desc("abs_detect_diff"), "gene")


def gene_mean_shift(expr: DataFrame, entities: DataFrame, a: str, b: str, *, group: str = "source", norm: str = "norm") -> DataFrame:
    """Mean per gene on either side and the absolute difference, largest first."""
    sizes = entities.agg(F.count_if(F.col(group) == a).cast("double").alias("na"), F.count_if(F.col(group) == b).cast("double").alias("nb"))
    mean = lambda g, n: F.coalesce(F.sum(F.when(F.col(group) == g, F.col(norm))), dbl(0)) / F.first(f"_n.{n}")
    out = expr.withColumn("_n", one_row(sizes)).groupBy("gene").agg(mean(a, "na").alias(f"{a}_mean"), mean(b, "nb").alias(f"{b}_mean"))
    return out.withColumn("abs_mean_diff", F.abs(F.col(f"{a}_mean") - F.col(f"{b}_mean"))).orderBy(F.desc("abs_mean_diff"), "gene")


def top_shifted_genes(summary: DataFrame, k: int = 12) -> DataFrame:
    return summary.orderBy(F.desc("abs_mean_diff"), F.desc("abs_detect_diff"), "gene").limit(int(k))


def binned_density(df: DataFrame, value: str, by: list[str], bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Density per bin: (by…, bin, n, density). The last bin is closed; values outside the range are dropped.

    Without ``lo`` and ``hi`` the range is that of the whole column.
    """
    rows = df.where(F.col(value).isNotNull())
    if lo is None or hi is None:
        rows = rows.withColumn("_r", one_row(rows.agg(
            F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))))
        low, high = F.col("_r.lo"), F.col("_r.hi")
    else:
        low, high = dbl(lo), dbl(hi)
    v = F.col(value).cast("double")
    width = (high - low) / dbl(bins)
    binned = (
        rows.where((v >= low) & (v <= high))
        .withColumn("_w", width)
        .withColumn("bin", F.least(F.floor((v - low) / F.nullif(width, dbl(0))), F.lit(bins - 1)).cast("int"))
        .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("_w").alias("_w"))
    )
    # Bins are few per group, so this window never sees raw rows.
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return binned.select(*by, "bin", "n", (F.col("n") / (total * F.col("_w"))).alias("density"))


# -- shapes and crops ---------------------------------------------------------

def polygon_metadata(cells: DataFrame) -> DataFrame:
    """Centroid and bounding box per outline; ``vertices`` is one ring or the signed rings of an outline."""
    rings = polygons.as_rings("vertices", cells.schema["vertices"].dataType)
    return (
        cells.withColumn("_r", rings).withColumn("_c", polygons.centroid("_r")).withColumn("_b", polygons.bbox("_r"))
        .select(*[c for c in cells.columns if c != "vertices"],
                F.col("_c.x").alias("centroid_x"), F.col("_c.y").alias("centroid_y"),
                F.col("_b.min_x").alias("bbox_min_x"), F.col("_b.min_y").alias("bbox_min_y"),
                F.col("_b.max_x").alias("bbox_max_x"), F.col("_b.max_y").alias("bbox_max_y"))
    )


def polygon_stats(cells: DataFrame, pixel_um: float | str) -> DataFrame:
    pixel = dbl(pixel_um) if isinstance(pixel_um, (int, float)) else F.col(pixel_um)
    staged = (
        cells.withColumn("_r", polygons.as_rings("vertices", cells.schema["vertices"].dataType))
        .withColumn("_a", polygons.area("_r")).withColumn("_p", polygons.perimeter("_r")).withColumn("_b", polygons.bbox("_r"))
    )
    stats = polygons.shape_columns("_a", "_p", "_b", pixel)
    return staged.select(*[c for c in cells.columns if c != "vertices"], *[c.alias(n) for n, c in stats.items()])


def pixel_gradient(pixels: DataFrame) -> DataFrame:
    """Scaled channels, gray and gradient magnitude per pixel.

    A crop's pixels meet once, by crop; the left and upper neighbours are the rows before
    along x and along y, if they are adjacent. A crop is an image of bounded size.
    """
    scaled = pixels.select(
        "crop_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"),
        *[(F.col(c) / dbl(255)).alias(c) for c in ("r", "g", "b")])
    gray = scaled.withColumn("gray", (F.col("r") + F.col("g") + F.col("b")) / dbl(3)).repartition("crop_id")

    def before(line: str, along: str) -> Column:
        w = Window.partitionBy("crop_id", line).orderBy(along)
        return F.when(F.lag(along).over(w) == F.col(along) - 1, F.lag("gray").over(w))

    met = gray.withColumn("left", before("y", "x")).withColumn("upper", before("x", "y"))
    dx = F.coalesce(F.col("gray") - F.col("left"), dbl(0))
    dy = F.coalesce(F.col("gray") - F.col("upper"), dbl(0))
    return met.select("crop_id", "y", "x", "r", "g", "b", "gray", F.sqrt(dx * dx + dy * dy).alias("gradient"))


def crop_stats(gradients: DataFrame) -> DataFrame:
    names = {"r": "crop_r", "g": "crop_g", "b": "crop_b", "gray": "gray", "gradient": "gradient"}
    parts = [f(c).alias(f"{n}_{s}") for c, n in names.items() for s, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return gradients.groupBy("crop_id").agg(*parts)


def crop_histograms(gradients: DataFrame, bins: int = 8) -> DataFrame:
    """(crop_id, hist): densities of r, g, b, gray and gradient over 0..1, ``bins`` each.

    Bins are counted by conditional sums, so nothing is collected per crop.
    """
    channels = ("r", "g", "b", "gray", "gradient")
    slot = lambda c: F.least(F.floor(F.col(c) * bins), F.lit(bins - 1))
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) <= 1)
    counts = gradients.groupBy("crop_id").agg(*[
        F.count_if(inside(c) & (slot(c) == i)).alias(f"{c}_{i}") for c in channels for i in range(bins)])
    total = {c: sum((F.col(f"{c}_{i}") for i in range(1, bins)), F.col(f"{c}_0")).cast("double") for c in channels}
    density = [F.coalesce(F.col(f"{c}_{i}") / F.nullif(total[c] / dbl(bins), dbl(0)), dbl(0)) for c in channels for i in range(bins)]
    return counts.select("crop_id", F.array(*density).alias("hist"))


def handcrafted_features(records: DataFrame) -> DataFrame:
    """Seventeen shape and colour columns followed by the histogram bins."""
    return records.withColumn("features", vectors.concat_features(list(MORPHOLOGY_COLUMNS), "hist"))


def sample_summary(records: DataFrame, by: tuple[str, ...] = ("technology", "sample_id")) -> DataFrame:
    """Cell count, mean and exact median area, and means of size, gray and gradient per sample."""
    by = list(by)
    means = {"area_um2": "area_um2_mean", "equivalent_diameter_um": "diameter_um_mean", "bbox_width_um": "bbox_width_um_mean",
             "bbox_height_um": "bbox_height_um_mean", "gray_mean": "gray_mean_mean", "gradient_mean": "gradient_mean_mean"}
    means = {c: n for c, n in means.items() if c in records.columns}
    base = records.groupBy(*by).agg(F.count("cell_id").alias("sampled_cells"), *[F.avg(c).alias(n) for c, n in means.items()])
    return base.join(ranking.exact_median(records, by, "area_um2", "area_um2_median"), by)


def sampled_by_sample(records: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row: map of sample to row count (one entry per sample)."""
    counts = records.groupBy(sample).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(sample, "n")))).alias("sampled_by_sample"))


def attach_totals(summary: DataFrame, totals: DataFrame, sample: str = "sample_id") -> DataFrame:
    return summary.join(totals.select(sample, F.col("total").alias("total_available_cells")), sample, "left")


# -- embedding space ----------------------------------------------------------

def group_means(points: DataFrame, label: str, by: tuple[str, ...] = (), unit: bool = False) -> DataFrame:
    """(by…, label, mean): mean vectors."""
    vec = vectors.l2_normalize("vec") if unit else vectors.as_doubles("vec")
    found = sums.vector_sums(points.select(*by, label, vec.alias("vec")), [*by, label])
    return found.select(*by, label, F.transform("sums", lambda s: s / F.col("n")).alias("mean"))


def _two_groups(means: DataFrame, label: str, a, b, by: tuple[str, ...]) -> DataFrame:
    pick = lambda g: F.first(F.when(F.col(label) == g, F.col("mean")), ignorenulls=True)
    return means.groupBy(*by).agg(pick(a).alias("ma"), pick(b).alias("mb"))


def centroid_distance(points: DataFrame, label: str, a, b, by: tuple[str, ...] = ()) -> DataFrame:
    """Distance of two group means; null when a group is empty."""
    square = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x - y) * (x - y)), dbl(0), lambda s, x: s + x)
    return _two_groups(group_means(points, label, by), label, a, b, by).select(*by, F.sqrt(square).alias("centroid_distance"))


def cross_group_mean_cosine(points: DataFrame, label: str, a, b, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over all cross-group cosines, as the product of the mean unit vectors."""
    product = F.aggregate(F.zip_with("ma", "mb", lambda x, y: x * y), dbl(0), lambda s, x: s + x)
    return _two_groups(group_means(points, label, by, unit=True), label, a, b, by).select(*by, product.alias("cross_domain_mean_cosine"))


def knn_self_join(points: DataFrame, k: int, by: tuple[str, ...] = (), carry: tuple[str, ...] = (), block: int = neighbors.BLOCK) -> DataFrame:
    return neighbors.topk(points, points, k, metric="euclidean", within=list(by), exclude_self=True, carry=list(carry), block=block)


def same_label_knn_fraction(points: DataFrame, k: int = 15, label: str = "label", by: tuple[str, ...] = (), block: int = neighbors.BLOCK) -> DataFrame:
    """Mean share of the k nearest other points with the same label; null below three points or two labels."""
    by = list(by)
    near = knn_self_join(points, k, tuple(by), (label,), block).withColumnRenamed(label, "_other")
    own = points.select(*by, F.col("id").alias("query_id"), F.col(label).alias("_own"))
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_labels"))
    share = near.join(own, [*by, "query_id"]).groupBy(*by).agg(F.avg((F.col("_own") == F.col("_other")).cast("double")).alias("_share"))
    joined = sizes.join(share, by, "left") if by else sizes.withColumn("_share", share.scalar())
    return joined.select(*by, F.when((F.col("_n") >= 3) & (F.col("_labels") >= 2), F.col("_share")).alias("same_label_knn_fraction"))


def silhouette(points: DataFrame, label: str = "label", by: tuple[str, ...] = (), block: int = neighbors.BLOCK) -> DataFrame:
    """Mean silhouette (Euclidean); a point alone in its group scores 0; null unless 2 ≤ labels < points."""
    by = list(by)
    sums = neighbors.label_distance_sums(points, label, tuple(by), block)
    sizes = points.groupBy(*by, label).agg(F.count(F.lit(1)).alias("size"))
    joined = sums.join(sizes.withColumnRenamed(label, "other"), [*by, "other"])
    own = F.col("other") == F.col(label)
    per_point = joined.groupBy(*by, "id", label).agg(
        F.max(F.when(own, F.when(F.col("size") > 1, F.col("dist_sum") / (F.col("size") - 1)))).alias("a"),
        F.min(F.when(~own, F.col("dist_sum") / F.col("size"))).alias("b"))
    score = F.when(F.col("a").isNull(), dbl(0)).otherwise(
        F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), dbl(0)), dbl(0)))
    mean = per_point.groupBy(*by).agg(F.avg(score).alias("_s"))
    shape = points.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(label).alias("_labels"))
    out = shape.join(mean, by, "left") if by else shape.withColumn("_s", mean.scalar())
    return out.select(*by, F.when((F.col("_labels") >= 2) & (F.col("_n") > F.col("_labels")), F.col("_s")).alias("silhouette"))


def cross_covariance_norm(rows: DataFrame, left: str, right: str, by: str) -> DataFrame:
    """Mean over groups of the mean squared entry of the sample cross-covariance of two vector columns.

    Rows are centred on their group means; a task leaves one dim × dim sum per group, in slices. Groups with a single row
    are left out.
    """
    mean = lambda column, name: group_means(rows.select(by, F.col(column).alias("vec")), by).withColumnRenamed("mean", name)
    centred = (
        rows.join(mean(left, "_ml"), by).join(mean(right, "_mr"), by)
        .select(by, F.zip_with(vectors.as_doubles(left), "_ml", lambda x, m: x - m).alias("l"),
                F.zip_with(vectors.as_doubles(right), "_mr", lambda x, m: x - m).alias("r"))
    )
    products = sums.product_sums(centred, [by], "l", "r").where(F.col("n") >= 2)
    square = F.aggregate("sums", dbl(0), lambda s, x: s + (x / (F.col("n") - 1)) * (x / (F.col("n") - 1)))
    per_group = products.select(by, (square / F.size("sums")).alias("mean_sq"))
    return per_group.agg(F.coalesce(F.avg("mean_sq"), dbl(0)).alias("cross_covariance_norm"))


def shared_private_overlap(rows: DataFrame, by: str = "platform") -> DataFrame:
    """Half the sum of the image and gene cross-covariance norms."""
    image = cross_covariance_norm(rows, "image_shared", "image_private", by)
    gene = cross_covariance_norm(rows, "gene_shared", "gene_private", by)
    return image.withColumn("_g", gene.scalar()).select(((F.col("cross_covariance_norm") + F.col("_g")) / dbl(2)).alias("orthogonality"))


def soft_topk_cross_entropy(queries: DataFrame, bank: DataFrame, percent: float, temperature: float) -> DataFrame:
    return neighbors.soft_topk_loss(queries, bank, percent, temperature).agg(F.avg("loss").alias("soft_topk_cross_entropy"))


# -- patch pooling ------------------------------------------------------------

def patch_pool(overlaps: DataFrame, tokens: DataFrame, cells: DataFrame, dims: int, mode: str = "mean") -> DataFrame:
    """Per cell the pooled token vector of its patches, with the patch indices and areas.

    ``overlaps``: cell_id, patch_idx, overlap_area; ``tokens``: patch_idx, token. A cell
    meets at most every patch of one tile, so its collections are bounded by the tile.
    Patches meet by cell before they are given tokens, which are many times larger.
    """
    if mode not in ("mean", "max", "weighted_mean"):
        raise ValueError(f"unknown aggregation: {mode}")

    def pool(tokens: pa.Array, areas: pa.Array) -> pa.Array:
        """One vector a row from the token lists of a batch, by sums over runs of rows of one matrix."""
        flat, weight = sums.matrix(tokens.flatten()), areas.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.asarray(tokens.offsets)[:-1] - np.asarray(tokens.offsets)[0]
        if mode == "max":
            return pa.array(list(np.maximum.reduceat(flat, starts)), pa.list_(pa.float64()))
        weight = weight if mode == "weighted_mean" else np.ones(len(flat))
        total = np.add.reduceat(weight, starts)[:, None]
        pooled = np.add.reduceat(flat * weight[:, None], starts)
        return pa.array(list(np.divide(pooled, total, out=np.zeros_like(pooled), where=total != 0)), pa.list_(pa.float64()))

    overlaps = overlaps.repartition("cell_id")
    met = overlaps.join(tokens.select("patch_idx", vectors.as_doubles("token").alias("token")), "patch_idx").where(F.col("token").isNotNull())
    packed = met.groupBy("cell_id").agg(F.collect_list(F.struct("patch_idx", "overlap_area", "token")).alias("_p"))
    packed = packed.withColumn("_p", F.array_sort("_p"))
    features = packed.select("cell_id", F.arrow_udf(pool, "array<double>")(F.transform("_p", lambda p: p["token"]), F.transform("_p", lambda p: p["overlap_area"])).alias("features"))
    lists = overlaps.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("patch_idx", "overlap_area"))).alias("_l"))
    return (
        cells.select("cell_id").join(features, "cell_id", "left").join(lists, "cell_id", "left")
        .select("cell_id", F.coalesce("features", F.array_repeat(dbl(0), dims)).alias("features"),
                F.coalesce(F.transform("_l", lambda s: s["patch_idx"]), F.array().cast("array<long>")).alias("patch_indices"),
                F.coalesce(F.transform("_l", lambda s: s["overlap_area"]), F.array().cast("array<double>")).alias("overlap_areas"))
    )
