"""Cells to grid spots, measured spots and image patches."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spotloom.constants import RATIO_FLOOR
from spotloom.functions import polygons
from spotloom.functions.scalars import dbl
from spotloom.operators import ranking
from spotloom.operators.neighbors import paired_blocks
from spotloom.session import one_row

#: Rows of a block on either side, cells a bucket should hold, and its greatest side in reaches.
CHUNK, BUCKET_CELLS, WIDE = 1 << 16, 1 << 14, 32
#: Centres of the smallest part, and cells measured at a time.
LEAF, SLICE = 4, 1 << 14


def extent(df: DataFrame, x: str = "centroid_x", y: str = "centroid_y", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max")
    )


class Grid:
    """Closed-form regular grid over an extent: the centres are arithmetic, never a joined table.

    Radius, spacing and layout are values, or columns where each sample has its own.
    """

    def __init__(self, ext: Column, radius: float | Column, spacing: float | Column, layout: str | Column):
        if isinstance(layout, str) and layout not in ("square", "hex"):
            raise ValueError("layout must be square or hex")
        column = lambda v: v if isinstance(v, Column) else dbl(float(v))
        self.ext, self.radius = ext, column(radius)
        if isinstance(layout, str) and not isinstance(spacing, Column):
            step = max(float(spacing), 1.0)
            self.step_x, self.step_y = dbl(step), dbl(step * math.sqrt(3.0) / 2.0 if layout == "hex" else step)
        else:
            self.step_x = F.greatest(column(spacing), dbl(1))
            hexagonal = F.lit(layout) == "hex" if isinstance(layout, str) else layout == "hex"
            self.step_y = F.when(hexagonal, self.step_x * dbl(math.sqrt(3.0)) / dbl(2)).otherwise(self.step_x)
        self.hex = F.lit(layout == "hex") if isinstance(layout, str) else layout == "hex"

    def rows(self) -> Column:
        span = self.ext["y_max"] + self.radius - self.ext["y_min"]
        return (F.floor(span / self.step_y) + 1).cast("long")

    def start_x(self, row: Column) -> Column:
        return self.ext["x_min"] + F.when(self.hex & (row % 2 != 0), self.step_x / dbl(2)).otherwise(dbl(0))

    def cols(self, row: Column) -> Column:
        span = self.ext["x_max"] + self.radius - self.start_x(row)
        return F.greatest(F.floor(span / self.step_x) + 1, F.lit(0)).cast("long")

    def center_x(self, row: Column, col: Column) -> Column:
        return self.start_x(row) + col.cast("double") * self.step_x

    def center_y(self, row: Column) -> Column:
        return self.ext["y_min"] + row.cast("double") * self.step_y

    def nearest(self, df: DataFrame, x: Column, y: Column) -> DataFrame:
        """Keeps rows whose nearest of three row candidates lies within the radius and adds it.

        Every step is a projection over the step before, so all of it is generated code and
        each value is computed once; the closing generator drops the misses, where a filter
        would be pushed down and repeat the search. The lower row wins a tie.
        """
        kept = df.columns
        each = range(3)
        steps = [
            lambda: {"_base": F.rint((y - self.ext["y_min"]) / self.step_y).cast("long"), "_rows": self.rows()},
            lambda: {f"_row{i}": F.col("_base") + (i - 1) for i in each},
            lambda: {f"_sx{i}": self.start_x(F.col(f"_row{i}")) for i in each},
            lambda: {f"_n{i}": self.cols(F.col(f"_row{i}")) for i in each},
            lambda: {f"_col{i}": F.least(F.greatest(F.rint((x - F.col(f"_sx{i}")) / self.step_x).cast("long"), F.lit(0)),
                                         F.greatest(F.col(f"_n{i}") - 1, F.lit(0))) for i in each},
            lambda: {**{f"_cx{i}": F.col(f"_sx{i}") + F.col(f"_col{i}").cast("double") * self.step_x for i in each},
                     **{f"_cy{i}": self.center_y(F.col(f"_row{i}")) for i in each}},
            lambda: {f"_d{i}": F.when((F.col(f"_row{i}") >= 0) & (F.col(f"_row{i}") < F.col("_rows")) & (F.col(f"_n{i}") > 0),
                                      (x - F.col(f"_cx{i}")) * (x - F.col(f"_cx{i}")) + (y - F.col(f"_cy{i}")) * (y - F.col(f"_cy{i}"))) for i in each},
            lambda: {"_d": F.least("_d0", "_d1", "_d2")},
            lambda: {"_i": F.when(F.col("_d0") <= F.col("_d"), 0).when(F.col("_d1") <= F.col("_d"), 1).otherwise(2)},
        ]
        for step in steps:
            df = df.withColumns(step())
        pick = lambda n: F.when(F.col("_i") == 0, F.col(f"_{n}0")).when(F.col("_i") == 1, F.col(f"_{n}1")).otherwise(F.col(f"_{n}2"))
        hit = F.struct(pick("row").alias("grid_row"), pick("col").alias("grid_col"), pick("cx").alias("center_x"),
                       pick("cy").alias("center_y"), F.sqrt("_d").alias("distance"))
        return df.select(*kept, F.inline(F.when(F.col("_d") <= self.radius * self.radius, F.array(hit))))


def grid_centers(ext: DataFrame, radius: float, spacing: float, layout: str) -> DataFrame:
    """All centres of the grid, one row each, with their row and column."""
    grid = Grid(F.struct("x_min", "x_max", "y_min", "y_max"), radius, spacing, layout)
    rows = ext.withColumn("grid_row", F.explode(F.sequence(F.lit(0).cast("long"), grid.rows() - 1)))
    row = F.col("grid_row")
    return (
        rows.where(grid.cols(row) > 0)
        .withColumn("grid_col", F.explode(F.sequence(F.lit(0).cast("long"), grid.cols(row) - 1)))
        .withColumn("center_x", grid.center_x(row, F.col("grid_col")))
        .withColumn("center_y", grid.center_y(row))
        .drop("x_min", "x_max", "y_min", "y_max")
    )


def nearest_grid_center(
    cells: DataFrame, radius: float | str, spacing: float | str, layout: str, ext: DataFrame | None = None, by: tuple[str, ...] = (),
    grids: DataFrame | None = None,
) -> DataFrame:
    """Cells within ``radius`` (inclusive) of their nearest grid centre. No shuffle of cells.

    With ``by`` each group has a grid over its own extent, joined as one row a group. ``grids`` (by…, radius, spacing,
    layout) gives each group its own geometry in place of the three values.
    """
    ext = extent(cells, by=by) if ext is None else ext
    if not by:
        placed = cells.withColumn("_ext", one_row(ext))
        return Grid(F.col("_ext"), radius, spacing, layout).nearest(placed, F.col("centroid_x"), F.col("centroid_y")).drop("_ext")
    facts = ext.select(*by, F.struct("x_min", "x_max", "y_min", "y_max").alias("_ext"))
    if grids is None:
        grid = Grid(F.col("_ext"), radius, spacing, layout)
    else:
        facts = facts.join(grids.select(*by, F.struct("radius", "spacing", "layout").alias("_grid")), list(by))
        grid = Grid(F.col("_ext"), F.col("_grid.radius"), F.col("_grid.spacing"), F.col("_grid.layout"))
    return grid.nearest(cells.join(facts, list(by)), F.col("centroid_x"), F.col("centroid_y")).drop("_ext", "_grid")


def _nearest_centers(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, order: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, centre, distance) of the nearest centre closer than ``reach`` of each cell that has one; ``order`` ranks tied centres.

    The centres are halved by their median along x and y in turn until a part holds a few. A cell goes down to the parts
    whose box is no farther than the farthest corner of the best box met, so it measures a handful of centres wherever
    they crowd. Distances decide unrounded.
    """
    depth = max(0, int(math.log2(max(len(cx), 1) / LEAF)))
    place = np.arange(len(cx))
    edges = [np.arange(2 ** level + 1) * len(cx) // 2 ** level for level in range(depth + 1)]
    for level in range(depth):
        part = np.repeat(np.arange(2 ** level), np.diff(edges[level]))
        place = place[np.lexsort(((cy if level % 2 else cx)[place], part))]
    cx, cy, order = cx[place], cy[place], order[place]
    boxes = [[f.reduceat(c, e[:-1]) for c in (cx, cy) for f in (np.minimum, np.maximum)] for e in edges]
    found = []
    for start in range(0, len(x), SLICE):
        px, py = x[start:start + SLICE], y[start:start + SLICE]
        best = np.full(len(px), reach * reach)
        cell, node = np.arange(len(px)), np.zeros(len(px), dtype=np.int64)
        for level, (x0, x1, y0, y1) in enumerate(boxes):
            if level:
                cell, node = np.repeat(cell, 2), (2 * node[:, None] + np.arange(2)).reshape(-1)
            left, right, low, high = x0[node] - px[cell], px[cell] - x1[node], y0[node] - py[cell], py[cell] - y1[node]
            near = np.maximum(np.maximum(left, right), 0) ** 2 + np.maximum(np.maximum(low, high), 0) ** 2
            np.minimum.at(best, cell, np.maximum(np.abs(left), np.abs(right)) ** 2 + np.maximum(np.abs(low), np.abs(high)) ** 2)
            # Slack for rounding: ties of rounded roots must stay.
            kept = near <= best[cell] * (1 + 1e-9)
            cell, node = cell[kept], node[kept]
        counts = np.diff(edges[-1])[node]
        cell = np.repeat(cell, counts)
        center = np.repeat(edges[-1][node] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        dx, dy = px[cell] - cx[center], py[cell] - cy[center]
        distance = np.sqrt(dx * dx + dy * dy)
        close = distance < reach
        cell, center, distance = cell[close], center[close], distance[close]
        sort = np.lexsort((order[center], distance, cell))
        first = sort[np.diff(cell[sort], prepend=-1) > 0]
        found.append((cell[first] + start, place[center[first]], distance[first]))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest_within_radius(cells: DataFrame, spots: DataFrame, radius: float, scale: float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest irregular centre closer than ``radius * scale`` per cell, ties by spot id.

    ``cells``: cell_id, centroid_x, centroid_y; ``spots``: spot_id, center_x, center_y; both with ``by``.
    Cells are dealt to square buckets and centres to those within reach of them. Blocks of a bucket's cells meet blocks of
    its centres, and a task finds the nearest by halving the centres, so the work for a cell grows with the logarithm of
    the centres in reach. Where cells are sparse, buckets are up to ``WIDE`` reaches wide.
    """
    reach = float(radius) * max(float(scale), RATIO_FLOOR)
    keys = [*by, "_bx", "_by"]
    ext = cells.agg(
        F.min("centroid_x").alias("x0"), F.max("centroid_x").alias("x1"), F.min("centroid_y").alias("y0"), F.max("centroid_y").alias("y1"), F.count(F.lit(1)).alias("n"))
    wide = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * dbl(BUCKET_CELLS) / F.col("n"))
    side = ext.select(F.coalesce(F.least(F.greatest(wide, dbl(reach)), dbl(WIDE * reach)), dbl(reach)).alias("side")).scalar()
    bucket = lambda x: F.floor(x / F.col("_side"))
    placed = cells.select(*by, F.col("cell_id").alias("id"), "centroid_x", "centroid_y", side.alias("_side"))
    placed = placed.select(*by, "id", "centroid_x", "centroid_y", bucket(F.col("centroid_x")).alias("_bx"), bucket(F.col("centroid_y")).alias("_by"))

    def within(name: str) -> Column:
        # A little more than the reach, for rounding.
        more = dbl(reach * (1 + 1e-6)) + F.abs(F.col(name)) * dbl(1e-12)
        return F.explode(F.sequence(bucket(F.col(name) - more), bucket(F.col(name) + more)))

    distinct = spots.groupBy(*by, "center_x", "center_y").agg(F.min("spot_id").alias("id")).withColumn("_side", side)
    around = distinct.withColumn("_bx", within("center_x")).withColumn("_by", within("center_y")).drop("_side")
    fields = [cells.schema[c] for c in by] + [T.StructField("cell_id", cells.schema["cell_id"].dataType), T.StructField("distance", T.DoubleType()), T.StructField("spot_id", spots.schema["spot_id"].dataType)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)

    def nearest(key, left: pa.Table, right: pa.Table) -> pa.Table:
        points = [t.column(c).to_numpy() for t, names in ((left, ("centroid_x", "centroid_y")), (right, ("center_x", "center_y"))) for c in names]
        mine, theirs = (np.flatnonzero(np.isfinite(a) & np.isfinite(b)) for a, b in (points[:2], points[2:]))
        if not len(mine) or not len(theirs):
            return arrow.empty_table()
        order = np.empty(right.num_rows, dtype=np.int64)
        order[pc.sort_indices(right.column("id"), null_placement="at_start").to_numpy()] = np.arange(right.num_rows)
        cell, center, distance = _nearest_centers(points[0][mine], points[1][mine], points[2][theirs], points[3][theirs], order[theirs], reach)
        out = [pa.repeat(key[i], len(cell)) for i in range(len(by))]
        out += [left.column("id").take(mine[cell]), pa.array(distance, pa.float64()), right.column("id").take(theirs[center])]
        return pa.table(dict(zip(arrow.names, out))).cast(arrow)

    numbers = [F.col(c).cast("double").alias(c) for c in ("centroid_x", "centroid_y")], [F.col(c).cast("double").alias(c) for c in ("center_x", "center_y")]
    met = paired_blocks(placed.select(*keys, "id", *numbers[0]), around.select(*keys, "id", *numbers[1]), keys, CHUNK, nearest, schema)
    return (
        met.groupBy(*by, "cell_id").agg(F.min(F.struct("distance", "spot_id")).alias("_best"))
        .select(*by, "cell_id", "_best.spot_id", "_best.distance")
    )


def polygon_patch_overlap(cells: DataFrame, image_size: float = 224.0, patches: int = 16) -> DataFrame:
    """(cell_id, patch_idx, overlap_area) for every square the outline touches.

    ``vertices`` is one ring or the signed rings of an outline with holes and parts. Candidates come from the bounding
    box, so a small outline meets a handful of squares. Outlines are dealt to tasks first, as clipping one costs far more
    than reading it and a small file would leave all of them to one task.
    """
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = dbl(float(image_size) / patches)
    last = F.lit(patches - 1).cast("long")

    def bound(value: Column, low: bool) -> Column:
        # One square further on either side: a shared border is a touch.
        cell = F.floor(value / side) - (1 if low else 0)
        return F.least(F.greatest(cell, F.lit(0)), last).cast("long")

    box = F.col("_box")
    squares = (
        cells.select("cell_id", polygons.as_rings("vertices", cells.schema["vertices"].dataType).alias("vertices")).repartition(tasks, "cell_id").withColumn("_box", polygons.bbox("vertices"))
        .where((box["max_x"] >= 0) & (box["max_y"] >= 0)
               & (box["min_x"] <= dbl(image_size)) & (box["min_y"] <= dbl(image_size)))
        .withColumn("_i", F.explode(F.sequence(bound(box["min_y"], True), bound(box["max_y"], False))))
        .withColumn("_j", F.explode(F.sequence(bound(box["min_x"], True), bound(box["max_x"], False))))
        .select("cell_id", "vertices", (F.col("_i") * patches + F.col("_j")).alias("patch_idx"),
                (F.col("_j") * side).alias("_x0"), ((F.col("_j") + 1) * side).alias("_x1"),
                (F.col("_i") * side).alias("_y0"), ((F.col("_i") + 1) * side).alias("_y1"))
        .where(polygons.touches_box("vertices", "_x0", "_y0", "_x1", "_y1"))
    )
    clipped = squares
    for axis, edge, above in (("x", "_x0", True), ("x", "_x1", False), ("y", "_y0", True), ("y", "_y1", False)):
        clipped = clipped.withColumn("vertices", polygons.clip_half_plane("vertices", axis, edge, above))
    return clipped.select("cell_id", "patch_idx", polygons.area("vertices").alias("overlap_area"))


def attach_geometry(cells: DataFrame, outlines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Chosen cells with their outline (vertices), area and centroid; cells without an outline are left out.

    ``outlines``: by…, cell_id, vertices. Shapes are measured after the join, for the chosen cells only.
    """
    keys = [*by, "cell_id"]
    joined = cells.join(outlines.select(*keys, "vertices"), keys)
    rings = polygons.as_rings("vertices", outlines.schema["vertices"].dataType)
    centre = polygons.centroid("_r")
    return joined.withColumn("_r", rings).withColumn("_c", centre).select(
        *cells.columns, "vertices", polygons.area("_r").alias("area_px2"), F.col("_c.x").alias("centroid_x"), F.col("_c.y").alias("centroid_y"))


def number_spots(spots: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Dense 0-based ``spot_id`` in grid order, in each group of ``by``. A grid row holds at most one row of centres."""
    return ranking.spread_rank(spots, list(by), "grid_row", ["grid_col"], "spot_id")


def membership_order(members: DataFrame, width: int = 1 << 16, by: tuple[str, ...] = ()) -> DataFrame:
    """Members ordered inside each spot (``ord``) with the spot's start offset (``spot_start``).

    Both numbers are built range by range, so a spot with a large share of the cells is spread out.
    """
    sliced = members.withColumn("_slice", F.floor(F.col("cell_id") / width))
    ordered = ranking.spread_rank(sliced, [*by, "spot_id"], "_slice", ["cell_id"], "ord").drop("_slice")
    sizes = members.groupBy(*by, "spot_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.floor(F.col("spot_id") / width))
    starts = ranking.prefix_sums(sizes, list(by), "_block", ["spot_id"], {"spot_start": "_n"}).select(*by, "spot_id", "spot_start")
    return ordered.join(starts, [*by, "spot_id"])
