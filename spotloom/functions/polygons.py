"""Polygon arithmetic on outlines, columns of rings ``array<array<struct<x,y>>>``.

Rings are signed: an outer ring runs counter-clockwise, a hole clockwise, so areas, centroids and clipped areas of
outlines with holes and several parts are plain sums over rings. A ring may or may not repeat its first vertex; a single
ring may run either way. Everything is Catalyst higher-order functions, so shapes never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from spotloom.constants import RATIO_FLOOR
from spotloom.functions.scalars import as_col, dbl


RINGS = "array<array<struct<x:double,y:double>>>"


def as_rings(vertices: Column | str, kind: T.DataType | None = None) -> Column:
    """Outline of one ring; a column that holds rings already (by ``kind``, its type) stays as it is."""
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    vertices = as_col(vertices)
    return vertices if nested else F.when(vertices.isNotNull(), F.array(vertices))


def _ring_edges(ring) -> Column:
    """Each vertex with its successor, the last one closing the ring."""
    ring = as_col(ring)
    successors = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, successors, lambda p, q: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def _edges(rings) -> Column:
    return F.flatten(F.transform(as_col(rings), _ring_edges))


def _total(items: Column, term) -> Column:
    return F.aggregate(items, dbl(0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def oriented(parts) -> Column:
    """Signed rings of parts, each a list of rings with the outer one first."""
    def turned(ring: Column, place: Column) -> Column:
        left = _total(_ring_edges(_local(ring)), _cross) >= 0
        return F.when(left == (place == 0), ring).otherwise(F.reverse(ring))

    return F.flatten(F.transform(as_col(parts), lambda part: F.transform(part, turned)))


def _local(ring) -> Column:
    """A ring relative to its first vertex: slide coordinates are large."""
    first = F.get(ring, F.lit(0))
    return F.transform(ring, lambda p: F.struct((p["x"] - first["x"]).alias("x"), (p["y"] - first["y"]).alias("y")))


def signed_area(rings) -> Column:
    return _total(_edges(rings), _cross) / dbl(2)


def area(rings) -> Column:
    return F.abs(signed_area(rings))


def perimeter(rings) -> Column:
    """Length of all rings, holes included."""
    return _total(_edges(rings), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def centroid(rings) -> Column:
    """Area centroid; an outline without area falls back to the mean of its vertices."""
    rings = as_col(rings)
    first = F.get(F.get(rings, F.lit(0)), F.lit(0))
    ox, oy = first["x"], first["y"]
    local = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct((p["x"] - ox).alias("x"), (p["y"] - oy).alias("y"))))
    edges, points = _edges(local), F.flatten(local)
    doubled = _total(edges, _cross)
    cx = _total(edges, lambda e: (e["ax"] + e["bx"]) * _cross(e)) / (dbl(3) * doubled)
    cy = _total(edges, lambda e: (e["ay"] + e["by"]) * _cross(e)) / (dbl(3) * doubled)
    n = F.size(points).cast("double")
    mx = F.aggregate(points, dbl(0), lambda acc, p: acc + p["x"]) / n
    my = F.aggregate(points, dbl(0), lambda acc, p: acc + p["y"]) / n
    flat = doubled == 0
    return F.struct(
        (ox + F.when(flat, mx).otherwise(cx)).alias("x"),
        (oy + F.when(flat, my).otherwise(cy)).alias("y"),
    )


def bbox(rings) -> Column:
    points = F.flatten(as_col(rings))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"),
        F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"),
    )


def shape_columns(area_px2, perimeter_px, box, pixel_um) -> dict[str, Column]:
    """The eleven shape statistics from area, perimeter and bounding box."""
    a, p, b, s = as_col(area_px2), as_col(perimeter_px), as_col(box), as_col(pixel_um)
    w, h = b["max_x"] - b["min_x"], b["max_y"] - b["min_y"]
    floor = dbl(RATIO_FLOOR)
    return {
        "area_px2": a,
        "area_um2": a * s * s,
        "perimeter_px": p,
        "perimeter_um": p * s,
        "bbox_width_px": w,
        "bbox_height_px": h,
        "bbox_width_um": w * s,
        "bbox_height_um": h * s,
        "aspect_ratio": w / F.greatest(h, floor),
        "fill_ratio": a / F.greatest(w * h, floor),
        "equivalent_diameter_um": F.sqrt(F.greatest(a, dbl(0)) * dbl(4) / F.pi()) * s,
    }


def clip_half_plane(rings, axis: str, bound, keep_above: bool) -> Column:
    """Part of each ring on one side of an axis-parallel line. The signed areas of the parts add up to that of the whole."""
    rings, bound = as_col(rings), as_col(bound)
    a, b = f"a{axis}", f"b{axis}"

    def inside(v: Column) -> Column:
        return (v >= bound) if keep_above else (v <= bound)

    def crossing(e: Column) -> Column:
        t = (bound - e[a]) / (e[b] - e[a])
        x = bound if axis == "x" else e["ax"] + t * (e["bx"] - e["ax"])
        y = bound if axis == "y" else e["ay"] + t * (e["by"] - e["ay"])
        return F.struct(x.alias("x"), y.alias("y"))

    def corner(e: Column) -> Column:
        return F.struct(e["ax"].alias("x"), e["ay"].alias("y"))

    def pieces(e: Column) -> Column:
        stays, crosses = inside(e[a]), inside(e[a]) != inside(e[b])
        return (
            F.when(stays & crosses, F.array(corner(e), crossing(e)))
            .when(stays, F.array(corner(e)))
            .when(crosses, F.array(crossing(e)))
            .otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        )

    return F.transform(rings, lambda ring: F.flatten(F.transform(_ring_edges(ring), pieces)))


def touches_box(rings, x0, y0, x1, y1) -> Column:
    """True when outline and closed box share a point, a shared border included; a box inside a hole does not touch.

    Decided by edges, not by the clipped area: clipping a concave outline can
    leave a zero-area remnant on a box it never reaches.
    """
    x0, y0, x1, y1 = (as_col(v) for v in (x0, y0, x1, y1))
    edges = _edges(rings)

    def span(start: Column, end: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        d = end - start
        still = d == 0
        first, second = (lo - start) / F.when(still, dbl(1)).otherwise(d), (hi - start) / F.when(still, dbl(1)).otherwise(d)
        enter = F.when(still, dbl(0)).otherwise(F.least(first, second))
        leave = F.when(still, dbl(1)).otherwise(F.greatest(first, second))
        return enter, leave, ~still | ((start >= lo) & (start <= hi))

    def hits(e: Column) -> Column:
        ex, lx, okx = span(e["ax"], e["bx"], x0, x1)
        ey, ly, oky = span(e["ay"], e["by"], y0, y1)
        return okx & oky & (F.greatest(ex, ey, dbl(0)) <= F.least(lx, ly, dbl(1)))

    def winds(e: Column) -> Column:
        straddles = (e["ay"] > y0) != (e["by"] > y0)
        at = e["ax"] + (y0 - e["ay"]) / F.when(e["by"] == e["ay"], dbl(1)).otherwise(e["by"] - e["ay"]) * (e["bx"] - e["ax"])
        return straddles & (x0 < at)

    holds_corner = F.size(F.filter(edges, winds)) % 2 == 1
    return F.exists(edges, hits) | holds_corner
