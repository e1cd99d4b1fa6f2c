"""Scalar column functions: normalisation, parsing, grid parameters, depth tokens."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spotloom.constants import CP10K_SCALE, CPM_SCALE


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dbl(value: float) -> Column:
    return F.lit(float(value))


def finite_or_null(value) -> Column:
    """Text or number to double; null when unparsable, NaN or infinite."""
    number = as_col(value).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == dbl(float("inf"))), None).otherwise(number)


def whole_or(value, dtype: str, default: int) -> Column:
    """Number or text to an integer, fraction cut; ``default`` when unparsable."""
    return F.coalesce(as_col(value).try_cast("double").try_cast(dtype), F.lit(default).cast(dtype))


def decode_name(value) -> Column:
    """Bytes or text to text."""
    return F.decode(as_col(value).cast("binary"), "UTF-8")


def log1p_counts(value) -> Column:
    return F.log1p(F.greatest(as_col(value).cast("double"), dbl(0)))


def log1p_cpm(value, total, scale: float = CPM_SCALE) -> Column:
    """Counts per ``scale`` of ``total``; ``total`` is a sum of clipped values whose
    scope (panel or all genes) the caller chooses."""
    clipped = F.greatest(as_col(value).cast("double"), dbl(0))
    total = as_col(total).cast("double")
    return F.when(total > 0, F.log1p(clipped / total * dbl(scale))).otherwise(dbl(0))


def log1p_cp10k(value, total) -> Column:
    """As ``log1p_cpm`` with a scale of 10,000 and without the clip at zero."""
    total = as_col(total).cast("double")
    return F.when(total > 0, F.log1p(as_col(value).cast("double") / total * dbl(CP10K_SCALE))).otherwise(dbl(0))


def undo_log1p(value) -> Column:
    return F.expm1(as_col(value))


def normalize(value, method: str, total=None, scale: float = CPM_SCALE) -> Column:
    """Named switch between the two stored normalisations."""
    name = method.strip().lower()
    if name == "log1p":
        return log1p_counts(value)
    if name == "log1p_cpm":
        return log1p_cpm(value, total, scale)
    raise ValueError(f"unsupported expression normalization: {method}")


def spot_radius_px(diameter_um, pixel_um) -> Column:
    return as_col(diameter_um) / as_col(pixel_um) / dbl(2)


def spacing_px(inter_spot_um, diameter_um, pixel_um, use_inter_spot: bool = True) -> Column:
    distance = as_col(inter_spot_um)
    spacing = F.when(distance > 0, distance).otherwise(as_col(diameter_um))
    return (spacing if use_inter_spot else as_col(diameter_um)) / as_col(pixel_um)


def grid_layout(layout, technology) -> Column:
    """``auto`` follows the technology; an unknown layout name fails the query."""
    name = F.lower(F.trim(as_col(layout)))
    return (
        F.when(name == "auto",
               F.when(F.contains(F.lower(as_col(technology)), F.lit("visium")), "hex").otherwise("square"))
        .when(name.isin("square", "hex"), name)
        .otherwise(F.raise_error(F.concat(F.lit("grid_layout must be auto, square or hex: "), name)))
    )


def crop_size_px(size_um, pixel_um) -> Column:
    return F.greatest(F.rint(as_col(size_um) / as_col(pixel_um)).cast("long"), F.lit(1))


def crop_origin(center, size) -> Column:
    """Left or top pixel of a window, half rounded to even."""
    return F.rint(as_col(center) - as_col(size) / dbl(2)).cast("long")


def parse_id_list(text) -> Column:
    """Comma list to trimmed, non-empty ids; an empty list fails the query."""
    items = F.filter(F.transform(F.split(as_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(F.raise_error(F.lit("the id list is empty")))


def fold_label(fold) -> Column:
    return F.format_string("fold_%02d", as_col(fold).cast("int"))


def spot_barcode(source, spot_id) -> Column:
    return F.concat_ws("_", as_col(source), as_col(spot_id).cast("string"))


def source_depth(total) -> Column:
    return F.log10(F.greatest(as_col(total).cast("double"), dbl(1)))


def target_depth(total, spec) -> Column:
    """Depth token by spec: empty = source, ``f<x>`` = log10(total·x), ``a<x>`` = source + x, ``t<x>`` = x."""
    spec = as_col(spec)
    kind = F.substring(spec, 1, 1)
    amount = F.substring(spec, 2, 64).try_cast("double")
    return (
        F.when(F.coalesce(spec, F.lit("")) == "", source_depth(total))
        .when(kind == "f", F.log10(F.greatest(as_col(total).cast("double"), dbl(1)) * amount))
        .when(kind == "a", source_depth(total) + amount)
        .when(kind == "t", amount)
        .otherwise(F.raise_error(F.lit("a depth spec must start with f, a or t")))
    )
