"""Array functions on embeddings; all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spotloom.constants import NORM_FLOOR
from spotloom.functions.scalars import as_col, dbl


def as_doubles(vec) -> Column:
    return as_col(vec).cast("array<double>")


def dot(a, b) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, dbl(0), lambda acc, x: acc + x)


def norm(vec) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vec), dbl(0), lambda acc, x: acc + x * x))


def l2_normalize(vec) -> Column:
    length = F.greatest(norm(vec), dbl(NORM_FLOOR))
    return F.transform(as_doubles(vec), lambda x: x / length)


def concat_features(scalars: list[Column | str], histogram) -> Column:
    """Scalar columns followed by the histogram bins, as one vector."""
    return F.concat(F.array(*[as_col(c).cast("double") for c in scalars]), as_doubles(histogram))
