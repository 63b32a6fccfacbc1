"""Vector columns: arrays of floats, summed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Left-to-right sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def usable(v: Column, dim: int | None = None) -> Column:
    """Finite, not all zero and of the dimension."""
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm(v) > 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def normalize(v: Column) -> Column:
    """Unit vector in single precision; null for one that isn't usable."""
    # The norm is an array of its own, else it would be summed again for every element.
    return F.when(usable(v), F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))[0])
