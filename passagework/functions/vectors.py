"""Vector expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def normalized(v: Column) -> Column:
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def is_unit(v: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6) -> Column:
    """Whether all components of ``a`` are near those of ``b``, relative to ``b``."""
    near = F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)
