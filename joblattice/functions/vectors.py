"""Vector arithmetic on array columns, in double precision and in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null if either vector has length zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_vector(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), length))
