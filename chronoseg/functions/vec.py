"""Vectors as array columns, in double precision, summed in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f of a value that is computed once; a lambda would compute its expression again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def dot(a, b) -> Column:
    """Sum of products; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """Length 1; the zero vector stays."""
    a = F.col(a) if isinstance(a, str) else a
    length = norm(a)
    return once(F.when(length == 0, 1.0).otherwise(length), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a, b) -> Column:
    """0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def mean_squared(a, b) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(square, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def mean_absolute(a, b) -> Column:
    gap = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))
    return F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def mean_vector(column: str, dim: int, order: str | None = None) -> Column:
    """An aggregate: the mean of each component, with partial sums on the map side."""
    return F.array(*[F.avg(F.col(column)[i].cast("double")) for i in range(dim)])


def sum_vector(column: str, dim: int) -> Column:
    return F.array(*[F.sum(F.col(column)[i].cast("double")) for i in range(dim)])
