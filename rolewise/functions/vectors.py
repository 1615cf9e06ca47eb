"""Vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Inner product in double precision, in index order."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, item: total + item)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalised(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    length = norm(vector)
    divisor = F.when(length == 0, F.lit(1.0)).otherwise(length)
    return F.transform(vector, lambda x: x.cast("double") / divisor)


def cosine(left: Column, right: Column) -> Column:
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))
