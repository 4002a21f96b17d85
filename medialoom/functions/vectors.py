"""Vector arithmetic on ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialoom.functions.columns import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Vector scaled to length one; a zero vector is kept as it is."""
    doubles = F.transform(a, lambda x: x.cast("double"))
    return let(norm(a), lambda n: F.when(n > 0, F.transform(doubles, lambda x: x / n)).otherwise(doubles))
