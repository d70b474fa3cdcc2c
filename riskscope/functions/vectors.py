"""Expressions over dense vectors held as arrays; arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(
        v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def normalise(v: Column) -> Column:
    """The vector at unit length; a zero vector becomes null."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
