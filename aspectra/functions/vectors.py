"""Vector expressions on arrays of numbers, in double precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for zero vectors, which so come last in rising order with nulls last."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance_to(a: Column, vector: Sequence[float]) -> Column:
    """cosine_distance to one fixed vector, whose length is taken once."""
    length = math.sqrt(sum(float(x) * float(x) for x in vector))
    return F.lit(1.0) - F.try_divide(dot(a, literal(vector)), F.sqrt(dot(a, a)) * F.lit(length))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def normalize(vector: Column, epsilon: float = 1e-12) -> Column:
    values = vector.cast("array<double>")
    norm = F.sqrt(dot(values, values)) + F.lit(epsilon)
    return F.transform(values, lambda x: x / norm)


def rendered(vector: Column) -> Column:
    """The text form of a stored vector, eight decimals each."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector.cast("array<double>"), lambda x: F.format_string("%.8f", x)), ","), F.lit("]"))
