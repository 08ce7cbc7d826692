"""Column functions on array<float> vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest norm a vector is divided by.
MIN_NORM = 1e-12


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(as_double(left), as_double(right), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(as_double(vector), lambda x: x * x)))


def unit(vector: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""
    length = F.greatest(norm(vector), F.lit(MIN_NORM))
    return F.transform(as_double(vector), lambda x: x / length)


def cosine(left: Column, right: Column) -> Column:
    scale = F.greatest(norm(left), F.lit(MIN_NORM)) * F.greatest(norm(right), F.lit(MIN_NORM))
    return dot(left, right) / scale


def hadamard(left: Column, right: Column) -> Column:
    return F.zip_with(as_double(left), as_double(right), lambda x, y: x * y)


def linear_pair_score(left: Column, right: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    """Linear head on the element-wise product: `bias + sum(weights * left * right)`."""
    weight = F.array(*[F.lit(float(w)) for w in weights])
    return F.lit(float(bias)) + total(F.zip_with(hadamard(left, right), weight, lambda x, w: x * w))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
