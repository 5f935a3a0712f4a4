"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-8


def as_doubles(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x * x)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; the square root of the squared-L2 a vector store reports."""
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine_score(a: Column, b: Column, form: str = "each") -> Column:
    """Cosine with a guard against zero vectors.

    ``each`` adds the guard to either norm, ``product`` adds it to the product of the norms.
    """
    if form == "product":
        return dot(a, b) / (norm(a) * norm(b) + F.lit(NORM_EPS))
    return dot(a, b) / ((norm(a) + F.lit(NORM_EPS)) * (norm(b) + F.lit(NORM_EPS)))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_score(a, b, form="product")


def pack(names) -> Column:
    """Scalar columns as one array<double>."""
    return F.array(*[F.col(n).cast("double") for n in names])


def tidy(col: Column, digits: int) -> Column:
    """Round and turn a negative zero into a plain one."""
    return F.round(col, digits) + F.lit(0.0)
