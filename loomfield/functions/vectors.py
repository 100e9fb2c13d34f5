"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """a scaled to length one; null if its length is zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    """Cosine similarity; zero if either vector is shorter than floor."""
    n, m = norm(a), norm(b)
    return F.when((n < floor) | (m < floor), F.lit(0.0)).otherwise(dot(a, b) / (n * m))


def sign_bits(v: Column, start: int, size: int) -> Column:
    """Bits v[start] > 0, ..., lowest first, as an integer."""
    part = F.slice(v, start + 1, size)
    return F.aggregate(
        F.zip_with(part, F.sequence(F.lit(0), F.lit(size - 1)), lambda x, k: F.when(x > 0, F.pow(F.lit(2.0), k)).otherwise(0.0)),
        F.lit(0.0),
        lambda s, x: s + x,
    ).cast("long")


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers; never null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))
