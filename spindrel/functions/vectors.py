"""Arithmetic on vector columns. All of it is in double precision, whatever the stored type is.

A null vector gives null; vectors of different lengths give null, as positions without a partner are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A norm below this counts as this, so that a zero vector stays zero.
TINY = 1e-12


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(v: Column | str) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column | str) -> Column:
    """The vector divided by its norm; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(doubles(v), lambda x: x / n)


def difference(a: Column | str, b: Column | str) -> Column:
    """Residual: a - b by position."""
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def is_valid_embedding(flat: Column | str, dim: int) -> Column:
    """Whether a flat buffer holds whole vectors of values in [-10, 10]; false for null, a null item or NaN, true for an empty one."""
    v = doubles(flat)
    return F.coalesce((F.size(v) % dim == 0) & F.forall(v, lambda x: F.coalesce((x >= -10) & (x <= 10), F.lit(False))), F.lit(False))


def token_of(flat: Column | str, pos: Column, dim: int) -> Column:
    """The vector at a token position of a flat buffer."""
    return F.slice(doubles(flat), pos * dim + 1, F.lit(dim))


def tokens_of(flat: Column | str, dim: int) -> Column:
    """A flat buffer as a list of vectors; values beyond the last whole vector are left out."""
    n = F.floor(F.size(doubles(flat)) / dim).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda p: token_of(flat, p, dim))).otherwise(F.array().cast("array<array<double>>"))


def windows(a: Column | str, size: int) -> Column:
    """All runs of ``size`` neighbouring items; none if there are fewer."""
    a = F.col(a) if isinstance(a, str) else a
    n = F.size(a) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(a, i + 1, F.lit(size))))


def bucket(x: Column, cutoffs: Column) -> Column:
    """The number of inner cutoffs that are no larger than x; NaN is in the last bucket, null gives null."""
    return F.when(x.isNotNull(), F.size(F.filter(cutoffs, lambda c: c <= x)))


def minmax_level(x: Column, low: Column, high: Column, levels: int = 16) -> Column:
    """Scalar quantiser: floor of the place between low and high times the last level."""
    return F.floor((x - low) / (high - low) * (levels - 1)).cast("int")


def minmax_value(level: Column, low: Column, high: Column, levels: int = 16) -> Column:
    """The value that a level of the scalar quantiser stands for."""
    return level / F.lit(float(levels - 1)) * (high - low) + low
