"""Column builders for vectors (array<double>): normalisation, similarity, interaction features, int8 storage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, also where ``f`` uses it inside of functions of elements."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def interaction(left: Column, right: Column) -> Column:
    """left, right, their product and their absolute difference, in one vector."""
    return F.concat(left, right, F.zip_with(left, right, lambda x, y: x * y), F.zip_with(left, right, lambda x, y: F.abs(x - y)))


def half(x: Column) -> Column:
    """The value rounded to 16-bit floating point (ties to even): 11 significant bits, steps of 2^-24 at least.

    Spark has no such type; beyond 65504 (no scale of a vector that 16 bits can hold) the value is infinite.
    """
    size = F.abs(x.cast("double"))
    step = F.pow(F.lit(2.0), F.greatest(F.lit(-24.0), F.floor(F.log2(size)).cast("double") - 10))
    out = F.when(size == 0, F.lit(0.0)).otherwise(F.rint(x.cast("double") / step) * step)
    return F.when(F.abs(out) > 65504, F.signum(out) * float("inf")).otherwise(out)


def int8_scale(a: Column) -> Column:
    """Largest magnitude / 127 in single precision; 1 for a zero vector."""
    most = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    return F.when(most == 0, 1.0).otherwise((most / 127).cast("float").cast("double"))


def int8_values(a: Column, scale: Column) -> Column:
    """Nearest (ties to even) multiples of the scale, within +-127; quotients in single precision."""
    return F.transform(a, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint((x / scale).cast("float").cast("double")))).cast("tinyint"))


def scaled(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def dequantize(q: Column, scale: Column) -> Column:
    """Values times the (stored) scale, rounded to 16 bits."""
    return F.transform(q, lambda x: half(x.cast("double") * scale))


def max_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def mean_error(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)
