"""Vector columns in plain expressions.

These serve row-wise work (normalising, half rounding, scoring given pairs).  Scoring a
whole corpus against a query batch goes through `operators.nearest`, which works block-wise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are ordered on this many decimals so that equal vectors tie exactly however the
# products were summed; ties then fall to the smaller id.
SCORE_DIGITS = 9

# Fixed value: from here on a number rounds beyond the largest half-precision value.
HALF_LIMIT = 65520.0


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, value: total + value,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column, nan_as_zero: bool = True) -> Column:
    """Cosine similarity of two arrays; a zero vector gives 0 (or NaN on request)."""
    scale = norm(left) * norm(right)
    empty = F.lit(0.0) if nan_as_zero else F.lit(float("nan"))
    return F.when(scale == 0, empty).otherwise(F.round(dot(left, right) / scale, SCORE_DIGITS))


def l2_normalize(vector: Column) -> Column:
    """Divide by the norm, guarding against zero vectors."""
    # The one-element array binds the length once for all components.
    length = F.array(F.greatest(norm(vector), F.lit(1e-12)))
    return F.transform(length, lambda whole: F.transform(vector, lambda x: (x.cast("double") / whole).cast("float")))[0]


def half_value(value: Column) -> Column:
    """Round a number to the nearest half-precision value, ties to even.

    A finite number that would round beyond the largest half value fails the job.
    """
    exact = value.cast("double")
    size = F.abs(exact)
    exponent = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))), F.lit(-14))
    scale = F.pow(F.lit(2.0), F.lit(10) - exponent)
    beyond = (size >= HALF_LIMIT) & (size < F.lit(float("inf")))
    message = F.concat(exact.cast("string"), F.lit(" is out of range for half precision"))
    rounded = F.when(size == 0, F.lit(0.0)).otherwise(F.rint(exact * scale) / scale).cast("float")
    return F.when(beyond, F.raise_error(message).cast("float")).otherwise(rounded)


def half_precision(vector: Column) -> Column:
    return F.transform(vector, half_value)


def check_dimensions(vector: Column, dimensions: int) -> Column:
    """The vector itself; fails the job when its length is not `dimensions`."""
    message = F.concat(
        F.lit("embedding has "),
        F.coalesce(F.size(vector).cast("string"), F.lit("no")),
        F.lit(f" values; expected {dimensions}"),
    )
    return F.when(F.size(vector) == dimensions, vector).otherwise(F.raise_error(message))
