"""Surrogate ids and stored random keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX_DIGITS = 3


def next_id(table: DataFrame, column: str = "id") -> int:
    """One more than the largest id, 1 for an empty table."""
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def first_free(table: DataFrame, column: str = "id") -> DataFrame:
    """`next_id` as a table of one row, worked out only where the numbered rows are read."""
    return table.agg((F.coalesce(F.max(column), F.lit(0)) + 1).cast("long").alias("_first"))


def number_rows(
    df: DataFrame, key: Column, start: int | DataFrame = 1, output: str = "id", hex_digits: int = HEX_DIGITS,
    within: str | None = None,
) -> DataFrame:
    """Give rows dense ids from `start` (a number, or `first_free`), in the order of the md5 of a unique key.

    The leading hash digits split the rows into even buckets that are numbered in parallel;
    only one count per bucket is summed up in one place.  A row's id depends on nothing but
    the set of keys, so recomputing lost tasks gives the same ids.  With `within`, a column of whole
    numbers, its values are numbered one after the other, each in the order of the hashes.
    """
    digits = F.substring("_hash", 1, hex_digits)
    bucket = digits if within is None else F.struct(F.col(within), digits)
    hashed = df.withColumn("_hash", F.md5(key.cast("string"))).withColumn("_bucket", bucket)
    counts = hashed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    first = F.lit(start).cast("long") if isinstance(start, int) else F.col("_first")
    if not isinstance(start, int):
        offsets = offsets.crossJoin(F.broadcast(start))
    offsets = offsets.withColumn("_offset", first - 1 + F.col("_offset")).select("_bucket", "_offset")
    in_bucket = Window.partitionBy("_bucket").orderBy("_hash")
    return (
        hashed.withColumn("_place", F.row_number().over(in_bucket))
        .join(F.broadcast(offsets), "_bucket")  # at most 16 ** hex_digits rows, for each value of `within`
        .withColumn(output, F.col("_offset") + F.col("_place"))
        .drop("_hash", "_bucket", "_place", "_offset")
    )


def random_key(key: Column, seed: int = 0) -> Column:
    """Number in [0, 1) that depends only on the key and the seed."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))
