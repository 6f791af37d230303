"""Size checks that decide between broadcasting a small side and shuffling it; memory given back."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylamp.sources.tables import materialized

# A broadcast side stays under both; the second is what counts on the executors.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

SETTLED_ROWS = 10_000


def _width(field: T.StructField) -> Column:
    """Bytes of a column's values, near enough: text and arrays by length, others by type."""
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 16
    return F.lit(8)


def checked_rows(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> int | None:
    """Number of rows, or None when there are more than `max_rows` or they exceed `max_bytes`.

    Reads no more rows than needed to tell.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(0))
    rows, size = df.limit(max_rows + 1).agg(
        F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))
    ).first()
    return rows if rows <= max_rows and size <= max_bytes else None


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return checked_rows(df, max_rows) is not None


def settle(df: DataFrame, max_rows: int = SETTLED_ROWS) -> tuple[DataFrame, int | None]:
    """A query-side table worked out once, with its row count.

    A table of at most `max_rows` rows comes back as a local relation, so the plans that use
    it several times neither repeat its work nor carry its plan.  A larger one is returned
    as it is, with its count if that is still within the broadcast bound.
    """
    if checked_rows(df, max_rows) is None:
        return df, checked_rows(df)
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, checked_rows(df)
    return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows


def fetch(
    few: DataFrame, many: DataFrame, on: list[str], rows: int | None, how: str = "inner"
) -> DataFrame:
    """Rows of `many` that belong to `few`, whose proven row bound is `rows` (None: unknown).

    Within the broadcast bound the big table is only scanned; otherwise both sides shuffle
    on the key and adaptive execution splits skewed partitions.
    """
    if rows is not None and rows <= BROADCAST_ROWS:
        few = F.broadcast(few)
    return many.join(few, on, how)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    bounded: bool | None = None,
    salts: int = 32,
) -> DataFrame:
    """Join a big table with a query-side table whose size has been checked.

    A bounded small side is broadcast, so the big side does not move.  Otherwise the small
    side is copied `salts` times and the big side spread over the copies, which splits any
    hot key evenly over tasks; every row still meets all its partners exactly once.
    """
    if bounded is None:
        bounded = fits(small)
    if bounded:
        return big.join(F.broadcast(small), on, how)
    others = [c for c in big.columns if c not in on] or on
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


#: Ids that share one word of bits.
WORD = 64


def marked(big: DataFrame, ids: DataFrame, column: str, output: str) -> DataFrame:
    """Add whether a row's whole number `column` is among the only column of `ids`.

    Ids travel as words of bits, 64 neighbours in a row, so that many of them can be broadcast and
    the big table stays where it is.  A row without a number is among none.
    """
    number = F.col(ids.columns[0])
    # Stored, as the check of its size and the join both read it.
    words = materialized(
        ids.filter(number.isNotNull()).groupBy(_word(number).alias("_word")).agg(F.bit_or(_bit(number)).alias("_bits"))
    )
    looked = lookup_join(
        big.withColumn("_word", _word(F.col(column))), words, ["_word"], "left"
    )
    there = F.coalesce(F.col("_bits").bitwiseAND(_bit(F.col(column))) != 0, F.lit(False))
    return looked.withColumn(output, there).drop("_word", "_bits")


def without(big: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of a big table whose number is not among `ids`; only the ids move."""
    return marked(big, ids, column, "_among").filter(~F.col("_among")).select(*big.columns)


def _word(number: Column) -> Column:
    return F.shiftright(number.cast("long"), 6)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number, F.lit(WORD)).cast("int"))


def give_back() -> None:
    """Hand memory that a task has freed back to the machine.

    Python workers live on between tasks; what they hold on to is missing to the executor's JVM.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
