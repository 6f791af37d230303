"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.operators.sizing import give_back  # noqa: F401  (used by the operators here)
from quarrylamp.sources.tables import shared_folder

#: The ASCII blanks that bound a word.
BLANKS = r"[ \t-\r]+"


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later jobs start from it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about `limit` bytes in a column; one row may be longer."""
    for batch in batches:
        # Counted in Arrow: a Python string for every row would stay with the worker.
        lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for at, size in enumerate(lengths):
            if held and held + size > limit:
                yield batch.slice(first, at - first)
                first, held = at, 0
            held += size
        if batch.num_rows > first:
            yield batch.slice(first)
