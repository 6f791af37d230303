"""Text to unit vectors through a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import strip_space, words
from quarrylamp.functions.vectors import check_dimensions

DIMENSIONS = 768
MAX_QUERY_CHARS = 512

Encoder = Callable[[Column], Column]


def hash_encoder(dimensions: int = DIMENSIONS) -> Encoder:
    """Feature hashing: each word adds +1 or -1 to one bucket, then unit length.

    Words are hashed in the JVM; the tasks only count buckets, a batch at a time.
    """

    @F.pandas_udf("array<float>")
    def count_buckets(codes: pd.Series) -> pd.Series:
        lengths = codes.map(len).to_numpy()
        rows = np.repeat(np.arange(len(codes)), lengths)
        flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in codes] or [[]]).astype(int)
        cells = rows * dimensions + (flat >> 1) % dimensions
        sums = np.bincount(cells, np.where(flat & 1, 1.0, -1.0), len(codes) * dimensions)
        matrix = sums.reshape(len(codes), dimensions)
        norms = np.maximum(np.sqrt((matrix**2).sum(axis=1, keepdims=True)), 1e-12)
        return pd.Series(list((matrix / norms).astype(np.float32)))

    def encode_text(text: Column) -> Column:
        # 24 leading bits of md5: the last one is the sign, the others choose the bucket.
        codes = F.transform(
            words(F.coalesce(text, F.lit(""))),
            lambda word: F.conv(F.substring(F.md5(word), 1, 6), 16, 10).cast("long"),
        )
        return count_buckets(codes)

    return encode_text


def encode(
    df: DataFrame,
    text_col: str,
    encoder: Encoder,
    dimensions: int | None = None,
    output: str = "embedding",
) -> DataFrame:
    """Add the vector of a text column, checking its length when `dimensions` is given."""
    encoded = df.withColumn(output, encoder(F.col(text_col)))
    if dimensions is None:
        return encoded
    return encoded.withColumn(output, check_dimensions(F.col(output), dimensions))


def encode_queries(
    queries: DataFrame, encoder: Encoder, dimensions: int | None = None
) -> DataFrame:
    """Add `embedding` to every query, encoding each distinct trimmed text once.

    Fails on blank or over-long queries; `validate_queries` separates those beforehand.
    """
    text = strip_space(F.col("query"))
    checked = (
        F.when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("empty_query")))
        .when(F.length(text) > MAX_QUERY_CHARS, F.raise_error(F.lit("long_query")))
        .otherwise(text)
    )
    keyed = queries.withColumn("_text", checked)
    distinct = encode(keyed.select("_text").distinct(), "_text", encoder, dimensions)
    return keyed.join(distinct, "_text").drop("_text")
