"""Explicit schemas of the stored tables; nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("references", T.ArrayType(T.StringType())),
    ]
)

INGEST_MESSAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("seq", T.LongType()),
    ]
)

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("source_host", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("crawled_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("random_key", T.DoubleType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("document_id", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

RELEVANCE_CASE = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("relevance", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("relevant_urls", T.ArrayType(T.StringType())),
    ]
)

DOCUMENT_COLUMNS = DOCUMENT.fieldNames()
CHUNK_COLUMNS = CHUNK.fieldNames()
