"""Synthetic corpus of any size, the same for a seed whatever the parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylamp.functions.text import content_hash
from quarrylamp.functions.vectors import l2_normalize

# The words texts are drawn from and the constant columns.
VOCABULARY = (
    "architecture authentication benchmark caching crawler database deployment "
    "embedding frontend grpc indexing latency migration model observability "
    "pagination postgres production query ranking retrieval search security "
    "service storage testing vector website"
).split()
HOST = "benchmark.local"
MODEL = "benchmark-random-v1"
WORDS = 80


def _draw(seed: int, *parts: Column) -> Column:
    """32 random bits that depend on the seed and the parts only."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _uniform(seed: int, *parts: Column) -> Column:
    """Number strictly between 0 and 1."""
    return (_draw(seed, *parts).cast("double") + 0.5) / float(1 << 32)


def synthetic_documents(ids: DataFrame, seed: int = 42) -> DataFrame:
    """Document rows for `ids(id)`."""
    name = F.concat(F.lit("synthetic benchmark document "), F.col("id"))
    return ids.select(
        "id",
        F.concat(F.lit(f"https://{HOST}/documents/"), F.col("id")).alias("url"),
        F.concat(F.lit("Benchmark document "), F.col("id")).alias("title"),
        F.lit(None).cast("string").alias("content"),
        F.lit("Synthetic benchmark document").alias("description"),
        F.lit(HOST).alias("source_host"),
        content_hash(name).alias("content_hash"),
        F.current_timestamp().alias("crawled_at"),
        F.current_timestamp().alias("updated_at"),
        _uniform(seed, F.col("id")).alias("random_key"),
    )


def synthetic_chunks(
    ids: DataFrame,
    chunks_per_document: int = 5,
    dimensions: int = 768,
    seed: int = 42,
    start_chunk_id: int = 1,
    first_document_id: int = 1,
) -> DataFrame:
    """Chunk rows for `ids(id)`: random words and a random unit vector each."""
    position = F.explode(F.sequence(F.lit(0), F.lit(chunks_per_document - 1)))
    rows = ids.select(F.col("id").alias("document_id"), position.alias("chunk_index"))
    vocabulary = F.lit(VOCABULARY)

    def word(i: Column) -> Column:
        drawn = _draw(seed, F.col("document_id"), F.col("chunk_index"), i)
        return F.element_at(vocabulary, (drawn % len(VOCABULARY)).cast("int") + 1)

    def gaussian(i: Column) -> Column:
        radius = F.sqrt(-2 * F.log(_uniform(seed + 1, F.col("document_id"), F.col("chunk_index"), i)))
        angle = _uniform(seed + 2, F.col("document_id"), F.col("chunk_index"), i)
        return (radius * F.cos(2 * F.pi() * angle)).cast("float")

    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), word), " ")
    drawn = rows.withColumn(
        "embedding", F.transform(F.sequence(F.lit(1), F.lit(dimensions)), gaussian)
    )
    offset = (F.col("document_id") - first_document_id) * chunks_per_document
    return drawn.select(
        (F.lit(start_chunk_id) + offset + F.col("chunk_index")).cast("long").alias("id"),
        "document_id",
        "chunk_index",
        F.concat(
            F.lit("document "), F.col("document_id"), F.lit(" chunk "), F.col("chunk_index"),
            F.lit(" "), texts,
        ).alias("content"),
        l2_normalize(F.col("embedding")).alias("embedding"),
        F.lit(MODEL).alias("embedding_model"),
        F.current_timestamp().alias("created_at"),
    )


def synthetic_corpus(
    spark: SparkSession,
    n: int,
    chunks_per_document: int = 5,
    dimensions: int = 768,
    seed: int = 42,
    start_id: int = 1,
    start_chunk_id: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """`(documents, chunks)` of n synthetic documents with ids from `start_id`."""
    if min(n, chunks_per_document) < 1:
        raise ValueError("a corpus needs documents and chunks")
    ids = spark.range(start_id, start_id + n)
    return synthetic_documents(ids, seed), synthetic_chunks(
        ids, chunks_per_document, dimensions, seed, start_chunk_id, start_id
    )
