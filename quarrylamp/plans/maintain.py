"""Maintenance of stored tables: backfill, reassembly, re-encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.stats import ordered_text
from quarrylamp.operators.chunking import LEGACY_MODEL, MAX_TOKENS, OVERLAP, rechunk
from quarrylamp.operators.encode import Encoder
from quarrylamp.operators.ids import first_free, next_id, number_rows
from quarrylamp.operators.postings import (
    Lexicon,
    chunk_postings,
    document_postings,
    laid_out_like,
    lies_by_unit,
    simple_lexicon,
)
from quarrylamp.operators.sizing import marked, without
from quarrylamp.operators.topk import best_row
from quarrylamp.plans.ingest import Changes, new_chunk_rows, replace_chunks
from quarrylamp.schemas import CHUNK_COLUMNS


def backfill_chunks(
    documents: DataFrame, chunks: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """One chunk of the legacy model per embedded document that has none.

    `documents` carries whole-document `content` and `embedding`.  Returns the documents with
    empty content and the extended chunks; a new chunk takes the next id in document order of
    the id numbering.
    """
    bare = documents.filter(F.col("embedding").isNotNull()).join(
        chunks.select(F.col("document_id").alias("id")), "id", "left_anti"
    )
    created = F.current_timestamp() if now is None else now
    rows = number_rows(
        bare.select(F.col("id").alias("document_id"), "content", "embedding"),
        F.col("document_id"), next_id(chunks),
    ).select(
        "id", "document_id",
        F.lit(0).alias("chunk_index"),
        F.coalesce("content", F.lit("")).alias("content"),
        "embedding",
        F.lit(LEGACY_MODEL).alias("embedding_model"),
        created.alias("created_at"),
    )
    emptied = documents.withColumn("content", F.lit(None).cast("string"))
    return emptied, chunks.select(*CHUNK_COLUMNS).unionByName(rows.select(*CHUNK_COLUMNS))


def reassemble_documents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with missing content and embedding filled from their chunks."""
    texts = chunks.groupBy("document_id").agg(
        ordered_text(F.col("content"), F.col("chunk_index")).alias("joined")
    )
    first = chunks.filter("chunk_index = 0").select(
        "document_id", F.col("embedding").alias("first_embedding")
    )
    stored = documents
    if "embedding" not in documents.columns:
        stored = documents.withColumn("embedding", F.lit(None).cast("array<float>"))
    return (
        stored.join(texts.withColumnRenamed("document_id", "id"), "id", "left")
        .join(first.withColumnRenamed("document_id", "id"), "id", "left")
        .withColumn("content", F.coalesce("content", "joined"))
        .withColumn("embedding", F.coalesce("embedding", "first_embedding"))
        .drop("joined", "first_embedding")
    )


def reembed_targets(
    documents: DataFrame,
    chunks: DataFrame,
    model: str,
    force: bool = False,
    limit_documents: int | None = None,
    after_id: int | None = None,
) -> DataFrame:
    """`(document_id)` of documents with a chunk of another model (or any chunk, if forced).

    `after_id` and `limit_documents` select a batch in id order.
    """
    owned = chunks.select("document_id", "embedding_model")
    stale = owned if force else owned.filter(F.col("embedding_model") != model)
    ids = documents.select(F.col("id").alias("document_id"))
    if after_id is not None:
        ids = ids.filter(F.col("document_id") > after_id)
    targets = ids.join(stale, "document_id", "left_semi")
    if limit_documents is None:
        return targets
    return targets.orderBy("document_id").limit(limit_documents)


def reembed_counts(chunks: DataFrame, model: str, force: bool = False) -> DataFrame:
    """`(documents, chunks)` a run would start from; counts stale chunks only."""
    stale = chunks if force else chunks.filter(F.col("embedding_model") != model)
    # Reduced per document first, so no task has to hold all distinct ids.
    per_document = stale.groupBy("document_id").agg(F.count("*").alias("n"))
    return per_document.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
    )


def reembed(
    documents: DataFrame,
    chunks: DataFrame,
    encoder: Encoder,
    model: str,
    force: bool = False,
    rechunk_legacy: bool = True,
    limit_documents: int | None = None,
    now: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(documents, chunks, totals)` after encoding every chunk of each target again.

    Only `updated_at` of the documents changes.  An interrupted run can be repeated: finished
    documents are no longer targets.
    """
    now = F.current_timestamp() if now is None else now
    targets = reembed_targets(documents, chunks, model, force, limit_documents)
    # Only the contents of the targets are gathered; the others stay where they are.
    held = chunks.select("document_id", "chunk_index", "content", "embedding_model")
    theirs = marked(held, targets, "document_id", "_target").filter("_target").drop("_target")
    pieces = rechunk(theirs, max_tokens, overlap, rechunk_legacy)
    rewritten = new_chunk_rows(pieces, encoder, model, first_free(chunks), now)
    touched = targets.select(F.col("document_id").alias("id"), F.lit(True).alias("_touched"))
    updated = (
        documents.join(touched, "id", "left")
        .withColumn("updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at")))
        .select(*documents.columns)
    )
    per_document = pieces.groupBy("document_id").agg(F.count("*").alias("n"))
    totals = per_document.agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks")
    )
    return updated, replace_chunks(chunks, targets, rewritten), totals


def refreshed_postings(
    chunk_index: DataFrame,
    document_index: DataFrame,
    changes: Changes,
    gone: DataFrame | None = None,
    lexicon: Lexicon = simple_lexicon,
) -> tuple[DataFrame, DataFrame]:
    """Both postings tables after an ingest batch and the removal of documents `gone(id)`.

    Chunk postings go with their document, document postings also for a change of title or
    description alone.  What did not change is neither read as text nor moved: the changed ids
    are looked up as words of bits.
    """
    void_chunks, void_documents = changes.replaced, changes.documents.select(F.col("id").alias("unit_id"))
    if gone is not None:
        void_chunks = void_chunks.unionByName(gone.select(F.col("id").alias("document_id")))
        void_documents = void_documents.unionByName(gone.select(F.col("id").alias("unit_id")))
    chunks = without(chunk_index, void_chunks, "document_id").unionByName(
        laid_out_like(chunk_index, chunk_postings(changes.chunks, lexicon, lies_by_unit(chunk_index)))
    )
    documents = without(document_index, void_documents, "unit_id").unionByName(
        laid_out_like(document_index, document_postings(changes.documents, lexicon))
    )
    return chunks, documents


def first_chunk_contents(chunks: DataFrame) -> DataFrame:
    """`(document_id, content)` of the chunk with the smallest index of every document."""
    flat = chunks.select("document_id", "chunk_index", "content", F.lit(0).alias("_none"))
    return best_row(flat, ["document_id"], "_none", "chunk_index", ["content"])
