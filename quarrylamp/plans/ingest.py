"""Page ingest: validate, keep the latest, detect changes, re-encode only what changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import content_hash
from quarrylamp.operators.chunking import MAX_TOKENS, OVERLAP, chunk
from quarrylamp.operators.encode import Encoder, encode
from quarrylamp.operators.ids import HEX_DIGITS, next_id, number_rows, random_key
from quarrylamp.operators.sizing import BROADCAST_BYTES, BROADCAST_ROWS, fetch
from quarrylamp.operators.topk import first_row
from quarrylamp.operators.validate import validate_pages
from quarrylamp.schemas import CHUNK_COLUMNS, DOCUMENT_COLUMNS
from quarrylamp.sources.tables import materialized

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


@dataclass
class Changes:
    """Rows an ingest batch adds or replaces.

    The classification is stored once and all results start from it; chunks are cut and encoded
    only where they are asked for.
    """

    documents: DataFrame  # full rows of new and touched documents
    replaced: DataFrame  # (document_id) whose stored chunks are void
    status: DataFrame  # (url, id, status)
    rejects: DataFrame
    make_chunks: Callable[[], DataFrame]

    @cached_property
    def chunks(self) -> DataFrame:
        """All chunks of new and changed documents."""
        return self.make_chunks()


def latest_per_url(messages: DataFrame) -> DataFrame:
    """The last arrival of every URL, without its content (hash only).

    Contents are fetched later for the few messages that need encoding, so they neither take
    part in this shuffle nor pile up on a URL that arrives very often.
    """
    light = messages.select(
        "url", "title", "description", "source_host", "seq",
        content_hash(F.col("content")).alias("content_hash"),
    )
    # The largest (seq, hash) of a URL: fixed width, so it is reduced before the shuffle.
    last = light.groupBy("url").agg(F.max(F.struct("seq", "content_hash")).alias("last")).select(
        "url", "last.seq", "last.content_hash"
    )
    kept = light.join(last, (light["url"] == last["url"]) & light["seq"].eqNullSafe(last["seq"])
                      & light["content_hash"].eqNullSafe(last["content_hash"]), "left_semi")
    # Messages that agree in all three may still differ in title; the smallest row stays.
    return first_row(kept, ["url"], [F.col("title"), F.col("description")])


def current_documents(candidates: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """Those `candidates(document_id)` with chunks, all of them of `model`."""
    owned = chunks.select("document_id", "embedding_model")
    having = candidates.join(owned.select("document_id"), "document_id", "left_semi")
    stale = owned.filter(F.col("embedding_model") != model)
    return having.join(stale, "document_id", "left_anti")


def classify(
    latest: DataFrame, documents: DataFrame, chunks: DataFrame, model: str
) -> DataFrame:
    """Latest messages with the stored `id` (NULL if new) and `status`.

    Unchanged means: same content hash, and chunks of the current model only.
    """
    stored = documents.select("id", "url", F.col("content_hash").alias("stored_hash"))
    known = latest.join(stored, "url", "left")
    same = known.filter(F.col("stored_hash") == F.col("content_hash"))
    current = current_documents(
        same.select(F.col("id").alias("document_id")), chunks, model
    ).withColumn("is_current", F.lit(True))
    status = (
        F.when(F.col("id").isNull(), NEW)
        .when(F.col("is_current"), UNCHANGED)
        .otherwise(CHANGED)
    )
    return (
        known.join(current.withColumnRenamed("document_id", "id"), "id", "left")
        .withColumn("status", status)
        .drop("stored_hash", "is_current")
    )


def ingest_changes(
    pages: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    encoder: Encoder,
    model: str,
    now: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    seed: int = 0,
) -> Changes:
    """What `pages(url, title, content, description, seq)` change in the stored tables."""
    now = F.current_timestamp() if now is None else now
    messages, rejects = validate_pages(pages)
    classified = materialized(classify(latest_per_url(messages), documents, chunks, model))
    # Only the new URLs are numbered; the rest of their rows stays where it is.
    numbers = materialized(
        number_rows(classified.filter(F.col("status") == NEW).select("url"), F.col("url"), next_id(documents), "new_id")
    )
    identified = (
        classified.join(numbers, "url", "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id")
    )

    kept = documents.select("id", F.col("random_key").alias("stored_key"))
    new_key = random_key(F.col("url"), seed)
    written = identified.join(kept, "id", "left").select(
        "id", "url", "title",
        F.lit(None).cast("string").alias("content"),
        "description", "source_host", "content_hash",
        now.alias("crawled_at"), now.alias("updated_at"),
        F.coalesce("stored_key", new_key).alias("random_key"),
    )

    encodable = identified.filter(F.col("status") != UNCHANGED).select(
        F.col("id").alias("document_id"), "url", "seq", "content_hash"
    )
    def make_chunks() -> DataFrame:
        # Only the changed messages are looked up: broadcast if they are few, so that unchanged
        # contents stay where they are.  Equal messages give one content.
        rows, size = encodable.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("url") + 128), F.lit(0))).first()
        few = rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES
        # Contents are hashed where a message of the same URL and number is asked for.
        found = fetch(encodable, messages.select("url", "seq", "content"), ["url", "seq"], rows if few else None).filter(
            content_hash(F.col("content")) == F.col("content_hash")
        )
        texts = found.groupBy("document_id").agg(F.first("content").alias("content"))
        # Stored, as the ids are counted first and given then.
        pieces = materialized(chunk(texts, "content", max_tokens, overlap))
        return new_chunk_rows(pieces, encoder, model, next_id(chunks), now)

    return Changes(
        documents=written.select(*DOCUMENT_COLUMNS),
        replaced=encodable.select("document_id"),
        status=identified.select("url", "id", "status"),
        rejects=rejects,
        make_chunks=make_chunks,
    )


def new_chunk_rows(
    pieces: DataFrame, encoder: Encoder, model: str, start_id: int | DataFrame, now: Column,
    batch: str | None = None, hex_digits: int = HEX_DIGITS,
) -> DataFrame:
    """Encode `(document_id, chunk_index, content)` rows into stored chunks.

    With a column `batch`, which stays, the batches get their ids one after the other; a batch
    is dealt over 16 ** hex_digits tasks at most.
    """
    place = F.concat_ws(":", "document_id", "chunk_index")
    # Numbered before encoding: the vectors then do not travel with the numbering.
    numbered = number_rows(pieces, place, start_id, hex_digits=hex_digits, within=batch)
    encoded = encode(numbered, "content", encoder)
    return encoded.select(
        "id", "document_id", F.col("chunk_index").cast("int").alias("chunk_index"), "content",
        "embedding", F.lit(model).alias("embedding_model"), now.alias("created_at"), *([] if batch is None else [batch]),
    )


def merge_documents(documents: DataFrame, written: DataFrame) -> DataFrame:
    """Stored rows that were not written again, plus the written ones."""
    untouched = documents.join(written.select("id"), "id", "left_anti")
    return untouched.select(*DOCUMENT_COLUMNS).unionByName(written.select(*DOCUMENT_COLUMNS))


def replace_chunks(chunks: DataFrame, replaced: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """All chunks of `replaced(document_id)` exchanged for the new ones."""
    kept = chunks.join(replaced, "document_id", "left_anti")
    return kept.select(*CHUNK_COLUMNS).unionByName(new_chunks.select(*CHUNK_COLUMNS))


def ingest(
    pages: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    encoder: Encoder,
    model: str,
    now: Column | None = None,
    **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(documents, chunks, status)` after applying a batch of messages."""
    changes = ingest_changes(pages, documents, chunks, encoder, model, now, **options)
    return (
        merge_documents(documents, changes.documents),
        replace_chunks(chunks, changes.replaced, changes.chunks),
        changes.status,
    )


def delete_documents(
    documents: DataFrame, chunks: DataFrame, gone: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Remove documents `gone(id)` and, with them, their chunks."""
    owners = gone.select(F.col("id").alias("document_id"))
    return (
        documents.join(gone.select("id"), "id", "left_anti"),
        chunks.join(owners, "document_id", "left_anti"),
    )
