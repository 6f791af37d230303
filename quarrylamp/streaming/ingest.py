"""Incremental page ingest with Structured Streaming.

Spark's state store keeps, per canonical URL, the last arrival (its number, content hash and the
model its chunks are of).  A message is therefore new, changed or unchanged by its URL's state
alone; stored hashes and chunks are not read again.  Each micro-batch adds its rows as plain
Parquet under `batch=N`, written from earlier batches and the batch itself only, so a replayed
batch writes the same rows over its own folder.  Readers take the last batch of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quarrylamp.functions.text import content_hash
from quarrylamp.operators.chunking import MAX_TOKENS, OVERLAP, chunk
from quarrylamp.operators.encode import Encoder
from quarrylamp.operators.ids import next_id, number_rows, random_key
from quarrylamp.operators.validate import validate_pages
from quarrylamp.plans.ingest import CHANGED, NEW, UNCHANGED, new_chunk_rows
from quarrylamp.schemas import CHUNK, CHUNK_COLUMNS, DOCUMENT, DOCUMENT_COLUMNS, INGEST_MESSAGE
from quarrylamp.sources.tables import materialized

#: The folder of what was there before the first micro-batch.
BASE = -1
_DECIDED = (
    "url string, title string, description string, source_host string, seq long, content string, "
    "content_hash string, status string"
)
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def page_stream(
    spark: SparkSession, folder: str, max_files: int | None = None, schema=INGEST_MESSAGE
) -> DataFrame:
    """Stream of ingest messages arriving as Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


# -- tables ----------------------------------------------------------------------------------------


def create_tables(documents: DataFrame, chunks: DataFrame, root: str) -> None:
    """Lay out the folder of a stream with what is stored so far; an existing one is an error.

    `known` holds what the state of a URL starts from: its hash, and the model if all chunks are of one.
    """
    chunks.select(*CHUNK_COLUMNS).write.parquet(f"{root}/chunks/batch={BASE}")
    documents.select(*DOCUMENT_COLUMNS, F.lit(True).alias("replaced")).write.parquet(f"{root}/documents/batch={BASE}")
    models = chunks.groupBy(F.col("document_id").alias("id")).agg(
        F.min("embedding_model").alias("model"), F.max("embedding_model").alias("other")
    )
    documents.join(models, "id", "left").select(
        "url", "content_hash", F.when(F.col("model") == F.col("other"), F.col("model")).alias("model")
    ).write.parquet(f"{root}/known")


def _rows(spark: SparkSession, root: str, name: str, schema: T.StructType, before: int | None) -> DataFrame:
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/{name}")
    return rows if before is None else rows.filter(F.col("batch") < before)


def _written_documents(spark: SparkSession, root: str, before: int | None) -> DataFrame:
    schema = T.StructType([*DOCUMENT.fields, T.StructField("replaced", T.BooleanType())])
    return _rows(spark, root, "documents", schema, before)


def stored_documents(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Latest row of every document, of the micro-batches `before` one or of all."""
    rows = _written_documents(spark, root, before)
    last = rows.groupBy("id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["id", "batch"], "left_semi").select(*DOCUMENT_COLUMNS)


def stored_chunks(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Chunks that the last replacement of their document wrote.

    A batch's documents are written after its chunks, so chunks are seen once their batch is whole.
    """
    replaced = _written_documents(spark, root, before).filter("replaced")
    last = replaced.groupBy(F.col("id").alias("document_id")).agg(F.max("batch").alias("batch"))
    rows = _rows(spark, root, "chunks", CHUNK, before)
    return rows.join(last, ["document_id", "batch"], "left_semi").select(*CHUNK_COLUMNS)


# -- stream ----------------------------------------------------------------------------------------


class LastArrival(StatefulProcessor):
    """Decide on a URL's latest message of a micro-batch by the state of the URL.

    The largest (seq, content hash) wins, of ties the smallest (title, description).  A message
    that is older than the state gives no row.  Rows of `known` (stored) open a URL's state.
    """

    def __init__(self, model: str):
        self.model = model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, content_hash string, model string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        def age(seq: int | None, digest: str) -> tuple:
            return (seq is not None, seq or 0, digest)

        best, known = None, self.last.get()
        for row in rows:
            if row.stored:
                known = (None, row.content_hash, row.model)
                continue
            if best is None:
                best = row
                continue
            newer, kept = age(row.seq, row.content_hash), age(best.seq, best.content_hash)
            if newer > kept or newer == kept and (row.title, row.description) < (best.title, best.description):
                best = row
        if best is None:
            self.last.update(known)
            return
        status = NEW
        if known:
            seq, digest, model = known
            if seq is not None and age(best.seq, best.content_hash) < age(seq, digest):
                return
            status = UNCHANGED if (digest, model) == (best.content_hash, self.model) else CHANGED
        self.last.update((best.seq, best.content_hash, self.model))
        yield Row(
            url=best.url, title=best.title, description=best.description, source_host=best.source_host,
            seq=best.seq, content=None if status == UNCHANGED else best.content,
            content_hash=best.content_hash, status=status,
        )

    def close(self) -> None:
        pass


def _add_batch(
    decided: DataFrame, number: int, root: str, encoder: Encoder, model: str, now: Column,
    max_tokens: int, overlap: int, seed: int,
) -> None:
    """Write the chunks, then the documents of one micro-batch."""
    spark = decided.sparkSession
    # Stored once: every further use of a micro-batch would run its stateful step again.
    decided = materialized(decided)
    known = stored_documents(spark, root, number).select("id", "url", "random_key")
    fresh = decided.filter(F.col("status") == NEW).select("url")
    numbered = materialized(
        number_rows(fresh, F.col("url"), next_id(known)).withColumn("random_key", random_key(F.col("url"), seed))
        .unionByName(known.join(decided.filter(F.col("status") != NEW), "url", "left_semi"))
    )
    identified = decided.join(numbered, "url")
    changed = identified.filter(F.col("status") != UNCHANGED).select(F.col("id").alias("document_id"), "content")
    first_chunk = next_id(_rows(spark, root, "chunks", CHUNK, number))
    pieces = chunk(changed, "content", max_tokens, overlap)
    new_chunk_rows(pieces, encoder, model, first_chunk, now).select(*CHUNK_COLUMNS).write.mode("overwrite").parquet(
        f"{root}/chunks/batch={number}"
    )
    identified.select(
        "id", "url", "title", F.lit(None).cast("string").alias("content"), "description", "source_host",
        "content_hash", now.alias("crawled_at"), now.alias("updated_at"), "random_key",
        (F.col("status") != UNCHANGED).alias("replaced"),
    ).write.mode("overwrite").parquet(f"{root}/documents/batch={number}")


def ingest_stream(
    messages: DataFrame,
    root: str,
    encoder: Encoder,
    model: str,
    now: Column | None = None,
    trigger: dict | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    seed: int = 0,
) -> StreamingQuery:
    """Apply a stream of messages to the tables that `create_tables` laid out in `root`.

    The latest message of a URL wins, however messages fall into micro-batches.  The progress of
    the stream lies in the same folder, so tables and progress cannot be of different runs.
    """
    spark = messages.sparkSession
    now = F.current_timestamp() if now is None else now
    accepted, _ = validate_pages(messages)
    arrivals = accepted.withColumns({"content_hash": content_hash(F.col("content")), "stored": F.lit(False)})
    # All files of `known` are read by the first micro-batch.
    known = spark.readStream.schema("url string, content_hash string, model string").parquet(f"{root}/known")
    rows = arrivals.unionByName(known.withColumn("stored", F.lit(True)), allowMissingColumns=True)
    previous = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, _ROCKSDB)
    try:
        decided = rows.groupBy("url").transformWithState(LastArrival(model), _DECIDED, "Update", "None")
        return (
            decided.writeStream.outputMode("update")
            .foreachBatch(lambda batch, number: _add_batch(
                batch, number, root, encoder, model, now, max_tokens, overlap, seed))
            .option("checkpointLocation", f"{root}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        spark.conf.set(_STATE_STORE, previous)
