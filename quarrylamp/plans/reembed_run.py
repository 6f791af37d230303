"""Re-encoding of a whole corpus in batches that outlive their driver.

A run keeps its state in a folder that all machines share:

* `plan`: every target document with its batch, made once, in id order;
* `chunks/batch=N`: the chunks that batch N has encoded;
* `progress`: a row per finished batch, written after the batch's chunks.

Small batches are encoded some at a time, in one job, so that a batch costs no jobs of its own.  A batch that has no row in `progress` is not done: a run that is called again writes it anew over what
was left of it, with the same ids, and goes on from there.  The stored tables must be the same
ones in every call of a run; they are read only.  `applied` gives the tables with all finished
batches put in, at any time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylamp.operators.chunking import MAX_TOKENS, OVERLAP, rechunk
from quarrylamp.operators.encode import Encoder
from quarrylamp.operators.ids import HEX_DIGITS, next_id
from quarrylamp.plans.ingest import new_chunk_rows, replace_chunks
from quarrylamp.plans.maintain import reembed_targets
from quarrylamp.schemas import CHUNK

PLAN = "batch long, document_id long"
PROGRESS = "batch long, documents long, chunks long, last_id long, next_chunk_id long"
WRITTEN = T.StructType([*CHUNK.fields, T.StructField("batch", T.LongType())])
#: The batch number of the row that says that the plan is complete.
PLANNED = -1
#: Ids that are numbered in one window, and ranges of ids that are summed up in one.
RANGE = 1 << 16
#: Documents that one job encodes if its batches are smaller, and batches that it encodes at most.
DOCUMENTS_A_JOB, BATCHES_A_JOB = 100_000, 1_000


def batched(targets: DataFrame, batch_documents: int) -> DataFrame:
    """`(batch, document_id)`: distinct ids dealt in their order into batches of equal size, from 0.

    Places are counted within ranges of ids; the ranges' own offsets are summed up in blocks
    of ranges, so no window holds more than RANGE rows but for the last, of a row per 2 ** 32 ids.
    """
    placed = targets.select("document_id", F.floor(F.col("document_id") / RANGE).alias("range")).withColumn(
        "place", F.row_number().over(Window.partitionBy("range").orderBy("document_id"))
    )
    block = F.floor(F.col("range") / RANGE).alias("block")
    counts = placed.groupBy("range").agg(F.count("*").alias("n")).select(block, "range", "n")

    def before(*keys: str) -> Column:
        window = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(window), F.lit(0))

    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before("block").alias("first"))
    offsets = counts.select("block", "range", before("block", "range").alias("within")).join(blocks, "block").select(
        "range", (F.col("first") + F.col("within")).alias("offset")
    )
    place = F.col("offset") + F.col("place") - 1
    return placed.join(offsets, "range").select(F.floor(place / batch_documents).alias("batch"), "document_id")


def _progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).parquet(f"{folder}/progress")


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all batches with their number, those without a progress row included."""
    return spark.read.schema(WRITTEN).parquet(f"{folder}/chunks")


def _note(spark: SparkSession, folder: str, *rows: tuple) -> None:
    spark.createDataFrame(list(rows), PROGRESS).coalesce(1).write.mode("append").parquet(f"{folder}/progress")


def reembed_run(
    documents: DataFrame,
    chunks: DataFrame,
    encoder: Encoder,
    model: str,
    folder: str,
    batch_documents: int = 100_000,
    max_batches: int | None = None,
    force: bool = False,
    rechunk_legacy: bool = True,
    limit_documents: int | None = None,
    now: Column | None = None,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Start or go on with the run in `folder`; its `totals` after at most `max_batches` more batches.

    Targets, `force`, `limit_documents` and the size of a batch are fixed by the first call.  A batch reads
    the stored chunks of its range of document ids only, so tables sorted by it are read once a run.
    Nothing to do gives no batch and no row.
    """
    spark = documents.sparkSession
    now = F.current_timestamp() if now is None else now
    _note(spark, folder)
    if _progress(spark, folder).isEmpty():
        targets = reembed_targets(documents, chunks, model, force, limit_documents)
        plan = batched(targets, batch_documents).repartitionByRange("document_id").sortWithinPartitions("document_id")
        plan.write.mode("overwrite").parquet(f"{folder}/plan")
        _note(spark, folder, (PLANNED, 0, 0, None, next_id(chunks)))
    plan = spark.read.schema(PLAN).parquet(f"{folder}/plan")
    done, start = _progress(spark, folder).agg(F.max("batch"), F.max("next_chunk_id")).first()
    last = plan.agg(F.max("batch")).first()[0]
    end = done if last is None else last
    end = end if max_batches is None else min(end, done + max_batches)
    at_once = min(max(DOCUMENTS_A_JOB // batch_documents, 1), BATCHES_A_JOB)
    # Many batches in one job are tasks enough; their files stay few.
    digits = HEX_DIGITS if at_once == 1 else 1 if at_once < 64 else 0
    for first in range(done + 1, 1 + end, at_once):
        batches = F.col("batch").between(first, min(first + at_once - 1, end))
        mine = plan.filter(batches)
        low, high = mine.agg(F.min("document_id"), F.max("document_id")).first()
        theirs = chunks.filter(F.col("document_id").between(low, high)).select(
            "document_id", "chunk_index", "content", "embedding_model"
        ).join(mine.select("document_id"), "document_id", "left_semi")
        pieces = rechunk(theirs, max_tokens, overlap, rechunk_legacy).join(
            mine.distinct(), "document_id"
        )
        new_chunk_rows(pieces, encoder, model, start, now, "batch", digits).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(f"{folder}/chunks")
        written = _written(spark, folder).filter(batches).groupBy("batch").agg(F.count("*").alias("chunks"))
        counts = mine.groupBy("batch").agg(F.count("*").alias("documents"), F.max("document_id").alias("last_id"))
        finished = []
        for row in counts.join(written, "batch", "left").orderBy("batch").collect():  # a row a batch
            start += row["chunks"] or 0
            finished.append((row["batch"], row["documents"], row["chunks"] or 0, row["last_id"], start))
        _note(spark, folder, *finished)
    return totals(spark, folder)


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """A row per finished batch: its documents, chunks and last id, and the sums up to it."""
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch
    return _progress(spark, folder).filter(F.col("batch") > PLANNED).select(
        "batch", "last_id", "documents", "chunks",
        F.sum("documents").over(so_far).alias("documents_so_far"),
        F.sum("chunks").over(so_far).alias("chunks_so_far"),
    )


def applied(
    documents: DataFrame, chunks: DataFrame, folder: str, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """`(documents, chunks)` with the finished batches of a run put in; of documents `updated_at` changes."""
    spark = documents.sparkSession
    done = _progress(spark, folder).agg(F.max("batch")).first()[0]
    if done == PLANNED:
        return documents, chunks
    now = F.current_timestamp() if now is None else now
    finished = spark.read.schema(PLAN).parquet(f"{folder}/plan").filter(F.col("batch") <= done).select("document_id")
    written = _written(spark, folder).filter(F.col("batch") <= done)
    touched = finished.select(F.col("document_id").alias("id"), F.lit(True).alias("_touched"))
    updated = documents.join(touched, "id", "left").withColumn(
        "updated_at", F.when(F.col("_touched"), now).otherwise(F.col("updated_at"))
    )
    return updated.select(*documents.columns), replace_chunks(chunks, finished, written)
