"""Reading and loading stored tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Parquet table, read where it lies."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in spark.checkpoint.dir.  Without one, a session on one machine, as in
    tests, gets a temporary folder; on a cluster that is an error, as machines share no such folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarrylamp.scratch", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("quarrylamp.scratch", folder)
    return folder.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: its plan is cut and runs once."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Bulk load: add the rows of a batch to a table."""
    df.write.mode("append").parquet(path)


def table_stats(table: DataFrame) -> DataFrame:
    """`(vectors, table_bytes, files)` of a file-backed table; sizes come from file metadata."""
    per_file = table.groupBy("_metadata.file_path", "_metadata.file_size").agg(
        F.count("*").alias("n")
    )
    return per_file.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("table_bytes"),
        F.count("*").alias("files"),
    )


def without_host(
    documents: DataFrame, chunks: DataFrame, host: str
) -> tuple[DataFrame, DataFrame]:
    """Documents not of `host` (unknown hosts stay) and the chunks they still own."""
    gone = documents.filter(F.col("source_host") == host).select(F.col("id").alias("document_id"))
    kept = documents.filter(~F.col("source_host").eqNullSafe(host))
    return kept, chunks.join(gone, "document_id", "left_anti")
