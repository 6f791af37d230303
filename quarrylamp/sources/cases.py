"""Labelled search cases and result files as JSON, and tab-separated sentence pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylamp.operators.topk import first_row
from quarrylamp.schemas import RELEVANCE_CASE
from quarrylamp.sources.tables import materialized


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """`(query_id, query, url, grade)` of a JSON array of cases.

    Graded `relevance` wins over binary `relevant_urls`; grades of 0 or less are dropped;
    URLs stay as written.  A file that is not an array of objects, or a case without query,
    labels or any relevant URL, fails the job.
    """
    text = spark.read.text(path, wholetext=True)
    shape = T.ArrayType(T.StringType())
    items = F.from_json("value", shape)
    elements = text.select(
        F.posexplode(
            F.when(items.isNull() | ~F.ltrim("value").startswith("["), _refuse(
                "not_an_array"
            ).cast("array<string>")).otherwise(items)
        ).alias("query_id", "item")
    )
    parsed = elements.withColumn("case", F.from_json("item", RELEVANCE_CASE)).withColumn(
        "keys", F.json_object_keys("item")
    )
    graded = F.array_contains("keys", "relevance")
    binary = F.map_from_arrays(
        F.array_distinct("case.relevant_urls"),
        F.transform(F.array_distinct("case.relevant_urls"), lambda _: F.lit(1.0)),
    )
    labels = F.map_filter(
        F.when(graded, F.col("case.relevance")).otherwise(binary), lambda _, grade: grade > 0
    )
    problem = (
        F.when(F.col("keys").isNull(), "not_an_object")
        .when(F.coalesce("case.query", F.lit("")) == "", "no_query")
        .when(
            ~graded & ~F.array_contains("keys", "relevant_urls"),
            "no_labels",
        )
        .when(F.coalesce(F.size(labels), F.lit(0)) <= 0, "no_positive_label")
    )
    checked = F.when(
        problem.isNotNull(),
        _refuse(F.concat(F.lit("case "), F.col("query_id").cast("string"), F.lit(" "), problem))
        .cast("map<string,double>"),
    ).otherwise(labels)
    return parsed.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("case.query").alias("query"),
        F.explode(checked).alias("url", "grade"),
    )


def _refuse(message) -> F.Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def write_report(per_case: DataFrame, path: str, cases_a_file: int = 10_000) -> None:
    """Per-case metrics as JSON documents `{"cases": [...]}`; parent folders are created.

    A file is one document of about `cases_a_file` cases in order of their columns; a report of
    any size is several files.  No cases give one document with an empty list.
    """
    held = materialized(per_case)
    rows = held.count()
    part = F.pmod(F.xxhash64(*held.columns), F.lit(1 + rows // cases_a_file)).alias("part")
    listed = held.groupBy(part).agg(F.array_sort(F.collect_list(F.struct(*held.columns))).alias("cases"))
    if not rows:
        listed = held.sparkSession.range(1).select(F.col("id").alias("part"), F.array().alias("cases"))
    documents = listed.select("part", F.to_json(F.struct("cases")).alias("value"))
    documents.write.mode("overwrite").partitionBy("part").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a stored report, one row each."""
    cases = spark.read.json(path).select(F.explode("cases").alias("case"))
    return cases.select("case.*")


def read_pairs(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Tab-separated table with a header, keeping the first row of every `key`.

    Row order is file order, which the position inside the file decides.
    """
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, escape='"')
    ordered = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
    )
    first = first_row(ordered, [key], [F.col("_file"), F.col("_block"), F.col("_row")])
    return first.drop("_file", "_block", "_row")
