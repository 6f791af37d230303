"""Validation of ingest messages and search requests.

Every rule is part of one ordered expression, so a row is reported with the first rule it
breaks and nothing aborts the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import is_blank
from quarrylamp.functions.urls import canonical_url, source_host

MAX_URL_CHARS = 2_048
MAX_TITLE_CHARS = 1_000
MAX_DESCRIPTION_CHARS = 4_000
MAX_CONTENT_BYTES = 900_000
MAX_QUERY_CHARS = 512
MAX_PAGE = 100
MAX_PER_PAGE = 50
DEFAULT_PER_PAGE = 10
LANDING_ROWS = 5


def page_reject_reason(url: Column, title: Column, description: Column, content: Column) -> Column:
    """Why an ingest message is refused, NULL when it is accepted."""
    return (
        F.when(is_blank(url) | is_blank(content), "empty_page")
        .when(F.length(url) > MAX_URL_CHARS, "long_url")
        .when(canonical_url(url).isNull(), "bad_url")
        .when(
            (F.length(title) > MAX_TITLE_CHARS) | (F.length(description) > MAX_DESCRIPTION_CHARS),
            "long_metadata",
        )
        .when(F.octet_length(content) > MAX_CONTENT_BYTES, "large_content")
    )


def check_pages(pages: DataFrame) -> DataFrame:
    """Messages with absent texts as '' plus `reject_reason`."""
    filled = pages.withColumns(
        {c: F.coalesce(F.col(c), F.lit("")) for c in ("url", "title", "content", "description")}
    )
    return filled.withColumn(
        "reject_reason",
        page_reject_reason(F.col("url"), F.col("title"), F.col("description"), F.col("content")),
    )


def validate_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted messages (canonical url, `source_host` added) and refused ones with the reason."""
    checked = check_pages(pages)
    accepted = (
        checked.filter(F.col("reject_reason").isNull())
        .drop("reject_reason")
        .withColumn("url", canonical_url(F.col("url")))
        .withColumn("source_host", source_host(F.col("url")))
    )
    return accepted, checked.filter(F.col("reject_reason").isNotNull())


def check_queries(queries: DataFrame) -> DataFrame:
    """Requests with defaults filled in, plus `blank`, `result_offset` and `reject_reason`.

    Zero or absent page values mean page 1 and 10 rows a page (5 for a blank query).
    """
    filled = queries.withColumn("query", F.coalesce(F.col("query"), F.lit("")))
    blank = is_blank(F.col("query"))

    def or_default(column: str, default: Column) -> Column:
        value = F.coalesce(F.col(column), F.lit(0))
        return F.when(value == 0, default).otherwise(value).cast("int")

    page, size = F.col("page_number"), F.col("result_per_page")
    rows = F.when(blank, F.lit(LANDING_ROWS)).otherwise(F.lit(DEFAULT_PER_PAGE))
    return (
        filled.withColumn("blank", blank)
        .withColumn("page_number", or_default("page_number", F.lit(1)))
        .withColumn("result_per_page", or_default("result_per_page", rows))
        .withColumn(
            "reject_reason",
            F.when(F.length("query") > MAX_QUERY_CHARS, "long_query")
            .when(~page.between(1, MAX_PAGE), "page_out_of_range")
            .when(~size.between(1, MAX_PER_PAGE), "page_size_out_of_range"),
        )
        .withColumn("result_offset", (page - 1) * size)
    )


def validate_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_queries(queries)
    accepted = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.filter(F.col("reject_reason").isNotNull())
