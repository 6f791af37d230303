"""Paged search over a batch of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.urls import display_host, display_path
from quarrylamp.operators.ann import CellIndex
from quarrylamp.operators.encode import Encoder, encode_queries
from quarrylamp.operators.ids import random_key
from quarrylamp.operators.postings import Lexicon, simple_lexicon
from quarrylamp.operators.rings import RingIndex
from quarrylamp.operators.sampling import random_documents_batch
from quarrylamp.operators.sizing import settle
from quarrylamp.operators.validate import LANDING_ROWS, validate_queries
from quarrylamp.plans.hybrid import CANDIDATES, THRESHOLD, hybrid_search

RESULT = ["query_id", "rank", "url", "title", "content", "description", "page_number", "has_next"]


def widened(queries: DataFrame, vector_candidates: int, text_candidates: int) -> DataFrame:
    """Requests with one look-ahead row and candidate cuts that reach the asked page."""
    reach = F.col("result_offset") + F.col("result_per_page") + 1
    return queries.withColumns(
        {
            "result_limit": F.col("result_per_page") + 1,
            "vector_k": F.greatest(F.lit(vector_candidates), reach),
            "text_k": F.greatest(F.lit(text_candidates), reach),
        }
    )


def page_of(ranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Drop the look-ahead row and say whether there was one.

    Results are one page per query, so counting them per query stays small.
    """
    last = F.col("result_offset") + F.col("result_per_page")
    more = ranked.groupBy("query_id").agg(F.max("rank").alias("last_rank"))
    asked = queries.select("query_id", "result_offset", "result_per_page", "page_number")
    return (
        ranked.join(asked.join(more, "query_id"), "query_id")
        .withColumn("has_next", F.col("last_rank") > last)
        .filter(F.col("rank") <= last)
        .withColumn("rank", F.col("rank") - F.col("result_offset"))
        .drop("last_rank")
    )


def landing_rows(documents: DataFrame, blank: DataFrame, seed: int = 0) -> DataFrame:
    """Random rows for blank requests; the page number is echoed and there is no next page."""
    pivot = F.col("pivot") if "pivot" in blank.columns else random_key(F.col("query_id"), seed)
    requests = blank.select("query_id", F.col("result_per_page").alias("n"), pivot.alias("pivot"))
    echoed = blank.select("query_id", "page_number")
    return (
        random_documents_batch(documents, requests)
        .join(echoed, "query_id")
        .withColumn("content", F.lit(""))
        .withColumn("has_next", F.lit(False))
        .select(*RESULT)
    )


def landing_page(documents: DataFrame, seed: int = 0) -> DataFrame:
    """What a visitor sees before searching: page 1 of one blank request."""
    spark = documents.sparkSession
    blank = spark.range(1).select(
        F.col("id").alias("query_id"),
        F.lit(1).alias("page_number"),
        F.lit(LANDING_ROWS).alias("result_per_page"),
    )
    return landing_rows(documents, blank, seed)


def search(
    queries: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    chunk_postings: DataFrame,
    doc_postings: DataFrame,
    encoder: Encoder | None = None,
    dimensions: int | None = None,
    threshold: float = THRESHOLD,
    vector_candidates: int = CANDIDATES,
    text_candidates: int = CANDIDATES,
    half: bool = True,
    lexicon: Lexicon = simple_lexicon,
    seed: int = 0,
    cells: CellIndex | RingIndex | None = None,
    probes: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Answer `queries(query_id, query, page_number, result_per_page)`.

    Returns the result rows and the refused requests.  Requests may bring their own
    `embedding` column, otherwise `encoder` is used, once per distinct text.  With `cells`, an
    index of the chunks' vectors, `probes` cells are read per request; an index of rings is read
    until no unread ring can hold a better row.
    """
    queries, _ = settle(queries)
    accepted, refused = validate_queries(queries)
    asked = accepted.filter(~F.col("blank"))
    if "embedding" not in queries.columns:
        if encoder is None:
            raise ValueError("requests without embeddings need an encoder")
        asked = encode_queries(asked, encoder, dimensions)
    asked = widened(asked, vector_candidates, text_candidates)
    # The deepest page any request could ask for would forbid every broadcast and early cut.
    reach = asked.agg(F.max(F.greatest("vector_k", "text_k"))).first()[0]
    ranked = hybrid_search(
        asked, documents, chunks, chunk_postings, doc_postings, threshold,
        "vector_k", "text_k", half, lexicon,
        max_candidates=reach or max(vector_candidates, text_candidates),
        cells=cells, probes=probes,
    )
    found = page_of(ranked, asked).select(
        "query_id", "rank", "url", "title", F.col("snippet").alias("content"),
        "description", "page_number", "has_next",
    )
    landing = landing_rows(documents, accepted.filter("blank"), seed)
    return found.unionByName(landing), refused


def display(results: DataFrame) -> DataFrame:
    """Result rows with the host and page parts shown to a reader and `has_previous`."""
    return results.withColumns(
        {
            "host": display_host(F.col("url")),
            "page": display_path(F.col("url")),
            "page_number": F.greatest(F.col("page_number"), F.lit(1)),
            "has_previous": F.col("page_number") > 1,
        }
    )
