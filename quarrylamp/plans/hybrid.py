"""Hybrid ranking: vector candidates and text candidates blended per document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import blend, snippet
from quarrylamp.functions.vectors import cosine, half_precision
from quarrylamp.operators.ann import CellIndex
from quarrylamp.operators.nearest import NAN_LAST, nearest
from quarrylamp.operators.postings import Lexicon, simple_lexicon
from quarrylamp.operators.rings import RingIndex
from quarrylamp.operators.sizing import fetch, lookup_join, settle
from quarrylamp.operators.textmatch import match_and_rank, query_literals, top_text
from quarrylamp.operators.topk import best_row, top_k
from quarrylamp.operators.vector import best_chunk_per_document, chunk_candidates
from quarrylamp.sources.tables import materialized

THRESHOLD = 0.78
CANDIDATES = 200
CHUNK_PAIR = ["query_id", "document_id"]


def document_hybrid(
    queries: DataFrame,
    documents: DataFrame,
    postings: DataFrame,
    threshold: float = THRESHOLD,
    k: int = 10,
    lexicon: Lexicon = simple_lexicon,
) -> DataFrame:
    """Whole-document search: rows above the threshold or matching the text, blended.

    `documents(id, embedding, ...)`.  The vector part is not clamped and also counts for
    text matches below the threshold.  A row that matches no text can only be among the k
    best if it is among the k nearest, so the full scan hands on k rows per query; the
    similarity of text matches is computed for exactly those pairs.
    """
    queries, asked_rows = settle(queries)
    bounded = asked_rows is not None
    literals, _ = settle(query_literals(queries, lexicon=lexicon))
    vectors = documents.select("id", "embedding")
    matches = match_and_rank(
        postings, literals, documents.select(F.col("id").alias("unit_id")), bounded=bounded
    ).withColumnRenamed("unit_id", "id")
    asked = queries.select("query_id", F.col("embedding").alias("asked"))
    matched = lookup_join(matches.join(vectors, "id"), asked, ["query_id"], bounded=bounded)
    by_text = matched.select(
        "query_id", "id", cosine("embedding", "asked").alias("vector_similarity"), "text_rank"
    )
    near = nearest(
        queries, vectors, k, threshold if threshold >= 0 else None, nan_order=NAN_LAST
    ).filter(F.col("similarity") > threshold)
    if threshold < 0:
        # Undefined similarities count as 0 here and would outrank negative ones.
        zero = nearest(queries, vectors.filter(_is_zero()), k, None, nan_order=NAN_LAST)
        near = near.unionByName(zero).dropDuplicates(["query_id", "id"])
    by_vector = near.select(
        "query_id", "id", F.col("similarity").alias("vector_similarity"),
        F.lit(None).cast("double").alias("text_rank"),
    )
    pairs = by_text.unionByName(by_vector).groupBy("query_id", "id").agg(
        F.max("vector_similarity").alias("vector_similarity"),
        F.coalesce(F.max("text_rank"), F.lit(0.0)).alias("text_rank"),
    )
    scored = pairs.withColumn("similarity", 0.7 * F.col("vector_similarity") + 0.3 * F.col("text_rank"))
    order = [F.round("similarity", 9).desc(), F.col("id")]
    best = top_k(scored, ["query_id"], order, k, spread_by=["id"])
    shown = [c for c in ("url", "title", "content", "description") if c in documents.columns]
    return fetch(
        best.select("query_id", "rank", "id", "similarity"),
        documents.select("id", *shown),
        ["id"],
        _times(asked_rows, k),
    )


def _is_zero():
    return ~F.exists("embedding", lambda x: x != 0)


def _times(rows: int | None, per_query: int | None) -> int | None:
    return None if rows is None or per_query is None else rows * max(per_query, 1)


def first_chunks(documents: DataFrame, chunks: DataFrame, rows: int | None = None) -> DataFrame:
    """First chunk content of the given documents only."""
    wanted = documents.select("document_id").distinct()
    found = fetch(
        wanted, chunks.select("document_id", "chunk_index", "content"), ["document_id"],
        rows, "left_semi",
    )
    return best_row(
        found.withColumn("_none", F.lit(0)), ["document_id"], "_none", "chunk_index", ["content"]
    )


def candidate_documents(*sets: DataFrame) -> DataFrame:
    """One row per (query, document) of several candidate sets, with the columns of all."""
    merged = sets[0]
    for other in sets[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    # A set has a pair at most once, so the maximum is that set's own value.
    values = [c for c in merged.columns if c not in CHUNK_PAIR]
    return merged.groupBy(*CHUNK_PAIR).agg(*(F.max(c).alias(c) for c in values))


def hybrid_search(
    queries: DataFrame,
    documents: DataFrame,
    chunks: DataFrame,
    chunk_postings: DataFrame,
    doc_postings: DataFrame,
    threshold: float = THRESHOLD,
    vector_candidates: int | str = CANDIDATES,
    text_candidates: int | str = CANDIDATES,
    half: bool = True,
    lexicon: Lexicon = simple_lexicon,
    literals: DataFrame | None = None,
    max_candidates: int | None = None,
    cells: CellIndex | RingIndex | None = None,
    probes: int = 8,
) -> DataFrame:
    """Chunked hybrid search of a query batch.

    `queries(query_id, query, embedding, result_offset, result_limit)`; candidate counts are
    numbers or columns of `queries` (`max_candidates` then states their largest value).
    Returns `(query_id, rank, id, url, title, description, snippet, similarity)`, ranked
    from 1 over the whole result with the requested window kept.  With `cells` the vector
    candidates come from an index of the chunks' vectors instead of a scan.

    The candidate cuts come first: nearest chunks, best-ranked chunks and best-ranked
    documents per query; only their documents are looked up and scored.
    """
    queries, asked_rows = settle(queries)
    bounded = asked_rows is not None
    if literals is None:
        literals, _ = settle(query_literals(queries, lexicon=lexicon))
    near_rows = _times(asked_rows, _largest(vector_candidates, max_candidates))
    text_rows = _times(asked_rows, _largest(text_candidates, max_candidates))

    near_chunks = chunk_candidates(
        queries, chunks, vector_candidates, threshold, half=half, rows=near_rows, cells=cells, probes=probes
    )
    near = best_chunk_per_document(near_chunks).select(
        *CHUNK_PAIR, F.col("chunk_id").alias("vector_chunk"), "similarity"
    )

    owners = chunks.select(F.col("id").alias("unit_id"), "document_id")
    chunk_ranks = match_and_rank(
        chunk_postings, literals, owners.select("unit_id"), bounded=bounded
    )
    text_chunks = _text_candidates(chunk_ranks, queries, text_candidates, bounded, max_candidates)
    owned = fetch(text_chunks, owners, ["unit_id"], text_rows)
    by_chunk = best_chunk_per_document(
        owned.withColumnRenamed("unit_id", "chunk_id"), "text_rank"
    ).select(
        *CHUNK_PAIR, F.col("chunk_id").alias("text_chunk"), F.col("text_rank").alias("chunk_rank")
    )

    doc_ids = documents.select(F.col("id").alias("document_id"))
    doc_ranks = match_and_rank(
        doc_postings, literals, doc_ids.withColumnRenamed("document_id", "unit_id"),
        bounded=bounded,
    )
    by_document = _text_candidates(
        doc_ranks, queries, text_candidates, bounded, max_candidates
    ).select(
        "query_id", F.col("unit_id").alias("document_id"), F.col("text_rank").alias("document_rank")
    )

    scored = candidate_documents(near, by_chunk, by_document).withColumn(
        "score", blend(F.col("similarity"), F.col("chunk_rank"), F.col("document_rank"))
    )
    # Chunks without a document must not take a place in the ranking.
    rows = None if near_rows is None or text_rows is None else near_rows + 2 * text_rows
    known = fetch(scored, doc_ids, ["document_id"], rows)
    # The page is small and read three times below: work it out once.
    page = materialized(result_window(known, queries, bounded))
    return _show(page, documents, chunks, page.count())


def _largest(k: int | str, stated: int | None) -> int | None:
    return stated if isinstance(k, str) else int(k)


def _text_candidates(ranks, queries, k, bounded, largest) -> DataFrame:
    if isinstance(k, str):
        ranks = lookup_join(ranks, queries.select("query_id", k), ["query_id"], bounded=bounded)
    return top_text(ranks, k, bound=largest).drop("rank", *([k] if isinstance(k, str) else []))


def result_window(scored: DataFrame, queries: DataFrame, bounded: bool) -> DataFrame:
    """Rank by score, then id, and keep `result_limit` rows after `result_offset` per query."""
    window = queries.select(
        "query_id",
        F.greatest("result_offset", F.lit(0)).alias("_offset"),
        F.greatest("result_limit", F.lit(1)).alias("_limit"),
    )
    sized = lookup_join(scored, window, ["query_id"], bounded=bounded).withColumn(
        "_last", F.col("_offset") + F.col("_limit")
    )
    order = [F.round("score", 9).desc(), F.col("document_id")]
    # A query has at most its three candidate cuts here, so one window per query is small.
    ranked = top_k(sized, ["query_id"], order, "_last")
    return ranked.filter(F.col("rank") > F.col("_offset")).drop("_offset", "_limit", "_last")


def _show(page: DataFrame, documents: DataFrame, chunks: DataFrame, rows: int | None):
    """Add document columns and the snippet to the rows of a result page."""
    # One scan gives the contents of the best chunks; a vector chunk goes before a text chunk.
    best = F.coalesce("vector_chunk", "text_chunk")
    wanted = page.select(best.alias("id")).filter("id is not null").distinct()
    contents = fetch(wanted, chunks.select("id", "content"), ["id"], rows, "left_semi")
    without = page.filter(F.coalesce("vector_chunk", "text_chunk").isNull())
    first = first_chunks(without, chunks, rows).withColumnRenamed("content", "first_content")
    shown = documents.select(F.col("id").alias("document_id"), "url", "title", "description")
    return (
        fetch(page, shown, ["document_id"], rows)
        .withColumn("best_chunk", best)
        .join(contents.toDF("best_chunk", "best_content"), "best_chunk", "left")
        .join(first, "document_id", "left")
        .select(
            "query_id",
            "rank",
            F.col("document_id").alias("id"),
            "url",
            "title",
            "description",
            snippet(F.col("best_content"), F.col("first_content")).alias("snippet"),
            F.col("score").alias("similarity"),
        )
    )


def to_half_precision(chunks: DataFrame) -> DataFrame:
    """Chunks with every embedding rounded to half precision."""
    return chunks.withColumn("embedding", half_precision(F.col("embedding")))
