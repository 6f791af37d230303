"""Vector search over documents or chunks, exact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.operators.ann import CellIndex, search_cells
from quarrylamp.operators.rings import RingIndex, search_rings
from quarrylamp.operators.nearest import NAN_FIRST, NAN_LAST, nearest
from quarrylamp.operators.sizing import fetch
from quarrylamp.operators.topk import best_row


def vector_search(
    queries: DataFrame,
    vectors: DataFrame,
    threshold: float,
    k: int | str,
    nan_as_zero: bool = False,
) -> DataFrame:
    """The k best rows per query among those strictly above `threshold`.

    By default an undefined similarity (zero vector) counts as above every threshold and
    comes first, as the database comparison has it; `nan_as_zero` treats it as 0 instead.
    """
    if nan_as_zero:
        return above_threshold(nearest(queries, vectors, k, _pushable(threshold)), threshold)
    return nearest(queries, vectors, k, threshold, nan_order=NAN_FIRST)


def _pushable(threshold: float | None) -> float | None:
    """Threshold usable during the scan of a cut-then-filter search.

    Scores above a non-negative threshold are a prefix of the ranking, so filtering first
    gives the same rows.  Below zero, undefined scores (reported as 0, ranked last) break
    that and the filter has to wait for the cut.
    """
    return threshold if threshold is not None and threshold >= 0 else None


def above_threshold(hits: DataFrame, threshold: float) -> DataFrame:
    """Strict similarity threshold."""
    return hits.filter(F.col("similarity") > threshold)


def chunk_candidates(
    queries: DataFrame,
    chunks: DataFrame,
    k: int | str = 200,
    threshold: float | None = None,
    half: bool = False,
    rows: int | None = None,
    cells: CellIndex | RingIndex | None = None,
    probes: int = 8,
) -> DataFrame:
    """`(query_id, chunk_id, document_id, similarity)` of the k nearest chunks per query.

    The cut to k comes before the threshold and before any per-document choice.  `rows`
    states an upper bound of the result size, if one is known.  With `cells` (an index of the
    chunks' vectors) only the `probes` nearest cells of a query are searched; an index of rings
    is searched until no unread ring can hold a better row.
    """
    if cells is None:
        hits = nearest(
            queries, chunks.select("id", "embedding"), k, _pushable(threshold), NAN_LAST, half=half
        )
    elif isinstance(cells, RingIndex):
        hits = search_rings(cells, queries, k, min_similarity=_pushable(threshold), half=half)
    else:
        hits = search_cells(
            cells, queries, k, probes, min_similarity=_pushable(threshold), nan_order=NAN_LAST, half=half
        )
    if threshold is not None:
        hits = above_threshold(hits, threshold)
    owners = chunks.select(F.col("id").alias("chunk_id"), "document_id")
    found = fetch(hits.withColumnRenamed("id", "chunk_id"), owners, ["chunk_id"], rows)
    return found.select("query_id", "chunk_id", "document_id", "similarity")


def best_chunk_per_document(candidates: DataFrame, score: str = "similarity") -> DataFrame:
    """The best-scoring candidate chunk of each (query, document), smaller id on ties."""
    return best_row(candidates, ["query_id", "document_id"], score, "chunk_id", ["chunk_id", score])


def knn(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    exclude_self: bool = True,
    **layout,
) -> DataFrame:
    """Exact nearest neighbours, by default other than the query's own row."""
    return nearest(queries, vectors, k, exclude_self=exclude_self, **layout)
