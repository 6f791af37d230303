"""Approximate neighbours through inverted cells, and their recall.

Vectors are assigned to the nearest of a fixed number of centres; a query looks only into
the cells of its nearest centres and scores their vectors exactly.  Looking into all cells
is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylamp.functions.vectors import l2_normalize
from quarrylamp.operators.nearest import nearest
from quarrylamp.sources.tables import materialized

@dataclass
class CellIndex:
    """Centres (bounded by the number of cells) and vectors with their `cell`."""

    centers: np.ndarray
    vectors: DataFrame


def _nearest_cells(df: DataFrame, centers: np.ndarray, n: int, output: str) -> DataFrame:
    """Add the `n` nearest centres of each row's embedding, nearest first."""
    position = df.columns.index("embedding")
    schema = T.StructType(df.schema.fields + [T.StructField(output, T.ArrayType(T.IntegerType()))])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(position).flatten().to_numpy(zero_copy_only=False)
            scores = flat.reshape(batch.num_rows, -1).astype(np.float64) @ centers.T
            order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :n]
            cells = pa.array(order.astype(np.int32).tolist(), type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=names)

    return df.mapInArrow(run, schema)


def build_cells(
    vectors: DataFrame, cells: int = 100, seed: int = 42, max_iterations: int = 10
) -> CellIndex:
    """Cluster `vectors(id, embedding, ...)` and assign every vector to a cell.

    Centres are learned from all vectors, at any size.
    """
    unit = vectors.select(array_to_vector(l2_normalize(F.col("embedding"))).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=max_iterations, initMode="random").fit(unit)
    return cells_around(vectors, np.array(model.clusterCenters()))


def cells_around(vectors: DataFrame, centers: np.ndarray) -> CellIndex:
    """Assign every vector to the nearest of given centres, one cell each."""
    lengths = np.maximum(np.sqrt((centers**2).sum(axis=1, keepdims=True)), 1e-12)
    centers = centers / lengths
    assigned = _nearest_cells(vectors, centers, 1, "_cells")
    return CellIndex(
        centers, assigned.withColumn("cell", F.col("_cells")[0]).drop("_cells")
    )


def write_cells(index: CellIndex, path: str) -> CellIndex:
    """Store the vectors in one folder per cell, so a search reads only the cells it probes.

    A cell of any size is spread over several files.
    """
    (
        index.vectors.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
        .write.mode("errorifexists").partitionBy("cell").parquet(path)
    )
    return CellIndex(index.centers, index.vectors.sparkSession.read.parquet(path))


def search_cells(
    index: CellIndex, queries: DataFrame, k: int | str = 10, probes: int = 8,
    exclude_self: bool = False, **layout,
) -> DataFrame:
    """Approximate `(query_id, id, similarity, rank)`, exact within the probed cells."""
    wanted = max(1, min(probes, len(index.centers)))
    asked = _nearest_cells(
        queries.select("query_id", "embedding", *([k] if isinstance(k, str) else [])),
        index.centers, wanted, "cells"
    )
    stored = index.vectors.select("id", "embedding", "cell")
    return nearest(asked, stored, k, exclude_self=exclude_self, by_cell=True, **layout)


def ann_recall(exact: DataFrame, approximate: DataFrame, configs: list[int]) -> DataFrame:
    """`(config, query_id, recall)`: share of the exact neighbours that were found.

    `exact(query_id, id)`, `approximate(config, query_id, id)`.  Every configuration counts
    for every query, also where it found nothing.
    """
    sizes = exact.groupBy("query_id").agg(F.count("*").alias("expected"))
    found = approximate.select("config", "query_id", "id").join(
        exact.select("query_id", "id"), ["query_id", "id"], "left_semi"
    )
    hits = found.groupBy("config", "query_id").agg(F.count("*").alias("hits"))
    wanted = sizes.withColumn("config", F.explode(F.lit(list(configs))))
    share = F.coalesce("hits", F.lit(0)) / F.greatest("expected", F.lit(1))
    return wanted.join(hits, ["config", "query_id"], "left").select(
        "config", "query_id", share.alias("recall")
    )


def recall_report(recalls: DataFrame) -> DataFrame:
    """Mean recall per configuration."""
    return recalls.groupBy("config").agg(F.avg("recall").alias("recall_at_k"))


def recall_benchmark(
    vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 100,
    probes: tuple[int, ...] = (1, 2, 4, 8), seed: int = 42, index: CellIndex | None = None,
) -> DataFrame:
    """Recall of the cell search against the exact search for several probe counts."""
    # Stored, as it is both counted and looked up.
    exact = materialized(nearest(queries, vectors, k, exclude_self=True).select("query_id", "id"))
    index = build_cells(vectors, cells, seed) if index is None else index
    runs = [
        search_cells(index, queries, k, p, exclude_self=True).withColumn("config", F.lit(p))
        for p in probes
    ]
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    return recall_report(ann_recall(exact, merged, list(probes)))
