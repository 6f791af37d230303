"""Cell search that goes on until no unread cell can hold a better row.

Cells are split into rings by the angle between a vector and its centre.  Angles obey the triangle
inequality, so the angles of query to centre and of ring to centre bound every similarity inside
the ring.  A query reads its most promising rings first, enough for k rows; of the others it reads
only those whose bound reaches the k-th similarity found.  The result is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylamp.operators.ann import CellIndex
from quarrylamp.operators.nearest import NAN_LAST, nearest
from quarrylamp.operators.topk import top_k
from quarrylamp.sources.tables import materialized

#: Rings of a cell; one more holds vectors of length zero, which have no angle.
RINGS = 16

#: What rounding may add to a similarity, for whole and for half precision.
SLACK, HALF_SLACK = 1e-8, 2e-3


#: Stands for a k-th similarity where there is none.
EVERYTHING = -3.0


@dataclass
class RingIndex:
    """Vectors with their `cell` (here a ring), and for every ring its cell, angles and rows."""

    centers: np.ndarray
    vectors: DataFrame
    rings: np.ndarray  # the number that stands in `cell`
    owners: np.ndarray  # the centre of each ring
    low: np.ndarray
    high: np.ndarray  # angles to the centre; NaN for vectors of length zero
    rows: np.ndarray


def _angles(flat: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angle of each row to each centre; NaN for rows of length zero."""
    values = flat.reshape(-1, centers.shape[1]).astype(np.float64)
    length = np.linalg.norm(values, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.arccos(np.clip(values / length @ centers.T, -1, 1))


def ring_index(index: CellIndex) -> RingIndex:
    """Split the cells of an index into rings.

    Every vector is in one ring.  At most cells times RINGS + 1 rings are described on the driver.
    """
    centers, names = index.centers, ["id", "embedding", "cell", "angle"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = batch.column("cell").to_numpy()
            angle = _angles(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), centers)
            angle = angle[np.arange(len(owner)), owner]
            ring = np.where(np.isnan(angle), RINGS, np.minimum(np.nan_to_num(angle) / np.pi * RINGS, RINGS - 1))
            cell = owner * (RINGS + 1) + ring.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(angle)], names
            )

    kept = index.vectors.select("id", "embedding", "cell")
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    laid = materialized(kept.mapInArrow(measured, schema))
    found = laid.groupBy("cell").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("rows")
    ).orderBy("cell").collect()
    ring, low, high, rows = (
        np.array([r[c] for r in found], kind)
        for c, kind in (("cell", np.int64), ("low", float), ("high", float), ("rows", np.int64))
    )
    return RingIndex(centers, laid.drop("angle"), ring, ring // (RINGS + 1), low, high, rows)


def _asked(index: RingIndex, least: int, slack: float):
    """Task body over (query_id, embedding, k, kth): adds the rings to read as `cells`.

    Without a k-th similarity (null) they are the leading ones that hold `k` rows and `least`
    more; with one they are the others whose bound reaches it.
    """

    centers, rings, owners, low, high, rows = (
        index.centers, index.rings, index.owners, index.low, index.high, index.rows
    )
    nowhere = np.isnan(low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            angle = _angles(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), centers)
            angle = angle[:, owners]
            nearest_angle = np.clip(np.maximum(angle - high, low - angle), 0, np.pi)
            bound = np.cos(np.where(np.isnan(angle), 0, nearest_angle))
            bound[:, nowhere] = -2.0  # an undefined similarity comes after all others
            cells = []
            for row, wanted, kth in zip(bound, batch.column("k").to_pylist(), batch.column("kth").to_pylist()):
                order = np.argsort(-row, kind="stable")
                before = np.cumsum(rows[order]) - rows[order]
                leading = before < max(wanted, 1) + least
                if kth is None:
                    chosen = order[leading]
                else:
                    rest = order[~leading]
                    # Too few rows for a k-th one: undefined similarities may be needed too, and all
                    # rings are ranked together, unless the leading ones were all.
                    chosen = rest[row[rest] >= kth - slack] if kth > EVERYTHING else order if len(rest) else rest
                cells.append(rings[chosen].tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return run


def search_rings(
    index: RingIndex,
    queries: DataFrame,
    k: int | str = 10,
    min_similarity: float | None = None,
    exclude_self: bool = False,
    half: bool = False,
    counted: bool = False,
    **layout,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """`(query_id, id, similarity, rank)` of the k most similar vectors, as an exact search gives.

    With `counted` also `(query_id, rings)`: how many rings each query has read.  A ring that
    cannot exceed `min_similarity` is not read beyond the leading ones.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = queries.select("query_id", "embedding", limit.cast("long").alias("k"))
    body = _asked(index, int(exclude_self), HALF_SLACK if half else SLACK)
    schema = T.StructType([*asked.schema.fields, T.StructField("kth", T.DoubleType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def read(some: DataFrame) -> DataFrame:
        return nearest(some, index.vectors, "k", min_similarity, NAN_LAST, exclude_self, half, by_cell=True, **layout)

    leading = materialized(asked.withColumn("kth", F.lit(None).cast("double")).mapInArrow(body, schema))
    first = materialized(read(leading).select("query_id", "id", "similarity", "rank"))
    floor = EVERYTHING if min_similarity is None else float(min_similarity)
    reached = first.join(asked.select("query_id", "k"), "query_id").filter(F.col("rank") == F.greatest("k", F.lit(1)))
    kth = reached.select("query_id", F.col("similarity").alias("kth"))
    others = materialized(
        asked.join(kth, "query_id", "left")
        .withColumn("kth", F.greatest(F.coalesce("kth", F.lit(floor)), F.lit(floor)))
        .mapInArrow(body, schema).filter(F.size("cells") > 0)
    )
    # Queries that read no more keep what they have; those that read all rings anew forget it.
    settled = first.join(others.select("query_id"), "query_id", "left_anti")
    again = read(others.filter(F.col("kth") == EVERYTHING)).select(first.columns)
    more = others.filter(F.col("kth") != EVERYTHING)
    both = first.join(more.select("query_id", "k"), "query_id").drop("rank").unionByName(
        read(more).select("query_id", "id", "similarity").join(more.select("query_id", "k"), "query_id")
    )
    best = top_k(both, ["query_id"], [F.col("similarity").desc(), F.col("id")], "k").select(first.columns)
    best = settled.unionByName(again).unionByName(best)
    if not counted:
        return best
    used = leading.unionByName(others).groupBy("query_id").agg(F.sum(F.size("cells")).alias("rings"))
    return best, used
