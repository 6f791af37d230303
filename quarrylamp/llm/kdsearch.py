"""Exact top-k search by inner product with a KD-tree per shard.

Candidates are dealt into shards; a task builds its shard's tree by median splits, with a tight
bounding box per leaf.  The largest inner product that a box can hold is
sum(max(q * low, q * high)), so a query visits leaves best bound first and stops when the next
bound is below its k-th score.  Each query is first searched in one shard; the k-th score found
there goes with it to the others, which mostly stop early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import stored


class Tree:
    """Leaves of a KD-tree over whole-number vectors, each with a tight box."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 256):
        order = np.lexsort((ids,))
        parts, leaves = [order], []
        while parts:
            part = parts.pop()
            if len(part) <= leaf:
                leaves.append(np.sort(part))
                continue
            own = vectors[part]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            middle = len(part) // 2
            halves = np.argpartition(own[:, axis], middle)
            parts += [part[halves[:middle]], part[halves[middle:]]]
        self.leaves = [(ids[part], vectors[part]) for part in leaves]
        self.low = np.array([v.min(axis=0) for _, v in self.leaves])
        self.high = np.array([v.max(axis=0) for _, v in self.leaves])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product each query could have in each leaf."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        """Best k (id, score) of every query, ties to smaller ids, leaving out its own id.

        `floor` holds scores that k candidates elsewhere reach already; lower ones are skipped.
        Queries advance together: in each round all those that still have a promising leaf
        visit their next best one, grouped by leaf.
        """
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        floor = floor.copy()
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        best = np.full((len(queries), k), -np.inf)
        active = np.arange(len(queries))
        for step in range(len(self.leaves)):
            leaf = order[active, step]
            go = bounds[active, leaf] >= floor[active]
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                asked = active[group]
                ids, vectors = self.leaves[leaf[group[0]]]
                score = queries[asked] @ vectors.T
                score[ids[None, :] == own[asked, None]] = -np.inf
                all_scores = np.hstack([best[asked], score])
                all_ids = np.hstack([best_ids[asked], np.broadcast_to(ids, score.shape)])
                top = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
                best[asked] = np.take_along_axis(all_scores, top, 1)
                best_ids[asked] = np.take_along_axis(all_ids, top, 1)
                floor[asked] = np.maximum(floor[asked], best[asked, k - 1])
        return best_ids, best


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) as double for every component x.

    Rows whose vector is null or empty, or holds a null or non-finite component, are left out.
    """
    bad = F.exists(
        "embedding",
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    )
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v")
    )


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int, leaf: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by shard, a shard's candidates before its queries.
        shard, tree, ids, vectors = None, None, [], []
        for batch in batches:
            shards, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy()
            cuts = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)]) if len(shards) else ():
                if shards[s] != shard:
                    shard, tree, ids, vectors = shards[s], None, [], []
                part = batch.slice(s, e - s)
                if not asks[s]:
                    ids.append(part.column("vec_id").to_numpy())
                    vectors.append(_matrix(part.column("v")))
                    continue
                if tree is None:
                    if not ids:
                        continue
                    tree = Tree(np.concatenate(ids), np.concatenate(vectors), leaf)
                    ids, vectors = [], []
                for first in range(0, part.num_rows, block):
                    some = part.slice(first, block)
                    own = some.column("vec_id").to_numpy()
                    found, score = tree.search(own, _matrix(some.column("v")), some.column("floor").to_numpy(), k)
                    real = np.isfinite(score)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(own, k)[real.ravel()]),
                            pa.array(found[real]),
                            pa.array(score[real]),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    return run


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5,
    shard_rows: int = 1 << 17, least_shards: int = 8, leaf: int = 256, block: int = 1024,
) -> DataFrame:
    """The k candidates (vec_id, v) with the highest inner products of every query (vec_id, v).

    A query's own vec_id is no candidate.  Returns (query_id, rank from 1, vec_id, score);
    ties go to smaller vec_ids.  Vectors of different lengths do not meet: shards hold one
    length each.  Fewer than k candidates: all of them.  A repeated candidate row counts as
    often as it stands there; a repeated query is asked once.  Scores are exact while they stay
    under 2 ** 53.
    """
    held = stored(candidates.filter("vec_id is not null").withColumn("size", F.size("v")))
    sizes = held.groupBy("size").agg(F.count("*").alias("n")).collect()
    per_size = {r["size"]: max(least_shards, -(-r["n"] // shard_rows)) for r in sizes}
    if not per_size:
        per_size = {0: 1}
    # Shards are numbered through the lengths: one row per length met, mostly a single one.
    first, starts = 0, {}
    for size, n in sorted(per_size.items()):
        starts[size] = first
        first += n
    def chosen(values: dict[int, int]):
        found = F.lit(0)
        for size, value in values.items():
            found = F.when(F.col("size") == size, value).otherwise(found)
        return found

    count, start = chosen(per_size), chosen(starts)
    home = (start + F.pmod(F.xxhash64("vec_id"), count)).cast("int")
    shards = held.select(home.alias("shard"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(0.0).alias("floor"))
    asked = queries.filter("vec_id is not null").dropDuplicates(["vec_id"]).withColumn("size", F.size("v"))
    asked = asked.filter(F.col("size").isin(list(per_size))).withColumn("home", home)
    schema = "query_id long, vec_id long, score double"

    def visit(askers: DataFrame) -> DataFrame:
        rows = shards.unionByName(askers.select("shard", F.lit(1).alias("asks"), "vec_id", "v", "floor"))
        dealt = rows.repartition(first, "shard").sortWithinPartitions("shard", "asks")
        return dealt.mapInArrow(_search(k, leaf, block), schema)

    at_home = visit(asked.select(F.col("home").alias("shard"), "vec_id", "v", F.lit(float("-inf")).alias("floor")))
    if first == 1:
        found = at_home
    else:
        at_home = stored(at_home)
        # A floor holds only where k candidates reach it.
        floors = at_home.groupBy("query_id").agg(
            F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor")
        ).withColumnRenamed("query_id", "vec_id")
        others = asked.join(floors, "vec_id", "left").withColumn(
            "shard", F.explode(F.sequence(start, start + count - 1))
        ).filter("shard != home").select("shard", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = at_home.unionByName(visit(others))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
    )
