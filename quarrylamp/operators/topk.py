"""Top-k and best-row selection that survives one key holding most of the rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def top_k(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int | str,
    rank_column: str = "rank",
    spread_by: list[str] | None = None,
    salts: int = SALTS,
    bound: int | None = None,
) -> DataFrame:
    """First `k` rows per key in `order`, numbered from 1 in `rank_column`.

    `k` is a number or the name of a column holding a per-key limit (values below 1 count
    as 1).  With `spread_by` the rows of a key are cut in `salts` independent pieces first
    and only the survivors meet in the final window; Spark additionally cuts each piece
    before the shuffle when `k` is a literal, or when `bound` states the largest value of
    the column `k`; a row with a larger value raises an error.  Where it does, all that a task has
    of a key is one piece, so that a task sends `k` rows of a key and not `k` for every salt.
    """

    def within(place: Column) -> Column:
        if not isinstance(k, str):
            return place <= max(int(k), 1)
        exact = place <= F.greatest(F.col(k), F.lit(1))
        if bound is None:
            return exact
        over = F.raise_error(F.lit(f"a limit in {k} exceeds the stated bound {bound}"))
        held = F.when(F.col(k) > bound, over.cast("boolean")).otherwise(exact)
        return held & (place <= max(int(bound), 1))

    rows = df
    if spread_by:
        piece = F.xxhash64(*spread_by) if isinstance(k, str) and bound is None else F.spark_partition_id()
        rows = rows.withColumn("_salt", F.pmod(piece, F.lit(salts)).cast("int"))
        local = Window.partitionBy(*keys, "_salt").orderBy(*order)
        rows = (
            rows.withColumn("_local", F.row_number().over(local))
            .filter(within(F.col("_local")))
            .drop("_local", "_salt")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn(rank_column, F.row_number().over(window))
    return ranked.filter(within(F.col(rank_column)))


def leading_groups(df: DataFrame, key: str, group: str, score: str, k: int) -> DataFrame:
    """Rows of what may be, for each `key`, the `k` groups with the highest `score`, smaller group on ties.

    Each task drops what cannot be among them: a group whose best row lies in a task, and that fewer
    than `k` groups surpass, is not surpassed by more there.  The best row of every group among the
    first k is kept; the choice itself follows.  Key and group are whole numbers; rows in which any of the
    three is NULL stay.
    """
    return df.mapInArrow(_lead(key, group, score, k), df.schema)


#: Rows that a task holds back, besides those it keeps, before it drops some.
PENDING = 1 << 18


def _lead(key: str, group: str, score: str, k: int):
    def cut(table: pa.Table) -> pa.Table:
        keys, groups, scores = (table.column(c).to_numpy() for c in (key, group, score))
        # Best row of every group first, then the groups of a key by their best rows.
        order = np.lexsort((-scores, groups, keys))
        first = np.append(True, (keys[order][1:] != keys[order][:-1]) | (groups[order][1:] != groups[order][:-1]))
        best = order[first]
        best = best[np.lexsort((groups[best], -scores[best], keys[best]))]
        place = np.arange(len(best)) - np.searchsorted(keys[best], keys[best])
        kept = np.zeros(len(keys), bool)
        kept[best[place < k]] = True
        # Other rows of a group that stays, with the same score, matter to whoever looks at ties.
        number = np.cumsum(first) - 1
        top = scores[order][first][number]
        alive = kept[order][np.flatnonzero(first)][number]
        return table.take(pa.array(np.sort(order[alive & (scores[order] == top)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, PENDING
        for batch in batches:
            whole = reduce(pc.and_, (pc.is_valid(batch.column(c)) for c in (key, group, score)))
            if pc.any(pc.invert(whole)).as_py():
                yield batch.filter(pc.invert(whole))
                batch = batch.filter(whole)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows > limit:
                left = cut(pa.Table.from_batches(held).combine_chunks())
                held, rows = left.to_batches(), left.num_rows
                limit = PENDING + rows
        if held:
            yield from cut(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def best_row(
    df: DataFrame, keys: list[str], score: str, tie: str, keep: list[str]
) -> DataFrame:
    """One row per key: highest score, then smallest tie-breaker.

    Written as an aggregate so rows are reduced before the shuffle.
    """
    best = F.min_by(
        F.struct(*keep), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))
    ).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, "best.*")


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key, the smallest under `order`; reduced before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    picked = df.groupBy(*keys).agg(F.min_by(row, rank).alias("_row"))
    return picked.select("_row.*")
