"""Cosine nearest neighbours of a query batch over a corpus of any size.

Both ways below give the same exact result:

* a query batch that passes a check of its bytes and winners is broadcast; every task scans its share of the
  corpus once and hands on only its best k rows per query, so the corpus never moves;
* a larger batch is laid out against the corpus in a grid of bounded blocks; each grid
  field scores one block of vectors against one block of queries.  Blocks travel packed, a row
  for what a task has of a block, and so do the winners of a field.

Scores are first worked out in single precision, which tells the few rows that can be among the
best; those are scored again in double precision.  Only winners reach the final top-k, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.vectors import SCORE_DIGITS
from quarrylamp.operators.sizing import give_back
from quarrylamp.operators.topk import top_k
from quarrylamp.sources.halves import halved

# A worker holds the batch in double precision and some times its winners, and a machine has as
# many workers as cores: beyond these bounds the grid is used, whose fields are small.
BROADCAST_BYTES = 16 << 20
BLOCK_VALUES = 1 << 22  # components of a block of vectors or queries
SMALL_BLOCK = 8_192  # rows; blocks are no smaller only to have LEAST_PARTS of them
LEAST_PARTS = 8
MOST_PARTITIONS = 2_048
WINNERS = 1 << 19  # rows that one task may hold as winners: queries times k
PENDING = 1 << 18  # rows that wait to be cut to the winners, or twice the winners if these are more
_TILE = 1 << 20  # scores worked out at once
_ROWS = 8_192  # rows of a block that meet a tile's queries at once
_GROUP = 32  # rows of which only the best score is looked at first
_ROUNDED = 2 * 10.0**-SCORE_DIGITS  # more than rounding changes a score

NAN_FIRST = "first"  # an undefined similarity beats every number and is reported as NaN
NAN_LAST = "last"  # an undefined similarity sorts behind every number and is reported as 0

_SCORED = "query_id long, id long, _order double"

_NO_ID = np.iinfo(np.int64).min  # stands for NULL inside a task: first among equals, as in the final order


class _Best:
    """Best rows per query seen so far in one task."""

    def __init__(self, limits: np.ndarray, floor: float | None):
        self.limits = limits
        self.floor = np.full(len(limits), -np.inf)
        self.bound = np.full(len(limits), -np.inf)  # rows below it are not needed, whether or not it was reached here
        self.minimum = floor
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def offer(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, row, score))
        self.pending += len(query)
        if self.pending > max(PENDING, 2 * int(self.limits.sum())):
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            empty = np.array([], dtype=np.int64)
            return empty, empty, np.array([], dtype=np.float64)
        query, row, score = (np.concatenate(column) for column in zip(*self.parts))
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        starts = np.searchsorted(query, np.arange(len(self.limits)))
        place = np.arange(len(query)) - starts[query]
        keep = place < self.limits[query]
        full = place == self.limits[query] - 1
        self.floor[query[full]] = score[full]
        self.parts = [(query[keep], row[keep], score[keep])]
        self.pending = int(keep.sum())
        return self.parts[0]


def _unit(matrix: np.ndarray, half: bool) -> np.ndarray:
    """Rows scaled to length 1; zero rows turn into NaN."""
    values = (halved(matrix) if half else matrix).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", values, values))
    with np.errstate(divide="ignore", invalid="ignore"):
        return values / length[:, None]


def _score_block(best, ids, vectors, queries, query_ids, nan_order, skip_self, members=None):
    """Offer every row of a block that can still enter a query's best list."""
    wanted = np.arange(len(queries)) if members is None else members
    if not len(ids) or not len(wanted):
        return
    dimensions = vectors.shape[1]
    # More than twice what single precision, and rounding, change a score of vectors of length 1.
    slack = 2 * (dimensions + 8) * 2.0**-24 + _ROUNDED
    undefined = np.inf if nan_order == NAN_FIRST else -np.inf
    void = np.isnan(vectors).any(axis=1)
    rows = np.where(void[:, None], 0, vectors).astype(np.float32)
    # A query's own rows may be among the best and do not count.
    own = int(np.unique(ids, return_counts=True)[1].max()) if skip_self else 0
    limit = int(best.limits[wanted].max())
    need = limit + own
    height = min(len(ids), max(_ROWS, 8 * need))
    group = max(1, min(_GROUP, height // (4 * need)))
    groups = -(-height // group)
    width = max(_TILE // height, 1)
    work = np.empty(group * groups * min(width, len(wanted)), np.float32)
    for start in range(0, len(wanted), width):
        part = wanted[start : start + width]
        asked = queries[part]
        lost = np.isnan(asked).any(axis=1)
        columns = np.ascontiguousarray(np.where(lost[:, None], 0, asked).T, dtype=np.float32)
        least = np.maximum(best.floor[part], best.bound[part])
        if best.minimum is not None:
            least = np.maximum(least, best.minimum)
        floor = (least - slack).astype(np.float32)
        scores = work[: group * groups * len(part)].reshape(group * groups, len(part))
        found = []
        for first in range(0, len(ids), height):
            size = min(height, len(ids) - first)
            np.matmul(rows[first : first + size], columns, out=scores[:size])
            scores[:size][void[first : first + size]] = undefined
            scores[:, lost] = undefined
            scores[size:] = -np.inf
            # The best score of every group of rows.  If `need` groups reach a score, no row far below it is
            # among the best, whatever the rest of the block holds.  Most rows go here.
            grouped = scores.reshape(group, groups, len(part))
            tops = grouped.max(axis=0)
            if groups > need:
                reached = np.partition(tops, groups - need, axis=0)[groups - need]
                floor = np.maximum(floor, reached - np.float32(slack))
            of, column = np.divmod(np.flatnonzero(tops >= floor), len(part))
            some = grouped[:, of, column]
            at, which = np.nonzero(some >= floor[column])
            row = at * groups + of[which]
            inside = row < size
            found.append((first + row[inside], column[which][inside], some[at, which][inside]))
        row, column, near = (np.concatenate(values) for values in zip(*found))
        keep = near >= floor[column]
        row, column = row[keep], column[keep]
        best.bound[part] = np.maximum(best.bound[part], floor.astype(np.float64))
        score = np.empty(len(row))
        step = max(_TILE // dimensions, 1)
        for first in range(0, len(row), step):
            pairs = slice(first, first + step)
            score[pairs] = np.einsum("ij,ij->i", vectors[row[pairs]], asked[column[pairs]])
        score = np.round(score, SCORE_DIGITS)
        score[np.isnan(score)] = undefined
        # A tie with the current k-th row still counts: the smaller id may win.
        keep = score >= best.floor[part][column]
        if best.minimum is not None:
            keep &= score > best.minimum
        if skip_self:
            keep &= (ids[row] != query_ids[part[column]]) | (ids[row] == _NO_ID)
        query, row, score = column[keep], ids[row[keep]], score[keep]
        if len(row) > limit * len(part):
            order = np.lexsort((row, -score, query))
            query, row, score = query[order], row[order], score[order]
            first = np.arange(len(query)) - np.searchsorted(query, query) < limit
            query, row, score = query[first], row[first], score[first]
        if len(row):
            best.offer(part[query], row, score)


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(flat) != len(column) * dimensions:
        raise ValueError(f"every embedding must have {dimensions} values")
    return flat.reshape(len(column), dimensions)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy().astype(np.int64, copy=False)


def _winners(query: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(query, mask=query == _NO_ID), pa.array(row, mask=row == _NO_ID), pa.array(score)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "_order"])


def _held(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.Table]:
    """Batches put together to about a block."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows * dimensions >= BLOCK_VALUES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _scan_task(queries: dict, nan_order: str, minimum: float | None, skip_self: bool, half: bool):
    """Task body of the broadcast way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _unit(queries["matrix"], half)
        query_ids, probes = queries["ids"], queries["probes"]
        best = _Best(queries["limits"], minimum)
        for block in _held(batches if len(query_ids) else iter([]), vectors.shape[1]):
            ids = _ids(_column(block, "id"))
            unit = _unit(_matrix(_column(block, "embedding"), vectors.shape[1]), half)
            if probes is None:
                _score_block(best, ids, unit, vectors, query_ids, nan_order, skip_self)
                continue
            cells = _column(block, "cell").to_numpy(zero_copy_only=False)
            for cell, rows in _stretches(cells):
                members = probes.get(int(cell))
                if members is not None:
                    _score_block(
                        best, ids[rows], unit[rows], vectors, query_ids,
                        nan_order, skip_self, members,
                    )
        yield _winners(*_named(query_ids, best))
        give_back()

    return run


def _named(query_ids: np.ndarray, best: _Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    query, row, score = best.compact()
    return query_ids[query], row, score


def _stretches(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places of it) for every different value."""
    order = np.argsort(values, kind="stable")
    listed, starts = np.unique(values[order], return_index=True)
    for value, places in zip(listed.tolist(), np.split(order, starts[1:])):
        yield value, places


def _collect_queries(queries: DataFrame, probed: bool, max_bytes: int) -> dict | None:
    """The query batch as arrays, or None when it is larger than `max_bytes`."""
    head = queries.select(F.size("embedding").alias("d")).first()
    if head is None:
        return {"ids": np.array([], dtype=np.int64), "matrix": np.zeros((0, 1)),
                "limits": np.array([], dtype=np.int64), "probes": {} if probed else None}
    rows_allowed = max(max_bytes // (4 * max(head["d"], 1) + 64), 1)
    rows = queries.limit(rows_allowed + 1).toArrow()
    if rows.num_rows > rows_allowed:
        return None
    limits = np.maximum(rows.column("k").to_numpy().astype(np.int64), 1)
    if limits.sum() > WINNERS:
        return None
    probes = None
    if probed:
        probes = {}
        for position, cells in enumerate(rows.column("cells").to_pylist()):
            for cell in cells:
                probes.setdefault(int(cell), []).append(position)
        probes = {cell: np.array(members) for cell, members in probes.items()}
    matrix = _matrix(rows.column("embedding").combine_chunks(), head["d"])
    return {
        "ids": _ids(_column(rows, "query_id")),
        "matrix": np.ascontiguousarray(matrix, dtype=np.float32),
        "limits": limits,
        "probes": probes,
    }


# What a task has of a block, as bytes: ids, cells (of the vectors, or those that the queries of
# `rows` ask for), components and, for queries, limits.
_PACKED = "block int, part int, ids binary, matrix binary, cells binary, rows binary, limits binary"
_PACKED_WINNERS = "part int, query_ids binary, ids binary, scores binary, limits binary"


def _dealt(ids: np.ndarray, over: np.ndarray | int) -> np.ndarray:
    """Number below `over` that depends on an id only."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.asarray(over, np.uint64)).astype(np.int64)


def _blocks(rows: dict[int, int], size: int) -> dict[str, np.ndarray]:
    """Cells dealt over blocks of about `size` rows: small cells share one, a hot cell has several."""
    cells, first, pieces, held, count = sorted(rows), [], [], 0, 0
    for cell in cells:
        if rows[cell] > size or held + rows[cell] > size:
            count, held = count + (held > 0), 0
        first.append(count)
        pieces.append(max(-(-rows[cell] // size), 1))
        if pieces[-1] > 1:
            count += pieces[-1]
        else:
            held += rows[cell]
    return {"cells": np.array(cells, np.int64), "first": np.array(first), "pieces": np.array(pieces), "count": count + (held > 0)}


def _bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _pack_vectors(layout: dict, dimensions: int):
    """Task body over (id, embedding, cell)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, dimensions):
            ids, matrix = _ids(_column(table, "id")), _matrix(_column(table, "embedding"), dimensions)
            cell = _column(table, "cell")
            known = cell.is_valid().to_numpy(zero_copy_only=False)
            cell = cell.fill_null(0).to_numpy()
            place = np.searchsorted(layout["cells"], cell[known])
            block = np.full(len(ids), -1)
            block[known] = layout["first"][place] + _dealt(ids[known], layout["pieces"][place])
            for number, rows in _stretches(block):
                if number >= 0:
                    yield pa.RecordBatch.from_pylist([{
                        "block": number, "part": 0, "ids": _bytes(ids[rows]), "matrix": _bytes(matrix[rows]),
                        "cells": _bytes(cell[rows].astype(np.int64)), "rows": b"", "limits": b"",
                    }], _PACKED_ARROW)
        give_back()

    return run


def _pack_queries(layout: dict, dimensions: int, parts: int):
    """Task body over (query_id, embedding, k, cells): what blocks and parts need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _held(batches, dimensions):
            ids, matrix = _ids(_column(table, "query_id")), _matrix(_column(table, "embedding"), dimensions)
            limits, part = _column(table, "k").fill_null(1).to_numpy(), _dealt(ids, parts)
            listed = _column(table, "cells")
            sizes = listed.value_lengths().fill_null(0).to_numpy()
            cell = listed.flatten().cast(pa.int64()).fill_null(_NO_ID).to_numpy()
            owner = np.repeat(np.arange(len(ids)), sizes)
            place = np.minimum(np.searchsorted(layout["cells"], cell), len(layout["cells"]) - 1)
            there = layout["cells"][place] == cell
            owner, place = owner[there], place[there]
            # A cell in several blocks is asked for in each.
            pieces = layout["pieces"][place]
            owner, place = np.repeat(owner, pieces), np.repeat(place, pieces)
            block = layout["first"][place] + np.arange(len(place)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            for number, pairs in _stretches(block * parts + part[owner]):
                rows, local = np.unique(owner[pairs], return_inverse=True)
                yield pa.RecordBatch.from_pylist([{
                    "block": number // parts, "part": number % parts, "ids": _bytes(ids[rows]),
                    "matrix": _bytes(matrix[rows]), "cells": _bytes(layout["cells"][place[pairs]]),
                    "rows": _bytes(local.astype(np.int64)), "limits": _bytes(limits[rows].astype(np.int64)),
                }], _PACKED_ARROW)
        give_back()

    return run


_PACKED_ARROW = pa.schema(
    [("block", pa.int32()), ("part", pa.int32())]
    + [(name, pa.binary()) for name in ("ids", "matrix", "cells", "rows", "limits")]
)


def _joined(table: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _grid_task(nan_order: str, minimum: float | None, skip_self: bool, half: bool, dimensions: int, merges: int):
    """Task body of the grid way: one block of vectors against one part of the queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32())] + [(n, pa.binary()) for n in ("query_ids", "ids", "scores", "limits")])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        part = right.column("part")[0].as_py()
        # The rows of a pack are counted in it.
        sizes = np.array([len(ids) // 8 for ids in right.column("ids").to_pylist()])
        pairs = np.array([len(rows) // 8 for rows in right.column("rows").to_pylist()])
        asking = _joined(right, "rows") + np.repeat(np.cumsum(sizes) - sizes, pairs)
        asked = _joined(right, "cells")
        query_ids = _joined(right, "ids")
        best = _Best(np.maximum(_joined(right, "limits"), 1), minimum)
        queries = _unit(_joined(right, "matrix", np.float32).reshape(-1, dimensions), half)
        ids, cells = _joined(left, "ids"), _joined(left, "cells")
        vectors = _unit(_joined(left, "matrix", np.float32).reshape(-1, dimensions), half)
        members = {cell: asking[places] for cell, places in _stretches(asked)}
        for cell, rows in _stretches(cells):
            if cell in members:
                _score_block(best, ids[rows], vectors[rows], queries, query_ids, nan_order, skip_self, members[cell])
        query, row, score = best.compact()
        limits = best.limits[query]
        named = query_ids[query]
        rows = [
            {"part": part * merges + merge, "query_ids": _bytes(named[places]), "ids": _bytes(row[places]),
             "scores": _bytes(score[places]), "limits": _bytes(limits[places])}
            for merge, places in _stretches(_dealt(named, merges * 7919) // 7919)
        ]
        give_back()
        return pa.Table.from_pylist(rows, schema)

    return run


def _merge_task(table: pa.Table) -> pa.Table:
    """Winners of some queries in all blocks, cut to the best."""
    query, row, limits = (_joined(table, name) for name in ("query_ids", "ids", "limits"))
    score = _joined(table, "scores", np.float64)
    order = np.lexsort((row, -score, query))
    query, row, score, limits = query[order], row[order], score[order], limits[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(query)))
    most = np.repeat(np.maximum.reduceat(limits, starts), sizes) if len(query) else limits
    keep = np.arange(len(query)) - np.repeat(starts, sizes) < most
    found = pa.Table.from_batches([_winners(query[keep], row[keep], score[keep])])
    give_back()
    return found


def _parts(rows: int, block: int | None, dimensions: int) -> int:
    """Into how many blocks rows are dealt: by their components, or of a stated size."""
    if block is not None:
        return max(-(-rows // block), 1)
    return max(-(-rows * dimensions // BLOCK_VALUES), min(-(-rows // SMALL_BLOCK), LEAST_PARTS), 1)


def _grid_scores(queries, vectors, by_cell, asking, vector_block, query_block) -> tuple[DataFrame, int]:
    """Fragment-and-replicate layout; fields are bounded whatever the cell sizes are.

    A field's queries are bounded by number and by the winners they may keep.  Also the largest k.
    """
    dimensions = max(queries.select(F.size("embedding").alias("d")).first()["d"], 1)
    limit = F.greatest("k", F.lit(1))
    asked, winners, largest = queries.agg(F.count("*"), F.sum(limit), F.max(limit)).first()
    if not by_cell:
        vectors = vectors.withColumn("cell", F.lit(0))
        queries = queries.withColumn("cells", F.array(F.lit(0)))
    # Cells are as many as the centres (or rings), which the driver holds.
    rows = {
        r["cell"]: r["n"]
        for r in vectors.groupBy("cell").agg(F.count("*").alias("n")).collect() if r["cell"] is not None
    }
    stored = sum(rows.values())
    layout = _blocks(rows or {0: 0}, max(-(-stored // _parts(stored, vector_block, dimensions)), 1))
    blocks = max(layout["count"], 1)
    parts = max(_parts(asked, query_block, dimensions), -(-winners // WINNERS))
    merges = -(-blocks // 2)
    left = (
        vectors.select("id", "embedding", F.col("cell").cast("long").alias("cell"))
        .mapInArrow(_pack_vectors(layout, dimensions), _PACKED)
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    right = queries.select("query_id", "embedding", "k", "cells").mapInArrow(
        _pack_queries(layout, dimensions, parts), _PACKED
    )
    keys = ["block", "part"]
    tasks = min(blocks * parts, MOST_PARTITIONS)
    left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    fields = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _grid_task(*asking, dimensions, merges), _PACKED_WINNERS
    )
    merged = fields.repartition(min(parts * merges, MOST_PARTITIONS), "part").groupBy("part")
    return merged.applyInArrow(_merge_task, _SCORED), largest


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int | str,
    min_similarity: float | None = None,
    nan_order: str = NAN_LAST,
    exclude_self: bool = False,
    half: bool = False,
    by_cell: bool = False,
    max_broadcast_bytes: int = BROADCAST_BYTES,
    vector_block: int | None = None,
    query_block: int | None = None,
) -> DataFrame:
    """`(query_id, id, similarity, rank)` of the k most similar vectors per query.

    `queries(query_id, embedding[, cells])`, `vectors(id, embedding[, cell])`, ids integral;
    `k` is a number or a column of `queries`.  `min_similarity` keeps only strictly greater
    scores and is applied while scanning.  With `by_cell` a query meets only the vectors of
    its `cells`.  Ties go to the smaller id.  Blocks have a size of their own unless one is stated.
    """
    limit = F.col(k) if isinstance(k, str) else F.lit(k)
    asked = queries.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        limit.cast("long").alias("k"),
        *([F.col("cells")] if by_cell else []),
    )
    stored = vectors.select(
        F.col("id").cast("long").alias("id"),
        F.col("embedding").cast("array<float>").alias("embedding"),
        *(["cell"] if by_cell else []),
    )
    batch = _collect_queries(asked, by_cell, max_broadcast_bytes)
    if batch is not None:
        if by_cell:
            cells = sorted(batch["probes"])
            stored = stored.filter(F.col("cell").isin(cells)) if cells else stored.limit(0)
        task = _scan_task(batch, nan_order, min_similarity, exclude_self, half)
        scored = stored.mapInArrow(task, _SCORED)
        largest = int(batch["limits"].max(initial=1))
    else:
        asking = (nan_order, min_similarity, exclude_self, half)
        scored, largest = _grid_scores(asked, stored, by_cell, asking, vector_block, query_block)
    if isinstance(k, str):
        scored = scored.join(
            F.broadcast(asked.select("query_id", "k")) if batch is not None
            else asked.select("query_id", "k"),
            "query_id",
        )
    order = [F.col("_order").desc(), F.col("id")]
    cut = "k" if isinstance(k, str) else int(k)
    ranked = top_k(scored, ["query_id"], order, cut, spread_by=["id"], bound=largest)
    undefined = F.lit(float("nan")) if nan_order == NAN_FIRST else F.lit(0.0)
    value = F.when(F.abs("_order") == float("inf"), undefined).otherwise(F.col("_order"))
    return ranked.select("query_id", "id", value.alias("similarity"), "rank")
