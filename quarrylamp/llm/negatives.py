"""Hard-negative mining over an R-tree packed sort-tile-recursive.

All rows are dealt into tiles: slabs along the label, cut again along the coordinates that vary
most, at places learnt from a bounded sample.  A tile of many rows is shared by several parts, so
equal vectors make no large part.  Each part is one R-tree, packed in the same order and stored as
a row; label and coordinates bound its boxes.  From a box follow the least and the largest inner
product that a query can have in it.  An anchor visits boxes best first and skips those outside
its score windows, those that hold no wanted label, and those strictly below the k-th score found.
It goes to its own tile first; the k-th score from there decides which others it is sent to.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, stored

#: Rows that the cuts between tiles are learnt from, tiles at most, rows of a part.
SAMPLE, MOST_TILES, PART_ROWS = 1 << 14, 1 << 12, 1 << 14

#: Anchors that one copy of a part answers; more anchors make more copies.
ASKERS = 1 << 17


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v): floor(scale * x), as double, for every component x.

    Rows with null vec_id, label or vector, or with a null or non-finite component, are left out.
    A vector shorter than the longest counts as having zeros at its end.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad
    )
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    padded = F.concat(whole, F.array_repeat(F.lit(0.0), F.lit(width) - F.size("embedding")))
    return rows.select("vec_id", F.col("label").cast("long").alias("label"), padded.alias("v"))


def tiled(keys: list[np.ndarray], rows: np.ndarray, leaf: int) -> np.ndarray:
    """Rows in sort-tile-recursive order: slabs along the first key, each tiled along the others."""
    order = rows[np.argsort(keys[0][rows], kind="stable")]
    leaves = -(-len(rows) // leaf)
    if len(keys) == 1 or leaves <= 1:
        return order
    slabs = math.ceil(leaves ** (1 / len(keys)))
    size = leaf * -(-leaves // slabs)
    return np.concatenate([tiled(keys[1:], order[k : k + size], leaf) for k in range(0, len(order), size)])


class Tiling:
    """Cuts between tiles: along the first axis, then within each slab along the others."""

    def __init__(self, sample: np.ndarray, axes: list[int], tiles: int, first: int = 0):
        self.first, self.children, self.count = first, [], 1
        if not axes or tiles <= 1 or not len(sample):
            return
        self.axis = axes[0]
        slabs = math.ceil(tiles ** (1 / len(axes)))
        column = sample[:, self.axis]
        ranks = np.arange(1, slabs) * len(column) // slabs
        self.cuts = np.unique(np.sort(column)[ranks])
        slab = np.searchsorted(self.cuts, column, side="right")
        for k in range(len(self.cuts) + 1):
            part = sample[slab == k]
            share = max(1, tiles * len(part) // len(sample))
            self.children.append(Tiling(part, axes[1:], share, first))
            first += self.children[-1].count
        self.count = first - self.first

    def tiles(self, rows: np.ndarray) -> np.ndarray:
        """The tile of every row."""
        out = np.full(len(rows), self.first, np.int32)
        if self.children:
            slab = np.searchsorted(self.cuts, rows[:, self.axis], side="right")
            for k, child in enumerate(self.children):
                own = slab == k
                if own.any():
                    out[own] = child.tiles(rows[own])
        return out


def products(low: np.ndarray, high: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product that a query can have in each box."""
    up, down = np.maximum(query, 0), np.minimum(query, 0)
    return low @ up + high @ down, high @ up + low @ down


def _labelled(low: np.ndarray, high: np.ndarray, label: float, same: bool) -> np.ndarray:
    """Whether boxes with these label bounds may hold rows of the label, or of another."""
    return (low <= label) & (label <= high) if same else (low != label) | (high != label)


class RTree:
    """Rows in packed order; levels of boxes from the leaves up, label first; least id per box."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = 128, fan: int = 16):
        wide = np.argsort(-(vectors.max(axis=0) - vectors.min(axis=0)), kind="stable")[:3] if vectors.shape[1] else []
        order = tiled([labels, *(vectors[:, a] for a in wide)], np.argsort(ids, kind="stable"), leaf)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.leaf, self.fan, self.levels, self.visited = leaf, fan, [], 0
        low = high = np.column_stack([self.labels.astype(float), self.vectors])
        least, step = self.ids, leaf
        while not self.levels or len(low) > 1:
            starts = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            least, step = np.minimum.reduceat(least, starts), fan
            self.levels.append((low, high, least))

    def packed(self) -> bytes:
        small = np.int16 if np.abs(self.vectors).max(initial=0) < 1 << 15 else np.float64
        return pickle.dumps((self.ids, self.labels, self.vectors.astype(small), self.levels, self.leaf, self.fan))

    @staticmethod
    def unpacked(data: bytes) -> RTree:
        tree = RTree.__new__(RTree)
        tree.ids, tree.labels, vectors, tree.levels, tree.leaf, tree.fan = pickle.loads(data)
        tree.vectors, tree.visited = vectors.astype(np.float64), 0
        return tree

    def search(
        self, query: np.ndarray, own: int, label: int, same: bool,
        lows: np.ndarray, highs: np.ndarray, floors: np.ndarray, k: int,
    ) -> list[tuple[np.ndarray, np.ndarray]]:
        """The first k rows (scores, ids) of each window lows <= score <= highs, best first.

        Rows of the query's own id are left out; rows below a window's floor may be.
        """
        floors = np.maximum(floors, lows)
        edge = np.full(len(lows), np.iinfo(np.int64).max)  # id of the k-th row, once there are k
        best = [(np.empty(0), np.empty(0, np.int64)) for _ in lows]

        def offered(level: int, first: int, last: int) -> None:
            low, high, least = (part[first:last] for part in self.levels[level])
            fewest, most = products(low[:, 1:], high[:, 1:], query)
            fits = _labelled(low[:, 0], high[:, 0], label, same)
            fits &= ((most[:, None] >= floors) & (fewest[:, None] <= highs)).any(axis=1)
            for at in np.flatnonzero(fits).tolist():
                heapq.heappush(queue, (-most[at], level, first + at, fewest[at], least[at]))

        queue: list[tuple] = []
        offered(len(self.levels) - 1, 0, 1)
        while queue:
            most, level, node, fewest, least = heapq.heappop(queue)
            most = -most
            # At the k-th score itself only smaller ids can still come in.
            wanted = (fewest <= highs) & ((most > floors) | ((most == floors) & (least < edge)))
            if not wanted.any():
                continue
            if level:
                offered(level - 1, node * self.fan, (node + 1) * self.fan)
                continue
            self.visited += 1
            rows = slice(node * self.leaf, (node + 1) * self.leaf)
            scores, ids = self.vectors[rows] @ query, self.ids[rows]
            fits = (self.labels[rows] == label) == same
            fits &= ids != own
            for w in np.flatnonzero(wanted).tolist():
                inside = np.flatnonzero(fits & (scores >= floors[w]) & (scores <= highs[w]))
                if not len(inside):
                    continue
                new = np.concatenate([best[w][0], scores[inside]]), np.concatenate([best[w][1], ids[inside]])
                top = np.lexsort((new[1], -new[0]))[:k]
                best[w] = new[0][top], new[1][top]
                if len(top) == k and best[w][0][-1] >= floors[w]:
                    floors[w], edge[w] = best[w][0][-1], best[w][1][-1]
        return best


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(tiling: Tiling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.column_stack([batch.column("label").to_numpy(), _matrix(batch.column("v"))])
                yield batch.append_column("tile", pa.array(tiling.tiles(keys)))

    return run


def _built(leaf: int, fan: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tree = RTree(rows.vec_id.to_numpy(), rows.label.to_numpy(), np.stack(rows.v), leaf, fan)
        low, high, _ = tree.levels[-1]
        one = {"part": rows.part.iloc[0], "tile": rows.tile.iloc[0], "low": [low[0]], "high": [high[0]], "tree": tree.packed()}
        return pd.DataFrame(one)

    return run


class Index:
    """Parts (part, tile, low, high, tree), and for every tile its box and its parts."""

    def __init__(
        self, vectors: DataFrame, part_rows: int = PART_ROWS, most_tiles: int = MOST_TILES,
        sample: int = SAMPLE, leaf: int = 128, fan: int = 16,
    ):
        held = stored(vectors)
        rows = held.count()
        # The sample decides only where tiles are cut; every row is dealt.
        few = held
        if rows > sample:
            share = int(sample / rows * (1 << 30))
            few = held.filter(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)) < share)
        few = few.limit(2 * sample).select("label", "v").toArrow().to_batches()
        keys = [np.column_stack([b.column("label").to_numpy(), _matrix(b.column("v"))]) for b in few if b.num_rows]
        keys = np.concatenate(keys) if keys else np.empty((0, 1))
        wide = np.argsort(-keys[:, 1:].var(axis=0), kind="stable")[:2] + 1 if len(keys) else []
        wanted = min(most_tiles, -(-rows // part_rows))
        self.tiling = Tiling(keys, [0, *map(int, wide)], wanted)
        tile = held.mapInArrow(_dealt(self.tiling), "vec_id long, label long, v array<double>, tile int")
        tile = stored(tile)
        # One number per tile: a tile of many rows is shared by several parts.
        counts = {r.tile: r["count"] for r in tile.groupBy("tile").count().collect()}
        parts = np.array([-(-counts.get(t, 0) // part_rows) for t in range(self.tiling.count)], np.int64)
        self.first, self.parts, self.rows = np.cumsum(parts) - parts, parts, rows
        shares = tile.sparkSession.createDataFrame(
            [(t, int(self.first[t]), int(n)) for t, n in enumerate(parts) if n], "tile int, _first int, _parts int"
        )
        self.trees = stored(
            tile.withColumn("_salt", F.monotonically_increasing_id()).join(F.broadcast(shares), "tile")
            .withColumn("part", F.col("_first") + F.pmod(F.xxhash64("_salt"), F.col("_parts")).cast("int"))
            .select("part", "tile", "vec_id", "label", "v").groupBy("part")
            .applyInPandas(_built(leaf, fan), "part int, tile int, low array<double>, high array<double>, tree binary")
        )
        boxes = (
            self.trees.select("tile", F.posexplode(F.arrays_zip("low", "high")).alias("at", "box"))
            .groupBy("tile", "at").agg(F.min("box.low").alias("low"), F.max("box.high").alias("high"))
            .groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("box"))
        )
        width = keys.shape[1]
        self.low = np.full((self.tiling.count, width), np.inf)
        self.high = np.full((self.tiling.count, width), -np.inf)
        for r in boxes.collect():  # at most `most_tiles` rows
            self.low[r.tile] = [b.low for b in r.box]
            self.high[r.tile] = [b.high for b in r.box]

    def _sent(self, same: bool, first: bool):
        """Task body: the parts that each asker is sent to, of its first tile or of all others."""
        tiling, low, high, starts, parts = self.tiling, self.low, self.high, self.first, self.parts
        some = parts > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.flatnonzero(some)
            boxes = low[known], high[known]
            for batch in batches:
                labels, queries = batch.column("label").to_numpy(), _matrix(batch.column("v"))
                windows = [batch.column(c).to_pylist() for c in ("lows", "highs", "floors")]
                homes = batch.column("home").to_numpy(zero_copy_only=False)
                rows, sent, home = [], [], []
                for at, (label, query) in enumerate(zip(labels, queries)):
                    lows, highs, floors = (np.array(w[at]) for w in windows)
                    fewest, most = products(boxes[0][:, 1:], boxes[1][:, 1:], query)
                    go = _labelled(boxes[0][:, 0], boxes[1][:, 0], label, same)
                    go &= ((most[:, None] >= np.maximum(floors, lows)) & (fewest[:, None] <= highs)).any(axis=1)
                    if first and go.any():
                        # The box that reaches furthest into the windows.
                        reach = np.where(go, np.minimum(most, highs.max()), -np.inf)
                        chosen = np.flatnonzero(reach == reach.max())
                        chosen = known[chosen[np.argmax(most[chosen])]]
                        own = tiling.tiles(np.append(label, query)[None])[0]
                        go_to = [own if same and parts[own] else chosen]
                    else:
                        go_to = [] if first else [t for t in known[go].tolist() if t != homes[at]]
                    for t in go_to:
                        for part in range(starts[t], starts[t] + parts[t]):
                            rows.append(at)
                            sent.append(part)
                            home.append(t)
                taken = batch.drop_columns(["home"]).take(pa.array(rows, pa.int64()))
                yield taken.append_column("home", pa.array(home, pa.int32())).append_column("part", pa.array(sent, pa.int32()))

        return run

    def search(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor, window, vec_id, score): the first k rows of every window, ties by vec_id.

        `asked` holds (anchor, label, v, lows, highs): rows of the anchor's label are sought, or
        of other labels, whose scores lie in the windows.  Equal rows each count.
        """
        names = ["anchor", "label", "v", "lows", "highs", "floors"]
        fields = "anchor long, label long, v array<double>, lows array<double>, highs array<double>, floors array<double>, home int, part int"
        nothing = F.transform("lows", lambda x: F.lit(float("-inf")))
        asked = stored(asked.select("anchor", "label", "v", "lows", "highs"))
        copies = max(1, -(-asked.count() // ASKERS))
        copy = F.pmod(F.xxhash64("anchor"), F.lit(copies)).cast("int").alias("copy")
        parts = max(1, int(self.parts.sum()))
        trees = self.trees.select(
            "part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("asks"), "tree"
        )

        def visit(askers: DataFrame) -> DataFrame:
            rows = askers.select("part", copy, F.lit(1).alias("asks"), *names)
            wanted = trees.join(rows.select("part", "copy").distinct(), ["part", "copy"], "left_semi")
            dealt = (
                wanted.unionByName(rows, allowMissingColumns=True)
                .repartition(parts * copies, "part", "copy").sortWithinPartitions("part", "copy", "asks")
            )
            return dealt.mapInArrow(_visit(same, k), "anchor long, window int, vec_id long, score double")

        started = stored(
            asked.withColumn("floors", nothing).withColumn("home", F.lit(-1))
            .mapInArrow(self._sent(same, first=True), fields)
        )
        found = stored(visit(started))
        # A floor holds only where the first tile gave k rows.
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
        reached = (
            found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k)
            .groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
        )
        homes = started.select("anchor", "home").distinct()
        floor = F.transform(
            "lows", lambda x, w: F.coalesce(F.try_element_at("reached", w), F.lit(float("-inf")))
        )
        others = (
            asked.join(homes, "anchor").join(reached, "anchor", "left")
            .select("anchor", "label", "v", "lows", "highs", floor.alias("floors"), "home")
            .mapInArrow(self._sent(same, first=False), fields)
        )
        every = found.unionByName(visit(stored(others)))
        return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visit(same: bool, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by part and copy, the tree before those that ask it.
        tree = None
        for batch in batches:
            asks, packed = batch.column("asks").to_numpy(), batch.column("tree")
            out: tuple[list, ...] = ([], [], [], [])
            for at in range(batch.num_rows):
                if not asks[at]:
                    tree = RTree.unpacked(packed[at].as_py())
                    continue
                anchor, label = (batch.column(c)[at].as_py() for c in ("anchor", "label"))
                query, *windows = (np.array(batch.column(c)[at].as_py()) for c in ("v", "lows", "highs", "floors"))
                for w, (scores, ids) in enumerate(tree.search(query, anchor, label, same, *windows, k)):
                    for column, values in zip(out, ([anchor] * len(ids), [w] * len(ids), ids.tolist(), scores.tolist())):
                        column += values
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))],
                ["anchor", "window", "vec_id", "score"],
            )
        give_back()

    return run


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10,
    least: int = 30, most: int = 90, **index,
) -> DataFrame:
    """Hard negatives of anchors (vec_id, label, v) among vectors (vec_id, label, v).

    An anchor's positives are its best `positives` other rows of its label by inner product.  For
    each, the first `negatives` rows of other labels come back whose score is at least `least` and
    at most `most` hundredths of the positive's: (anchor_id, positive_id, rank from 1, negative_id,
    positive_score, negative_score).  Ties go to smaller vec_ids; fewer rows: all of them.  A
    negative positive score leaves an empty window.  Repeated rows each count; of anchors with one
    vec_id the first by label and vector asks.  Scores are exact while 90 times them stays under
    2 ** 53.  No vectors or no anchors: no rows.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    tree = Index(vectors, **index)
    if not tree.rows:
        return vectors.sparkSession.createDataFrame([], schema)
    asked = anchors.groupBy(F.col("vec_id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("one")).select("anchor", "one.*")
    open_ = F.array(F.lit(float("-inf"))).alias("lows"), F.array(F.lit(float("inf"))).alias("highs")
    found = stored(tree.search(asked.select("*", *open_), True, positives).select("anchor", "rank", "vec_id", "score"))
    # Windows in whole numbers, so that no rounding moves an edge.
    score = F.col("score").cast("long")
    windows = (
        found.select(
            "anchor", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), score.alias("positive_score"),
            (-F.floor(-score * least / 100)).cast("double").alias("low"), F.floor(score * most / 100).cast("double").alias("high"),
        )
    )
    listed = windows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    asked = asked.join(listed, "anchor").select("anchor", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    hard = tree.search(asked, False, negatives)
    return hard.join(windows.select("anchor", "window", "positive_id", "positive_score"), ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").cast("long").alias("negative_score"),
    )
