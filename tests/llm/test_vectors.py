"""Hard negatives and whitening against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylamp.llm import negatives, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [], 1), (5, [NAN, 1.0], 1),
    (6, [1.0, None], 1), (7, [INF, 0.0], 1), (8, [-0.001, 0.0], 2), (9, [0.25, 0.25], 2), (None, [1.0, 1.0], 1),
    (10, [0.25, 0.5], None), (11, [0.4, 0.4], 1), (11, [0.4, 0.4], 1), (12, [0.25, 0.25], 2), (13, [-1.0, -0.5], 1),
]


def plain_negatives(rows, anchors):
    out = []
    for own, label, q in anchors:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), k, other) for k, other, v in rows if k != own)
        mine = [(k, -s) for s, k, other in scored if other == label][:5]
        for positive, p in mine:
            hard = [(k, -s) for s, k, other in scored if other != label and 30 * p <= 100 * -s <= 90 * p][:10]
            out += [(own, positive, rank, k, int(p), int(s)) for rank, (k, s) in enumerate(hard, 1)]
    return sorted(out)


def rows_of(vectors):
    return [(r.vec_id, r.label, r.v) for r in vectors.collect()]


@pytest.mark.parametrize("options", [{}, {"part_rows": 40, "leaf": 8, "fan": 3}, {"part_rows": 40, "most_tiles": 3, "sample": 50}])
def test_negatives_are_exact(spark, table, options):
    few = table("embeddings").filter("vec_id < 300").withColumn("v", F.lit("x")).withColumn("part", F.lit(1))
    vectors = negatives.whole_vectors(few)
    out = negatives.mine(vectors, vectors.filter("vec_id % 25 = 0"), **options)
    held = rows_of(vectors)
    want = plain_negatives([(k, label, v) for k, label, v in held], [r for r in held if r[0] % 25 == 0])
    assert sorted(map(tuple, out.collect())) == want and len(want) > 300


def test_equal_vectors_share_parts(spark):
    same = [(k, [0.5, 0.25], k % 2) for k in range(200)] + [(k, [0.3, k / 400], k % 3) for k in range(200, 260)]
    vectors = negatives.whole_vectors(spark.createDataFrame(same, SCHEMA))
    index = negatives.Index(vectors, part_rows=30, leaf=4, fan=3)
    sizes = [len(negatives.RTree.unpacked(r.tree).ids) for r in index.trees.collect()]
    assert sum(sizes) == 260 and max(sizes) < 90
    held = rows_of(vectors)
    out = negatives.mine(vectors, vectors.filter("vec_id % 50 = 0"), part_rows=30, leaf=4, fan=3)
    assert sorted(map(tuple, out.collect())) == plain_negatives(held, [r for r in held if r[0] % 50 == 0])


def test_negatives_edges(spark):
    vectors = negatives.whole_vectors(spark.createDataFrame(ODD, SCHEMA))
    held = {k: v for k, _, v in rows_of(vectors)}
    # The empty vector counts as zeros; the others are out for a null or a non-finite entry.
    assert set(held) == {0, 1, 2, 4, 8, 9, 11, 12, 13} and held[8] == [-1.0, 0.0] and held[4] == [0.0, 0.0]
    out = negatives.mine(vectors, vectors)
    want = plain_negatives(rows_of(vectors), [r for r in rows_of(vectors) if r[0] != 11] + [(11, 1, held[11])])
    assert sorted(map(tuple, out.collect())) == want
    assert negatives.mine(vectors.limit(0), vectors).count() == 0
    assert negatives.mine(vectors, vectors.limit(0)).count() == 0
    none = negatives.whole_vectors(spark.createDataFrame([], SCHEMA))
    assert negatives.mine(none, none).collect() == []


def test_boxes_are_skipped():
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 6)) * 300
    vectors = np.floor(np.repeat(centres, 100, axis=0) + draw.normal(size=(4000, 6)) * 5)
    tree = negatives.RTree(np.arange(4000), np.repeat(np.arange(40), 100) % 7, vectors, leaf=16, fan=8)
    leaves = len(tree.levels[0][0])
    open_ = np.array([-INF]), np.array([INF]), np.array([-INF])
    for at in range(0, 4000, 500):
        query, label = vectors[at], tree.labels[tree.ids == at][0]
        tree.visited = 0
        ((scores, ids),) = tree.search(query, at, label, True, *(x.copy() for x in open_), 5)
        fits = (tree.labels == label) & (tree.ids != at)
        every = tree.vectors[fits] @ query
        order = np.lexsort((tree.ids[fits], -every))[:5]
        assert ids.tolist() == tree.ids[fits][order].tolist() and scores.tolist() == every[order].tolist()
        assert tree.visited < leaves / 3
        # A window that no box reaches costs no leaf.
        tree.visited = 0
        assert not len(tree.search(query, at, label, False, np.array([1e9]), np.array([2e9]), np.array([-INF]), 5)[0][0])
        assert tree.visited == 0


def test_tiles_follow_the_packing_order():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(900, 3))
    order = negatives.tiled([points[:, 0], points[:, 1]], np.arange(900), 9)
    assert sorted(order) == list(range(900))
    tiling = negatives.Tiling(points, [0, 1], 16)
    tiles = tiling.tiles(points)
    assert tiling.count == 16 and set(np.bincount(tiles)) <= set(range(50, 63))


def plain_whitening(x, most):
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    covariance = centred.T @ centred / n
    variance, turned = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-variance) if variance[k] > 1e-12 * variance.max()][:most]
    projected = centred @ turned[:, order] / np.sqrt(variance[order])
    deviation = [int(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total))) for row in x]
    return projected, variance[order] / np.trace(covariance), deviation


def compare(numbers, out, most):
    rows = numbers.collect()
    x = np.array([r.x for r in rows])
    projected, explained, deviation = plain_whitening(x, most)
    got = out.toPandas().set_index(["vec_id", "component"]).sort_index()
    assert len(got) == len(rows) * len(explained) and (got.n == len(rows)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    for c, share in enumerate(explained, 1):
        mine = got.xs(c, level="component").loc[[r.vec_id for r in rows]]
        assert np.allclose(mine.explained, share, rtol=1e-9)
        sign = np.sign((mine.whitened.to_numpy() * projected[:, c - 1]).sum())
        assert np.allclose(mine.whitened.to_numpy() * sign, projected[:, c - 1], atol=1e-8)
        assert mine.deviation.tolist() == deviation


def test_whitening(spark, table):
    few = table("embeddings").withColumn("x", F.lit("y")).withColumn("index", F.lit(0))
    numbers = whitening.whole_numbers(few)
    out = whitening.whiten(numbers, 32)
    compare(numbers, out, 32)
    again = whitening.whiten(numbers.repartition(3), 5)
    assert again.agg(F.max("component")).first()[0] == 5


def test_whitening_over_many_blocks(spark, monkeypatch):
    draw = np.random.default_rng(2)
    x = (draw.normal(size=(5000, 4)) * [100, 30, 9, 2]).astype(np.int64) + 1_000_000
    numbers = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, x array<long>")
    compare(numbers.repartition(7), whitening.whiten(numbers.repartition(7), 4), 4)


def test_whitening_edges(spark):
    numbers = whitening.whole_numbers(spark.createDataFrame(ODD, SCHEMA).withColumn("n", F.lit(1)))
    held = sorted((r.vec_id is None, r.vec_id or 0, r.x) for r in numbers.collect())
    assert [k for null, k, _ in held if not null] == [0, 1, 2, 4, 8, 9, 10, 11, 11, 12, 13] and held[-1][0]
    assert held[4][2] == [math.floor(64 * -0.001) + 1_000_000, 1_000_000]
    out = whitening.whiten(numbers)
    assert out.count() == 2 * len(held) and out.filter("vec_id is null").count() == 2
    assert out.filter("vec_id = 11").groupBy("component").agg(F.count("*"), F.count_distinct("whitened")).first()[1:] == (2, 1)
    # Fewer rows than dimensions, equal rows, no rows.
    two = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 2, 1])], "vec_id long, x array<long>")
    assert {r.component for r in whitening.whiten(two).collect()} == {1}
    assert whitening.whiten(two.filter("vec_id = 1")).count() == 0
    assert whitening.whiten(whitening.whole_numbers(spark.createDataFrame([], SCHEMA))).count() == 0
