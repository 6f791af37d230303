import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylamp.operators.ann import build_cells, search_cells
from quarrylamp.operators.covers import Hits, fold
from quarrylamp.operators.nearest import nearest
from quarrylamp.operators.percentiles import percentiles
from quarrylamp.operators.postings import chunk_postings, document_postings, write_postings
from quarrylamp.operators.sampling import random_documents, random_documents_batch
from quarrylamp.operators.textmatch import query_literals, rank_cover
from quarrylamp.operators.topk import top_k
from quarrylamp.operators.vector import vector_search
from quarrylamp.plans.evaluate import evaluate, summarize
from quarrylamp.plans.search import search
from quarrylamp.sources import cases
from quarrylamp.workloads import stored_cases


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    matrix = rng.standard_normal((120, 8)).astype(np.float32)
    matrix[5] = matrix[6]
    matrix[9] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def as_set(df):
    return {(r.query_id, r.id, r.rank) for r in df.collect()}


def test_layouts_and_all_cells_agree(spark, vectors):
    queries = vectors.withColumnRenamed("id", "query_id").filter("query_id <> 9")
    exact = as_set(nearest(queries, vectors, 6, exclude_self=True))
    grid = nearest(queries, vectors, 6, exclude_self=True, max_broadcast_bytes=1,
                   vector_block=17, query_block=11)
    assert as_set(grid) == exact
    index = build_cells(vectors, cells=4)
    assert as_set(search_cells(index, queries, 6, probes=4, exclude_self=True)) == exact
    cells = search_cells(index, queries, 6, probes=2, exclude_self=True)
    cell_grid = search_cells(index, queries, 6, probes=2, exclude_self=True,
                             max_broadcast_bytes=1, vector_block=9, query_block=7)
    assert as_set(cells) == as_set(cell_grid)


def test_zero_vectors(spark, vectors):
    queries = vectors.filter("id = 0").withColumnRenamed("id", "query_id")
    first = vector_search(queries, vectors, 0.99, 2).orderBy("rank").collect()
    assert first[0].id == 9 and np.isnan(first[0].similarity) and first[1].id == 0
    last = nearest(queries, vectors, 120).filter("rank = 120").first()
    assert (last.id, last.similarity) == (9, 0.0)


def test_top_k_column(spark):
    rows = [(q, i, float(-i)) for q in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "q long, id long, s double").withColumn("k", F.col("q") * 3)
    cut = top_k(df, ["q"], [F.col("s").desc(), F.col("id")], "k", spread_by=["id"], bound=6)
    assert {(r.q, r.id) for r in cut.collect()} == {(q, i) for q in (1, 2) for i in range(3 * q)}


DOCUMENTS = "id long, url string, title string, description string, random_key double"


def small_corpus(spark):
    documents = spark.createDataFrame(
        [(i, f"https://e.com/{i}", f"title {i}", "d", i / 10) for i in range(5)], DOCUMENTS
    ).withColumn("content", F.lit(None).cast("string"))
    vector = {0: [1.0, 0.0], 1: [0.9, 0.1], 2: [0.0, 1.0], 3: [-1.0, 0.0], 4: [0.0, 0.0]}
    chunks = spark.createDataFrame(
        [(i * 10, i, 0, "apple pie" if i == 2 else f"text {i}", vector[i]) for i in range(5)],
        "id long, document_id long, chunk_index int, content string, embedding array<float>",
    )
    return documents, chunks


def test_paged_search(spark):
    documents, chunks = small_corpus(spark)
    asked = spark.createDataFrame(
        [(1, "apple", [1.0, 0.0], 1, 2), (2, "apple", [1.0, 0.0], 2, 2),
         (3, "  ", [1.0, 0.0], 4, 0), (4, "x" * 513, [1.0, 0.0], 0, 0),
         (5, "apple", [1.0, 0.0], 101, 0), (6, "apple", [1.0, 0.0], 9, 10)],
        "query_id long, query string, embedding array<float>, page_number int, result_per_page int",
    )
    found, refused = search(asked, documents, chunks, chunk_postings(chunks),
                            document_postings(documents), threshold=0.78)
    rows = found.orderBy("query_id", "rank").collect()
    pages = {q: [(r.url[-1], r.has_next) for r in rows if r.query_id == q] for q in range(1, 7)}
    assert pages[1] == [("0", True), ("1", True)]
    assert pages[2] == [("2", False)]
    assert len(pages[3]) == 5 and not any(n for _, n in pages[3])
    assert all(r.content == "" and r.page_number == 4 for r in rows if r.query_id == 3)
    assert pages[6] == []
    assert {r.query_id for r in refused.collect()} == {4, 5}


def test_wrapping_sample(spark):
    documents, _ = small_corpus(spark)
    assert [r.id for r in random_documents(documents, 3, pivot=0.25).collect()] == [3, 4, 0]
    asked = spark.createDataFrame([(1, 3, 0.25), (2, 9, 0.99), (3, 2, 0.2)],
                                  "query_id long, n int, pivot double")
    rows = random_documents_batch(documents, asked).orderBy("query_id", "rank").collect()
    assert [[r.id for r in rows if r.query_id == q] for q in (1, 2, 3)] == [
        [3, 4, 0], [0, 1, 2, 3, 4], [2, 3]
    ]


def test_evaluation(spark):
    cases = spark.createDataFrame(
        [(1, "q", "a", 2.0), (1, "q", "b", 1.0), (2, "r", "c", 1.0)],
        "query_id long, query string, url string, grade double",
    )
    results = spark.createDataFrame(
        [(1, 1, "x"), (1, 2, "a"), (1, 3, "b")], "query_id long, rank int, url string"
    )
    per_case = evaluate(cases, results, (2,))
    one, two = per_case.orderBy("query_id").collect()
    assert (one.mrr, one.precision_2, one.recall_2) == (0.5, 0.5, 0.5)
    assert one.ap == pytest.approx((1 / 2 + 2 / 3) / 2)
    best = 3 + 1 / np.log2(3)
    assert one.ndcg_2 == pytest.approx(3 / np.log2(3) / best)
    assert two.returned_urls == [] and two.ap == 0.0
    assert summarize(per_case).first().mean_mrr == 0.25


def test_percentiles(spark):
    rows = [("s", float(v)) for v in (1, 2, 3, 4)] + [("l", float(v)) for v in range(30_001)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r.g, r.fraction): r.percentile
             for r in percentiles(df, ["g"], "v", [0.5, 0.951]).collect()}
    assert found[("s", 0.5)] == 2.5
    assert found[("l", 0.5)] == 15_000.0
    assert found[("l", 0.951)] == pytest.approx(28_530.0)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 999, 20_001])
def test_percentiles_of_any_size(spark, n):
    draw = np.random.default_rng(n)
    held = np.round(draw.lognormal(size=n), 2)  # with ties
    df = spark.createDataFrame([("g", float(v)) for v in held] + [("none", None)], "g string, v double")
    fractions = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    found = {r.fraction: r.percentile for r in percentiles(df, ["g"], "v", fractions).collect()}
    for fraction in fractions:
        assert found[fraction] == pytest.approx(np.quantile(held, fraction))


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert [(r.fraction, r.percentile) for r in percentiles(empty, [], "v", [0.5]).collect()] == [(0.5, 0.0)]


def test_a_limit_over_the_stated_bound_is_an_error(spark):
    df = spark.createDataFrame([(1, k, 9) for k in range(12)], "q long, v long, k int")
    assert top_k(df, ["q"], [F.col("v")], "k", bound=9).count() == 9
    with pytest.raises(Exception, match="exceeds the stated bound"):
        top_k(df, ["q"], [F.col("v")], "k", bound=4).collect()


def test_cover_rank_by_hand():
    # a x b a b: covers of "a and b" are (0, 2), (2, 3) and (3, 4); the second pair has no b.
    a, b = 0, 1
    hits = Hits(np.array([0, 0, 0, 0, 1]), np.array([1, 3, 4, 5, 9]), np.array([a, b, a, b, a]), np.full(5, 10.0))
    both = [(0, [([(a, 0)], False), ([(b, 0)], False)])]
    rank, hit = fold(hits, 2, both)
    total = 0.1 / 2 + 0.1 + 0.1
    assert rank[0] == pytest.approx(total / (total + 1)) and np.isnan(rank[1]) and hit == []
    phrase = [(0, [([(a, 0), (b, 1)], False)])]
    assert fold(hits, 2, phrase)[0][0] == pytest.approx(0.1 / 1.1)
    without = [(0, [([(a, 0)], False), ([(b, 0)], True)]), (1, [([(b, 0)], True)])]
    rank, hit = fold(hits, 2, without)
    assert np.isnan(rank[0]) and rank[1] == pytest.approx(0.1 / 1.1)
    assert [(number, pairs.tolist()) for number, pairs in hit] == [(1, [0])]


def test_stored_postings_answer_alike(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(k, k // 2, "slate chalk marl " * (k % 3) + f"w{k}") for k in range(30)],
        "id long, document_id long, content string",
    )
    plain = chunk_postings(chunks)
    write_postings(plain, str(tmp_path / "index"))
    asked = query_literals(spark.createDataFrame([(1, "slate w4"), (2, "w7 or marl")], "query_id long, query string"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(rank_cover(stored, asked)) == key(rank_cover(plain, asked))
    assert "PartitionFilters: [bucket" in _plan(rank_cover(stored, asked))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_stored_case_grows_with_its_source(spark, tmp_path, monkeypatch):
    count = 1000
    documents = spark.range(count).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("source"))
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(count).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("quality")).write.parquet(f"{tmp_path}/labels.parquet")
    largest = []
    read = cases.read_cases

    def watched(spark, path):
        found = read(spark, path)
        files = spark.read.text(path, wholetext=True)
        largest.append(files.select(F.max(F.size(F.split("value", ":")))).first()[0])
        return found

    monkeypatch.setattr(cases, "read_cases", watched)
    got = [tuple(r) for r in stored_cases(spark, str(tmp_path), labels_a_case=50).collect()]
    assert sorted(got) == sorted(("hot" if k < 900 else "cold", k, 2.0) for k in range(0, count, 3))
    assert largest[0] < 150


def test_rings_are_read_until_none_can_be_better(spark):
    from quarrylamp.operators.ann import cells_around
    from quarrylamp.operators.nearest import nearest
    from quarrylamp.operators.rings import ring_index, search_rings

    draw = np.random.default_rng(3)
    centers = draw.normal(size=(30, 8))
    vectors = np.repeat(centers, 40, axis=0) + draw.normal(size=(1200, 8)) * 0.1
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(5000, [0.0] * 8), (5001, vectors[0].tolist())]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = stored.filter("id % 60 = 0 or id > 4999").select(F.col("id").alias("query_id"), "embedding", (F.lit(1) + F.col("id") % 7).alias("n"))
    index = ring_index(cells_around(stored, centers))
    assert index.rows.sum() == len(rows)
    for options in ({}, {"exclude_self": True}, {"min_similarity": 0.99}, {"half": True}):
        for k in (5, "n", 2000):
            want = nearest(asked, stored, k, **options).select("query_id", "id", "similarity", "rank")
            got, used = search_rings(index, asked, k, counted=True, **options)
            assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    _, used = search_rings(index, asked.filter("query_id < 5000"), 5, counted=True)
    # Clusters are narrow: a query reads far less than half of the rings.
    assert max(r.rings for r in used.collect()) < len(index.rings) / 2


def test_a_task_sends_its_best_rows_once_for_a_key(spark):
    df = spark.range(0, 6_000, 1, 3).select(F.lit(1).alias("q"), "id", (F.col("id") * 7 % 6_000).alias("s"))
    cut = top_k(df, ["q"], [F.col("s").desc(), F.col("id")], 5, spread_by=["id"])
    assert [r.s for r in cut.orderBy("rank").collect()] == [5_999, 5_998, 5_997, 5_996, 5_995]
    # All rows of a task are one piece: the limit before the shuffle leaves five of them, not five a salt.
    before_shuffle = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "SPARK_PARTITION_ID()" in before_shuffle and "xxhash64" not in before_shuffle


@pytest.mark.parametrize("minimum, nan_order", [(None, "last"), (None, "first"), (0.3, "last")])
def test_most_scores_of_a_block_are_only_compared(monkeypatch, minimum, nan_order):
    from quarrylamp.operators import nearest as module

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1_000, 16)).repeat(2, 0)  # every row twice: ties
    vectors[5] = 0
    unit, ids, k = module._unit(vectors, False), rng.permutation(2_000), 4
    worked = []
    for name in ("round", "partition"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, _plain=plain, **b: worked.append(np.size(x)) or _plain(x, *a, **b))
    best = module._Best(np.full(100, k), minimum)
    module._score_block(best, ids, unit, unit[:100], ids[:100], nan_order, True)
    query, row, score = best.compact()
    monkeypatch.undo()
    assert sum(worked) < 0.3 * 2_000 * 100
    scores = np.round(unit @ unit[:100].T, 9)
    scores[np.isnan(scores)] = np.inf if nan_order == "first" else -np.inf
    for q in range(100):
        rows = sorted((-s, i) for s, i in zip(scores[:, q], ids) if i != ids[q] and (minimum is None or s > minimum))[:k]
        assert [(-s, i) for s, i in zip(score[query == q], row[query == q])] == rows


def _by_hand(query_ids, queries, ids, vectors, k):
    """(query, id, score) of the k best other rows, undefined scores last."""
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = [m / np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True)) for m in (queries, vectors)]
    scores = np.round(unit[0] @ unit[1].T, 9)
    scores[np.isnan(scores)] = -np.inf
    return sorted(
        (q, i, -s) for at, q in enumerate(query_ids)
        for s, i in sorted((-s, i) for s, i in zip(scores[at], ids) if i != q)[:k]
    )


def test_few_scores_of_a_block_are_worked_out_in_double_precision(monkeypatch):
    from quarrylamp.operators import nearest as module

    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(6_000, 16))
    unit, ids = module._unit(vectors, False), np.arange(6_000)
    single, double = [], []
    matmul, einsum = np.matmul, np.einsum
    monkeypatch.setattr(np, "matmul", lambda a, b, **o: single.append((a.dtype, len(a) * b.shape[1])) or matmul(a, b, **o))
    monkeypatch.setattr(np, "einsum", lambda s, a, b: double.append(len(a)) or einsum(s, a, b))
    best = module._Best(np.full(50, 10), None)
    module._score_block(best, ids, unit, unit[:50], ids[:50], "last", True)
    query, row, score = best.compact()
    monkeypatch.undo()
    assert {kind for kind, _ in single} == {np.dtype(np.float32)} and sum(n for _, n in single) == 6_000 * 50
    assert 50 * 10 <= sum(double) < 0.02 * 6_000 * 50
    assert sorted(zip(query.tolist(), row.tolist(), score.tolist())) == _by_hand(range(50), vectors[:50], ids, vectors, 10)


def test_own_rows_do_not_push_out_others():
    from quarrylamp.operators import nearest as module

    vectors = np.random.default_rng(6).normal(size=(500, 8)).repeat(6, 0)
    unit, ids = module._unit(vectors, False), np.arange(500).repeat(6)
    best = module._Best(np.full(30, 4), None)
    module._score_block(best, ids, unit, unit[:180:6], ids[:180:6], "last", True)
    query, row, score = best.compact()
    assert sorted(zip(query.tolist(), row.tolist(), score.tolist())) == _by_hand(range(30), vectors[:180:6], ids, vectors, 4)


def test_blocks_travel_packed(spark):
    rng = np.random.default_rng(8)
    matrix = rng.normal(size=(3_000, 6)).astype(np.float32)
    matrix[7] = 0
    matrix[40:80] = matrix[30]
    ids = np.arange(3_000)
    rows = [(int(i), v.tolist(), 5 if i < 2_000 else int(i) % 40 + 10) for i, v in zip(ids, matrix)]
    stored = spark.createDataFrame(rows, "id long, embedding array<float>, cell int").repartition(3)
    queries = stored.filter("id < 400").select(
        F.col("id").alias("query_id"), "embedding", F.concat(F.lit([5, 999]), F.sequence(F.lit(10), F.lit(49))).alias("cells")
    )
    want = [(q, i, max(s, 0.0) if s == -np.inf else s) for q, i, s in _by_hand(ids[:400], matrix[:400], ids, matrix, 5)]
    for by_cell in (False, True):
        found = nearest(queries, stored, 5, exclude_self=True, by_cell=by_cell, max_broadcast_bytes=1, vector_block=700, query_block=90)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()
        assert sorted((r.query_id, r.id, r.similarity) for r in found.collect()) == want
    # Without an id: among the rows, and the first of equals.
    nameless = spark.createDataFrame([(None, rows[0][1], 5)] * 2, stored.schema)
    again = nearest(queries.filter("query_id = 0"), stored.unionByName(nameless), 2, max_broadcast_bytes=1)
    assert [r.id for r in again.orderBy("rank").collect()] == [None, None]


def test_length_of_a_vector_is_worked_out_once(spark):
    from quarrylamp.functions.vectors import l2_normalize

    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>").select(l2_normalize(F.col("v")).alias("u"))
    assert [r.u and [round(x, 6) for x in r.u] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    assert "/ greatest(" not in df._jdf.queryExecution().analyzed().toString()


def test_recall_stores_the_exact_search(spark, vectors):
    from quarrylamp.operators.ann import recall_benchmark

    queries = vectors.withColumnRenamed("id", "query_id")
    report = recall_benchmark(vectors, queries, 4, cells=3, probes=(1, 3))
    # The vectors are no file: what is read from one is the exact search, for both its uses.
    assert "Scan parquet" in _plan(report)
    found = {r.config: r.recall_at_k for r in report.collect()}
    assert found[3] == 1.0 and 0 < found[1] < 1
