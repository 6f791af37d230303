"""Steps whose cost once grew faster than their input: same rows, and what must not come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylamp.operators.postings import build_postings
from quarrylamp.operators.textmatch import match_and_rank, query_literals


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_move_once_however_many_queries_ask(spark):
    texts = [
        (1, "red fox runs, red fox sleeps"), (2, "a red hen"), (3, "nothing here"), (4, "fox red"),
        (6, "red fox twice"), (5, None),
    ]
    units = spark.createDataFrame(texts, "id long, content string")
    asked = ["red fox", '"red fox" or hen', 'red -"red fox"', "-fox", "-red or -nothing", "none", '"fox runs" -hen or hen']
    queries = spark.createDataFrame(list(enumerate(asked * 6)), "query_id long, query string")
    lists = build_postings(units, "id", {"content": "D"})
    ids = units.select(F.col("id").alias("unit_id"))
    for listed in (None, ids):
        found = match_and_rank(lists, query_literals(queries), listed, bounded=True)
        assert "hashpartitioning(query_id" not in _plan(found)
        pairs = match_and_rank(lists, query_literals(queries), listed, bounded=False)
        rows = [sorted((r[0], r[1], round(r[2], 12)) for r in x.collect()) for x in (found, pairs)]
        assert rows[0] == rows[1] and len(rows[0]) > len(asked)


def test_next_ids_keeps_its_frames_growing(spark):
    from quarrylamp.operators.sampling import next_ids

    stored = [1, 5, 5, 70_000, (1 << 33) + 1, None]
    asked = [0, 1, 2, 5, 6, 65_536, 70_001, (1 << 33) + 1, 1 << 34, None, 2]
    ids = spark.createDataFrame([(i,) for i in stored], "id long")
    found = next_ids(ids, spark.createDataFrame([(c,) for c in asked], "candidate long"))
    known = [i for i in stored if i is not None]
    expected = {c: min(i for i in known if i >= c) for c in asked if c is not None and c <= max(known)}
    assert sorted(map(tuple, found.collect())) == sorted(expected.items())
    assert "unboundedfollowing" not in _plan(found).lower()


def test_small_batches_share_their_jobs(spark, tmp_path):
    from quarrylamp.operators.encode import hash_encoder
    from quarrylamp.plans.reembed_run import reembed_run
    from quarrylamp.schemas import CHUNK, DOCUMENT

    rows = [(k * 1000, k, 0, f"text {k}", [0.0], "old", None) for k in range(1, 41)]
    chunks = spark.createDataFrame(rows, CHUNK)
    documents = spark.createDataFrame([(k, *[None] * 9) for k in range(1, 41)], DOCUMENT)
    now = F.lit("2030-01-01").cast("timestamp")
    folder = str(tmp_path / "run")
    spark.sparkContext.setJobGroup("batches", "batches")
    progress = reembed_run(documents, chunks, hash_encoder(8), "new", folder, batch_documents=2, now=now)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("batches"))
    assert [tuple(r) for r in progress.orderBy("batch").collect()] == [
        (k, 2 * k + 2, 2, 2, 2 * k + 2, 2 * k + 2) for k in range(20)
    ]
    assert jobs < 60  # 20 batches took some ten jobs each
    written = spark.read.parquet(f"{folder}/chunks").select("batch", "id").collect()
    assert sorted(i for _, i in written) == list(range(40_001, 40_041))
    assert all((i - 40_001) // 2 == batch for batch, i in written)


def test_large_batches_of_queries_are_laid_out_in_blocks(spark):
    from quarrylamp.operators.nearest import nearest

    rows = spark.range(60_000).select(F.col("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    found = nearest(rows.withColumnRenamed("id", "query_id"), rows, 10)
    assert "CoGroups" in _plan(found)  # 600,000 winners would be held by every worker


def test_pages_are_parsed_some_at_a_time():
    import pyarrow as pa

    from quarrylamp.operators.extract import HTML_AT_ONCE, _read_pages

    page = "<title>t</title><body>" + "x" * (HTML_AT_ONCE // 4) + "<a href='/a'>y</a><a>"
    html = [page] * 9 + [None, page * 5, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(html)], ["page_id", "html"])
    found = list(_read_pages(["page_id"])(iter([batch])))
    assert [i for part in found for i in part.column("page_id").to_pylist()] == list(range(12))
    assert len(found) > 3 and all(
        part.num_rows == 1 or sum(map(len, part.column("body").to_pylist())) <= HTML_AT_ONCE for part in found
    )
    assert found[0].column("links").to_pylist()[0] == ["/a", None]
    assert [part.column("titles").to_pylist() for part in found][-1][-1] == []


def test_places_are_told_some_at_a_time():
    import pyarrow as pa

    from quarrylamp.operators.postings import _unnested

    size, lists = 1 << 15, 12
    columns = [pa.array(range(lists)), pa.array([[2] * size] * lists, pa.list_(pa.int32())), pa.array(["D" * size] * lists)]
    found = list(_unnested(["unit_id"])(iter([pa.RecordBatch.from_arrays(columns, ["unit_id", "gaps", "weights"])])))
    assert len(found) > 1 and sum(part.num_rows for part in found) == size * lists
    assert all(part.column("pos").to_pylist()[:2] == [2, 4] for part in found)


def test_decoding_holds_no_ranks(tmp_path):
    import base64

    from quarrylamp.llm.bytebpe import Vocabulary, token_bytes

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens)))
    light, whole = token_bytes(str(path)), Vocabulary(str(path))
    assert not hasattr(light, "rank") and not hasattr(light, "pairs")
    assert light.length.tolist() == whole.length.tolist() and light.bytes.tobytes() == whole.bytes.tobytes()


def test_changed_ids_are_looked_up_and_lists_stay(spark):
    from quarrylamp.plans.ingest import Changes
    from quarrylamp.plans.maintain import refreshed_postings

    rows = [(k, k // 3, f"word{k % 5} red") for k in range(40)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, content string")
    chunks = chunks.unionByName(spark.createDataFrame([(99, None, "red")], chunks.schema))
    titles = chunks.select("id", F.lit("a").alias("title"), F.lit("b").alias("description"), "content")
    lists, whole = build_postings(chunks, "id", {"content": "D"}, keep=["document_id"]), build_postings(titles, "id", {"title": "A"})
    # More ids than are broadcast as rows, one of them twice.
    void = spark.range(5, 300_000).unionByName(spark.range(5, 6)).select(F.col("id").alias("document_id"))
    void = void.unionByName(spark.createDataFrame([(None,), (-7,)], "document_id long"))
    written = void.select(F.col("document_id").alias("id"), *(F.lit("new").alias(c) for c in ("title", "description", "content")))
    changes = Changes(written.filter("id < 0"), void, None, None, lambda: chunks.limit(0))
    found, _ = refreshed_postings(lists, whole, changes)
    assert "hashpartitioning(document_id" not in _plan(found) and "BroadcastHashJoin" in _plan(found)
    want = sorted((r.unit_id, r.lexeme) for r in lists.collect() if r.document_id is None or r.document_id < 5)
    assert sorted((r.unit_id, r.lexeme) for r in found.collect()) == want and len(want) == 31


def test_lexeme_totals_count_different_ids(spark):
    from quarrylamp.operators.postings import lexeme_totals

    ids = [0, 1, 63, 64, (1 << 20) - 1, 1 << 20, (1 << 53) + 1, (1 << 53) + 2, -1, -(1 << 40)]
    rows = [(f"w{k % 7}", ids[k * 3 % 10], ids[k % 9] if k % 11 else None, k + 1) for k in range(400)]
    rows += [("once", 5, None, 3), ("once", 5, None, 9)]
    places = spark.createDataFrame(rows, "lexeme string, unit_id long, document_id long, pos int").repartition(5)
    plain = places.groupBy("lexeme").agg(
        F.count_distinct("unit_id"), F.count_distinct("document_id"), F.count("*"), F.sum("pos")
    )
    found = lexeme_totals(places)
    assert "Expand" not in _plan(found)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    assert lexeme_totals(places.limit(0)).count() == 0


def test_matches_are_cut_to_leading_groups_in_the_task(spark, monkeypatch):
    import random

    from quarrylamp.operators import topk

    draw = random.Random(3)
    rows = [(draw.randrange(4), unit, unit % 60, draw.randrange(9) / 8) for unit in range(3000)]
    rows += [(None, 1, 1, 1.0), (1, 2, None, 1.0), (1, 3, 4, None)]
    ranks = spark.createDataFrame(rows, "query_id long, unit_id long, document_id long, text_rank double").repartition(6)
    left = topk.leading_groups(ranks, "query_id", "document_id", "text_rank", 5)
    # A task holds no more than five groups of a key.
    parts = left.filter("text_rank is not null").groupBy("query_id", F.spark_partition_id()).agg(
        F.count_distinct("document_id").alias("n")
    )
    assert parts.agg(F.max("n")).first()[0] <= 5

    def first(df):
        best = topk.best_row(df.filter("query_id is not null and document_id is not null and text_rank is not null"),
                             ["query_id", "document_id"], "text_rank", "unit_id", ["text_rank"])
        order = [F.col("text_rank").desc(), F.col("document_id")]
        return sorted(map(tuple, topk.top_k(best, ["query_id"], order, 5).collect()))

    assert first(left) == first(ranks) and len(first(left)) == 20
    whole = {r[1] for r in rows[-3:]}
    assert whole <= {r.unit_id for r in left.filter("query_id is null or document_id is null or text_rank is null").collect()}
    # Some rows at a time, as in a long task.
    body = topk._lead("query_id", "document_id", "text_rank", 5)
    monkeypatch.setattr(topk, "PENDING", 50)
    batches = ranks.filter("query_id is not null and document_id is not null").toArrow().to_batches(max_chunksize=40)
    few = list(body(iter(batches)))
    assert sum(b.num_rows for b in few) < 400
    import pyarrow as pa

    assert first(spark.createDataFrame(pa.Table.from_batches(few))) == first(ranks)


def test_owners_join_before_matches_are_made(spark):
    units = spark.createDataFrame([(1, "red fox"), (2, "red hen"), (3, "fox")], "id long, content string")
    owners = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (4, 12)], "unit_id long, document_id long")
    queries = spark.createDataFrame([(7, "red"), (8, "fox or hen")], "query_id long, query string")
    lists = build_postings(units, "id", {"content": "D"})
    plain = match_and_rank(lists, query_literals(queries)).join(owners, "unit_id")
    for bounded in (True, False):
        found = match_and_rank(lists, query_literals(queries), bounded=bounded, owners=owners)
        columns = ["query_id", "unit_id", "text_rank", "document_id"]
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_search_states_the_depth_that_is_asked_for(spark, monkeypatch):
    from quarrylamp.plans import search

    stated = {}

    def stop(*args, **options):
        stated.update(options)
        raise InterruptedError

    monkeypatch.setattr(search, "hybrid_search", stop)
    asked = [(1, "red", [1.0], 1, 10), (2, "hen", [1.0], 6, 50)]
    for rows, depth in ((asked[:1], 200), (asked, 301)):
        queries = spark.createDataFrame(rows, "query_id long, query string, embedding array<float>, page_number int, result_per_page int")
        try:
            search.search(queries, None, None, None, None)
        except InterruptedError:
            pass
        assert stated["max_candidates"] == depth


def test_totals_move_only_the_contents_of_targets(spark):
    from quarrylamp.operators.encode import hash_encoder
    from quarrylamp.operators.ids import first_free, next_id, number_rows
    from quarrylamp.plans.maintain import reembed
    from quarrylamp.schemas import CHUNK, DOCUMENT

    blank = lambda schema, **own: tuple(own.get(f.name) for f in schema.fields)
    documents = spark.createDataFrame([blank(DOCUMENT, id=k) for k in range(9)], DOCUMENT)
    chunks = spark.createDataFrame(
        [blank(CHUNK, id=k, document_id=k // 3, chunk_index=k % 3, content=f"t{k}", embedding=[1.0],
               embedding_model="old" if k % 4 == 0 else "new") for k in range(30)], CHUNK)
    _, rewritten, totals = reembed(documents, chunks, hash_encoder(4), "new", now=F.current_timestamp())
    assert "LeftSemi" not in _plan(totals)
    # Documents 0 to 6 and 8 have an old chunk; document 9 is not stored.
    want = {k // 3 for k in range(27) if k % 4 == 0}
    assert tuple(totals.first()) == (len(want), 3 * len(want))
    assert sorted(r.id for r in rewritten.collect() if r.id >= 30) == list(range(30, 30 + 3 * len(want)))
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    some = number_rows(keys, F.col("key"), next_id(chunks))
    assert sorted(some.collect()) == sorted(number_rows(keys, F.col("key"), first_free(chunks)).collect())
    assert min(r.id for r in number_rows(keys, F.col("key"), first_free(chunks.limit(0))).collect()) == 1


def test_chunks_without_vectors_are_the_same(spark, tmp_path):
    from quarrylamp import testbed

    spark.createDataFrame(
        [(k, " ".join(f"w{i}" for i in range(200 * k))) for k in range(1, 12)] + [(None, "x")], "doc_id long, text string"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    given = [0, 1, 2, 2, 3, 5, 7, 8, 64, 65, None]  # some numbers are missing, one comes twice
    spark.createDataFrame([(v, [1.0]) for v in given], "vec_id long, embedding array<float>").write.parquet(
        f"{tmp_path}/embeddings.parquet"
    )
    whole, light = (testbed.chunks(spark, str(tmp_path), embedded) for embedded in (True, False))
    assert light.columns == whole.columns and light.schema["embedding"].dataType == whole.schema["embedding"].dataType
    columns = [c for c in whole.columns if c != "embedding"]
    rows = [sorted(map(tuple, df.select(columns).collect())) for df in (whole, light)]
    assert rows[0] == rows[1] and len(rows[0]) > len(set(rows[0]))
    assert "hashpartitioning(vec_id" not in _plan(light) and "SortMergeJoin" not in _plan(light)


def test_lists_of_a_unit_travel_as_one_row(spark):
    from quarrylamp.operators.postings import lexeme_totals, positions

    rows = [(k, None if k == 7 else k // 3, f"red word{k % 5} größe red" if k % 4 else None if k % 8 else " ") for k in range(60)]
    rows += [(None, 1, "red"), (10, 3, "again red"), (1 << 40, 1 << 33, "far red " * 300)]
    texts = spark.createDataFrame(rows, "id long, document_id long, content string").repartition(3)
    lists, whole = (build_postings(texts, "id", {"content": "B"}, keep=["document_id"], by_unit=u) for u in (False, True))
    assert whole.count() == lists.select("unit_id").distinct().count() + 1  # one id is there twice
    columns = ["unit_id", "document_id", "lexeme", "pos", "weight"]
    told = [sorted(map(str, positions(p).select(columns).collect())) for p in (lists, whole)]
    assert told[0] == told[1] and len(told[0]) > 700
    plain = positions(lists).groupBy("lexeme").agg(
        F.count_distinct("unit_id"), F.count_distinct("document_id"), F.count("*"), F.sum("pos")
    )
    want = sorted(map(tuple, plain.collect()))
    for given in (positions(lists), lists, whole):
        assert sorted(map(tuple, lexeme_totals(given).collect())) == want
    # Places are told and packed in one task: one body for the lists and one for the places.
    assert _plan(lexeme_totals(whole)).split("== Initial Plan ==")[0].count("MapInArrow") == 2


def test_lexemes_of_a_bucket_are_packed_as_one_row():
    import numpy as np
    import pyarrow as pa

    from quarrylamp.operators import postings as module

    numbers = np.array([0, 1, 127, 128, 16_383, 16_384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1, 5])
    coded, ends = module._shortened(numbers)
    assert module._lengthened(coded).tolist() == numbers.tolist() and np.diff(ends, prepend=0).tolist() == [1, 1, 1, 2, 2, 3, 3, 4, 4, 1]
    count = 40_000
    columns = {"lexeme": [f"w{k % 9_000}" for k in range(count)], "unit_id": range(count), "document_id": [k // 2 for k in range(count)]}
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns.values()), pa.array(range(count), pa.int32())], [*columns, "pos"])
    packed = pa.Table.from_batches(module._pack_places(iter([batch, batch])))
    assert packed.num_rows <= 2 * module.TOTAL_BUCKETS  # 9,000 lexemes
    buckets = set(packed.column("bucket").to_pylist())
    counted = [module._count_ids(packed.filter(pa.compute.equal(packed.column("bucket"), b))).to_pylist() for b in buckets]
    found = {(r["lexeme"], r["unit"]): (r["different"], r["n"]) for rows in counted for r in rows}
    assert len(found) == 18_000 and found["w17", True] == (5, 10) and found["w17", False] == (5, 0)


def test_only_contents_asked_for_are_hashed(spark, monkeypatch):
    from quarrylamp.operators.encode import hash_encoder
    from quarrylamp.plans import ingest
    from quarrylamp.plans.ingest import ingest_changes
    from quarrylamp.schemas import CHUNK, DOCUMENT

    plans, stored = [], ingest.materialized
    note = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df)
    monkeypatch.setattr(ingest, "materialized", note)
    page = lambda n, seq, text: (f"https://a.example/{n}", "t", text, "d", seq)
    rows = [page(1, 1, "old"), page(1, 2, "new"), page(1, 2, "new"), page(1, 2, "a tie"), page(2, 1, "other")]
    pages = spark.createDataFrame(rows, "url string, title string, content string, description string, seq long")
    changes = ingest_changes(
        pages, spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK), hash_encoder(8), "m", F.lit("2024-01-01").cast("timestamp")
    )
    import hashlib

    last = max(["new", "a tie"], key=lambda text: hashlib.sha256(text.encode()).hexdigest())
    assert sorted(r.content for r in changes.chunks.collect()) == sorted([last, "other"])
    # The hash belongs to the join of messages and what is asked for; no message is hashed for itself.
    assert "sha2" in plans[-1] and not any("AS content_hash" in line and "sha2" in line for line in plans[-1].splitlines())
