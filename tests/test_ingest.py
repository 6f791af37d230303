import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarrylamp.operators.encode import hash_encoder
from quarrylamp.operators.extract import extract_pages, page_links
from quarrylamp.operators.ids import number_rows
from quarrylamp.operators.links import reachable
from quarrylamp.plans.ingest import ingest
from quarrylamp.plans.maintain import reembed
from quarrylamp.plans.reembed_run import applied, batched, reembed_run, totals
from quarrylamp.schemas import CHUNK, DOCUMENT, INGEST_MESSAGE
from quarrylamp.sources.cases import read_cases
from quarrylamp.sources.tables import materialized
from quarrylamp.streaming.ingest import (
    create_tables, ingest_stream, page_stream, stored_chunks, stored_documents,
)

FIRST = [
    ("https://a.com", "t", "one two", "d", 1),
    ("https://A.com/", "t2", "three", "d", 2),
    ("https://b.com", "t", "four", "d", 3),
    ("ftp://c.com", "t", "five", "d", 4),
    ("https://d.com", "t", " ", "d", 5),
]
SECOND = [
    ("https://a.com", "new title", "three", "d", 6),
    ("https://b.com", "t", "changed", "d", 7),
    ("https://e.com", "t", "six", "d", 8),
]


def messages(spark, rows):
    return spark.createDataFrame(rows, INGEST_MESSAGE)


def view(documents, chunks):
    stored = {r.id: r for r in documents.collect()}
    texts = {r.document_id: r.content for r in chunks.collect()}
    return {r.url: (r.title, texts[r.id]) for r in stored.values()}


EXPECTED = {
    "https://a.com/": ("new title", "three"),
    "https://b.com/": ("t", "changed"),
    "https://e.com/": ("t", "six"),
}


def test_ingest_twice(spark):
    encoder = hash_encoder(8)
    empty = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    documents, chunks, status = ingest(messages(spark, FIRST), *empty, encoder, "m")
    assert {r.url: r.status for r in status.collect()} == {
        "https://a.com/": "new", "https://b.com/": "new"
    }
    documents, chunks = materialized(documents), materialized(chunks)
    before = {r.url: (r.id, r.random_key) for r in documents.collect()}
    again, after_chunks, status = ingest(messages(spark, SECOND), documents, chunks, encoder, "m")
    assert {r.url: r.status for r in status.collect()} == {
        "https://a.com/": "unchanged", "https://b.com/": "changed", "https://e.com/": "new"
    }
    again, after_chunks = materialized(again), materialized(after_chunks)
    after = {r.url: (r.id, r.random_key) for r in again.collect()}
    assert all(after[u] == before[u] for u in before)
    assert view(again, after_chunks) == EXPECTED
    _, _, other = ingest(messages(spark, SECOND[:1]), documents, chunks, encoder, "other")
    assert other.first().status == "changed"


def streamed(spark, tmp_path, *batches, base=None, model="m"):
    """Documents and chunks after one run of the stream per list of messages."""
    incoming, root = str(tmp_path / "in"), str(tmp_path / "tables")
    empty = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    create_tables(*(base or empty), root)
    for rows in batches:
        messages(spark, rows).coalesce(1).write.mode("append").parquet(incoming)
        ingest_stream(page_stream(spark, incoming), root, hash_encoder(8), model).awaitTermination()
    return stored_documents(spark, root), stored_chunks(spark, root)


def test_stream_equals_batch(spark, tmp_path):
    first = streamed(spark, tmp_path / "one", FIRST)
    before = {r.url: (r.id, r.random_key) for r in first[0].collect()}
    documents, chunks = streamed(spark, tmp_path / "two", FIRST, SECOND)
    assert view(documents, chunks) == EXPECTED
    after = {r.url: (r.id, r.random_key) for r in documents.collect()}
    assert all(after[u] == before[u] for u in before)
    assert sorted(i for i, _ in after.values()) == [1, 2, 3]
    assert chunks.select("id").distinct().count() == chunks.count() == 3


def test_stream_keeps_the_latest_message(spark, tmp_path):
    late = [("https://a.com", "late", "older text", "d", 0), ("https://b.com", "t", "no number", "d", None)]
    assert view(*streamed(spark, tmp_path, FIRST, SECOND, late)) == EXPECTED


def test_stream_starts_from_stored_tables(spark, tmp_path):
    empty = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    documents, chunks, _ = ingest(messages(spark, FIRST), *empty, hash_encoder(8), "m")
    base = materialized(documents), materialized(chunks)
    owned = {r.document_id: r.id for r in base[1].collect()}
    after = streamed(spark, tmp_path / "same", SECOND, base=base)
    assert view(*after) == EXPECTED
    ids = {r.url: r.id for r in after[0].collect()}
    kept = {r.document_id: r.id for r in after[1].collect()}
    a, b = ids["https://a.com/"], ids["https://b.com/"]
    assert kept[a] == owned[a] and kept[b] not in owned.values()  # unchanged, changed
    other = streamed(spark, tmp_path / "other", SECOND[:1], base=base, model="new")
    assert {r.document_id: r.embedding_model for r in other[1].collect()} == {a: "new", b: "m"}


def test_replayed_batch_changes_nothing(spark, tmp_path):
    documents, chunks = streamed(spark, tmp_path, FIRST, SECOND)
    rows = [sorted(documents.drop("crawled_at", "updated_at").collect()), sorted(chunks.drop("created_at").collect())]
    # The batch was written, but its driver went before the stream noted that it was done.
    (tmp_path / "tables" / "progress" / "commits" / "1").unlink()
    (tmp_path / "tables" / "progress" / "commits" / ".1.crc").unlink(missing_ok=True)
    ingest_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "tables"), hash_encoder(8), "m").awaitTermination()
    root = str(tmp_path / "tables")
    again = stored_documents(spark, root), stored_chunks(spark, root)
    assert [sorted(again[0].drop("crawled_at", "updated_at").collect()), sorted(again[1].drop("created_at").collect())] == rows


def test_numbering_is_dense(spark):
    ids = [r.id for r in number_rows(
        spark.range(500).select(F.col("id").alias("k")), F.col("k"), 7).collect()]
    assert sorted(ids) == list(range(7, 507))


def test_page_fields(spark):
    html = (
        "<html><head><title> One </title><title>Two</title>"
        '<meta name="description" content=" About "></head>'
        "<body>Hi&amp;\n <script>var x;</script><a href='/a'>A</a><a>none</a></body></html>"
    )
    pages = spark.createDataFrame(
        [("https://E.com/p", html), ("https://e.com/q", "<title>x</title>")],
        "url string, html string",
    )
    row, = extract_pages(pages).collect()
    assert (row.url, row.title, row.description) == ("https://e.com/p", "One", "About")
    assert row.body == "Hi& var x;Anone" and row.references == ["/a"]
    raw = {r.url: r for r in extract_pages(pages, raw=True).collect()}
    assert raw["https://E.com/p"].title == " One Two"
    assert raw["https://E.com/p"].references == ["/a", ""]
    assert [r.dst_url for r in page_links(extract_pages(pages)).collect()] == ["https://e.com/a"]


def test_reachable(spark):
    h, o = "https://h.com", "https://o.com"
    edges = [(f"{h}/1", f"{h}/2"), (f"{h}/2", f"{h}/3"), (f"{h}/3", f"{h}/1"), (f"{h}/1", f"{o}/4")]
    links = spark.createDataFrame(edges, "src_url string, dst_url string")
    starts = spark.createDataFrame([(f"{h}/1",)], "start_url string")
    for depth, pages in ((1, {1: 1}), (2, {1: 1, 2: 2}), (5, {1: 1, 2: 2, 3: 3})):
        found = {r.url: r.depth for r in reachable(links, starts, depth).collect()}
        assert found == {f"{h}/{p}": d for p, d in pages.items()}


def test_read_cases(spark, tmp_path):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps([
        {"query": "oil lamps", "relevant_urls": ["http://Lamp.test/A", "http://lamp.test/b"]},
        {"query": "plans", "relevance": {"u": 2, "v": 0, "w": 1.5}, "relevant_urls": ["z"]},
    ]))
    rows = {(r.query, r.url, r.grade) for r in read_cases(spark, str(path)).collect()}
    assert rows == {("oil lamps", "http://Lamp.test/A", 1.0), ("oil lamps", "http://lamp.test/b", 1.0), ("plans", "u", 2.0), ("plans", "w", 1.5)}
    for bad in ({"query": "x"}, [{"relevant_urls": ["a"]}], [{"query": "x", "relevance": {"a": 0}}]):
        path.write_text(json.dumps(bad))
        with pytest.raises(Exception, match="not_an_array|no_query|no_positive_label"):
            read_cases(spark, str(path)).collect()


def test_equal_messages_give_one_set_of_chunks(spark):
    pages = spark.createDataFrame(
        [("http://lamp.test/a", "t", "one", "", 5), ("http://lamp.test/a", "t", "two", "", 5),
         ("http://lamp.test/a", "t", "two", "", 5), ("http://lamp.test/a", "t", "old", "", 1)],
        "url string, title string, content string, description string, seq long",
    )
    documents = spark.createDataFrame([], DOCUMENT)
    chunks = spark.createDataFrame([], CHUNK)
    stored, pieces, _ = ingest(pages, documents, chunks, hash_encoder(4), "m")
    (document,), rows = stored.collect(), pieces.collect()
    assert [(r.document_id, r.chunk_index) for r in rows] == [(document.id, 0)]
    assert document.content_hash == hashlib.sha256(rows[0].content.encode()).hexdigest()


def test_reachable_by_sets_of_starts(spark):
    import random

    from quarrylamp.operators.links import numbered_starts, reachable_sets

    draw = random.Random(4)
    page = lambda k: f"https://h{k % 3}.example.com/{k}"
    edges = [(page(draw.randrange(300)), page(draw.randrange(300))) for _ in range(1500)]
    edges += [(page(k), page(0)) for k in range(0, 300, 3)]  # a hub of its host
    starts = [page(k) for k in range(200)]
    links = spark.createDataFrame(edges + edges[:50], "src_url string, dst_url string")
    begin = spark.createDataFrame([(s,) for s in starts], "start_url string")
    out = {}
    for r in edges:
        if r[0].split("/")[2] == r[1].split("/")[2]:
            out.setdefault(r[0], set()).add(r[1])
    want = set()
    for start in starts:
        seen, frontier = {start}, {start}
        want.add((start, start, 1))
        for depth in (2, 3, 4):
            frontier = {d for u in frontier for d in out.get(u, ())} - seen
            seen |= frontier
            want |= {(start, u, depth) for u in frontier}
    assert {tuple(r) for r in reachable(links, begin, 4).collect()} == want
    sets = reachable_sets(links, numbered_starts(begin.coalesce(1)), 2).filter("depth = 2")
    # The hub is reached by a third of all starts and takes far fewer rows.
    assert sets.filter(f"url = '{page(0)}'").count() < 10


def test_report_is_documents_of_cases(spark, tmp_path):
    import json

    from quarrylamp.sources.cases import read_report, write_report

    rows = [(k, k / 8, [f"u{k}"]) for k in range(50)]
    per_case = spark.createDataFrame(rows, "query_id long, mrr double, returned_urls array<string>")
    write_report(per_case, str(tmp_path / "a" / "report"), cases_a_file=10)
    texts = [f.read_text() for f in (tmp_path / "a" / "report").rglob("*.txt")]
    found = [json.loads(t)["cases"] for t in texts]
    assert len(found) > 2 and sorted(c["query_id"] for cases in found for c in cases) == list(range(50))
    back = read_report(spark, str(tmp_path / "a" / "report")).select(per_case.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, per_case.collect()))
    write_report(per_case.limit(0), str(tmp_path / "none"))
    (only,) = (tmp_path / "none").rglob("*.txt")
    assert json.loads(only.read_text()) == {"cases": []}


def test_batches_follow_ids(spark):
    ids = [-3, 0, 5, 65535, 65536, 1 << 31, (1 << 33) + 1, 1 << 34, (1 << 34) + 2]
    got = batched(spark.createDataFrame([(i,) for i in reversed(ids)], "document_id long"), 2)
    assert {r.document_id: r.batch for r in got.collect()} == {i: k // 2 for k, i in enumerate(ids)}


def test_run_goes_on_after_a_lost_driver(spark, tmp_path):
    encoder, now = hash_encoder(8), F.lit("2030-01-01").cast("timestamp")
    rows = [(f"https://{k}.com", "t", f"text number {k} " * (1 + k % 3), "d", k) for k in range(1, 24)]
    empty = spark.createDataFrame([], DOCUMENT), spark.createDataFrame([], CHUNK)
    documents, chunks, _ = ingest(messages(spark, rows), *empty, encoder, "old")
    documents, chunks = materialized(documents), materialized(chunks)
    folder = str(tmp_path / "run")
    options = {"batch_documents": 5, "now": now}

    assert reembed_run(documents, chunks, encoder, "old", str(tmp_path / "none")).count() == 0
    assert applied(documents, chunks, str(tmp_path / "none"))[1].count() == chunks.count()
    first = reembed_run(documents, chunks, encoder, "new", folder, max_batches=2, **options).collect()
    assert [(r.batch, r.documents_so_far) for r in sorted(first)] == [(0, 5), (1, 10)]
    halfway = applied(documents, chunks, folder, now)
    assert halfway[1].filter("embedding_model = 'new'").count() == first[-1].chunks_so_far
    assert halfway[0].filter(F.col("updated_at") == now).count() == 10

    class Lost(Exception):
        pass

    def failing(texts):
        raise Lost

    with pytest.raises(Lost):
        reembed_run(documents, chunks, failing, "new", folder, **options)
    # A batch whose chunks were written, but whose driver went before it said so, does not count.
    chunks.limit(3).withColumn("embedding_model", F.lit("new")).write.mode("overwrite").parquet(f"{folder}/chunks/batch=2")
    assert applied(documents, chunks, folder, now)[1].filter("embedding_model = 'new'").count() == first[-1].chunks_so_far

    last = sorted(reembed_run(documents, chunks, encoder, "new", folder, **options).collect())[-1]
    assert (last.batch, last.documents_so_far) == (4, 23)
    assert totals(spark, folder).count() == 5
    after = applied(documents, chunks, folder, now)
    whole = reembed(documents, chunks, encoder, "new", now=now)
    content = lambda table: sorted((r.document_id, r.chunk_index, r.content, r.embedding_model) for r in table.collect())
    assert content(after[1]) == content(whole[1])
    assert sorted(after[0].collect()) == sorted(whole[0].collect())
    assert after[1].select("id").distinct().count() == after[1].count()
