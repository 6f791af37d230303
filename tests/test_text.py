import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarrylamp.operators import chunking, textmatch
from quarrylamp.operators.english import english_lexicon
from quarrylamp.operators.postings import build_postings, positions

DOCS = {1: "a x b a b", 2: "b a", 3: "a c", 4: "c d e", 5: ""}


def ranks(spark, docs, queries, units=True, **options):
    df = spark.createDataFrame(list(docs.items()), "id long, content string")
    asked = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    postings = build_postings(df, "id", {"content": "D"}, **options)
    found = textmatch.match_and_rank(
        postings, textmatch.query_literals(asked, **options),
        df.select(F.col("id").alias("unit_id")) if units else None,
    )
    return {(r.query_id, r.unit_id): r.text_rank for r in found.collect()}


def brute_rank(words, groups, weight=0.1):
    """Shortest stretches by trying all of them; groups are lists of single words."""
    asked = {w for g in groups for w in g}
    if not any(all(w in words for w in g) for g in groups):
        return None

    def satisfied(i, j):
        return any(all(w in words[i : j + 1] for w in g) for g in groups)

    spans = [(i, j) for i, j in itertools.combinations_with_replacement(range(len(words)), 2)
             if satisfied(i, j)]
    minimal = [s for s in spans
               if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    total = 0.0
    for i, j in minimal:
        inside = sum(w in asked for w in words[i : j + 1])
        total += weight / (1 + (j - i + 1 - inside))
    return total / (total + 1)


def test_match_forms(spark):
    found = ranks(spark, DOCS, {1: "a b", 2: '"a b"', 3: "d or b", 4: "a -c", 5: "-a", 6: " "})
    matched = {q: {u for (k, u) in found if k == q} for q in range(1, 7)}
    assert matched == {1: {1, 2}, 2: {1}, 3: {1, 2, 4}, 4: {1, 2}, 5: {4, 5}, 6: set()}
    assert found[(5, 4)] == 0.0


def test_cover_rank_by_hand(spark):
    # Covers of "a b": positions 1..3 (one other word), 3..4 and 4..5.
    total = 0.1 / 2 + 0.1 + 0.1
    found = ranks(spark, DOCS, {1: "a b"})
    assert found[(1, 1)] == pytest.approx(total / (total + 1))


def test_cover_rank_equals_brute_force(spark):
    rng = random.Random(3)
    docs = {i: " ".join(rng.choices("abcdefg", k=rng.randint(1, 25))) for i in range(40)}
    forms = {1: [["a"]], 2: [["a", "b"]], 3: [["a", "b", "c"]], 4: [["a"], ["b", "c"]],
             5: [["a", "d"], ["b", "c", "e"]]}
    queries = {q: " or ".join(" ".join(g) for g in groups) for q, groups in forms.items()}
    found = ranks(spark, docs, queries)
    expected = {}
    for q, groups in forms.items():
        for d, content in docs.items():
            rank = brute_rank(content.split(), groups)
            if rank is not None:
                expected[(q, d)] = pytest.approx(rank)
    assert found == expected


def test_stop_words_keep_their_place(spark):
    docs = {1: "running of the wolves", 2: "running wolves"}
    found = ranks(spark, docs, {1: '"run of the wolf"', 2: "the", 3: "runs"},
                  lexicon=english_lexicon)
    assert {k for k in found} == {(3, 1), (3, 2)}
    found = ranks(spark, docs, {1: '"running of the wolves"'}, lexicon=english_lexicon)
    assert set(found) == {(1, 1)}


def test_field_positions_continue(spark):
    df = spark.createDataFrame([(1, "x y", "z")], "id long, title string, description string")
    rows = positions(build_postings(df, "id", {"title": "A", "description": "B"})).collect()
    assert {(r.lexeme, r.pos, r.weight) for r in rows} == {
        ("x", 1, "A"), ("y", 2, "A"), ("z", 3, "B")
    }


def windows(spark, content, size, overlap):
    df = spark.createDataFrame([(1, content)], "id long, content string")
    return [r.content for r in chunking.chunk(df, "content", size, overlap)
            .orderBy("chunk_index").collect()]


def test_chunking(spark):
    text = "slate chalk marl flint clay loam sand"
    assert windows(spark, text, 5, 2) == ["slate chalk marl flint clay", "flint clay loam sand"]
    assert windows(spark, text, 3, 0) == ["slate chalk marl", "flint clay loam", "sand"]
    assert windows(spark, "slate chalk", 5, 2) == ["slate chalk"]
    assert windows(spark, "\t", 5, 2) == ["\t"]
    with pytest.raises(ValueError):
        chunking.token_windows(F.lit("x"), 2, 3)


@pytest.mark.parametrize(
    "stored,on,expected",
    [
        ([("a b c d e f g h", "legacy")], True, ["a b c d e", "d e f g h"]),
        ([("a b", "first"), ("b c d", "first"), ("d e", "first")], True, ["a b", "b c d", "d e"]),
        ([("a b c d e f g", "legacy")], False, ["a b c d e f g"]),
    ],
)
def test_rechunk(spark, stored, on, expected):
    rows = [(1, i, c, m) for i, (c, m) in enumerate(stored)]
    chunks = spark.createDataFrame(
        rows, "document_id long, chunk_index int, content string, embedding_model string"
    )
    found = chunking.rechunk(chunks, 5, 2, on).orderBy("chunk_index").collect()
    assert [r.content for r in found] == expected


def test_posting_lists_are_gaps_per_unit(spark):
    rows = [(k, f"w{k % 3} common " * (k % 5), None if k % 4 else "common tail") for k in range(40)] + [(None, "lost", "lost")]
    df = spark.createDataFrame(rows, "id long, title string, content string").withColumn("gaps", F.lit("x"))
    want = set()
    for k, title, content in rows[:-1]:
        words = [(w, "A") for w in title.split()] + [(w, "C") for w in (content or "").split()]
        want |= {(k, w, at, weight) for at, (w, weight) in enumerate(words, 1)}
    plain = build_postings(df, "id", {"title": "A", "content": "C"})
    assert {tuple(r) for r in positions(plain).collect()} == want
    one = plain.filter("unit_id = 4 and lexeme = 'common'").first()
    assert one.gaps == [2, 2, 2, 2, 1] and one.weights == "AAAAC"
    assert plain.groupBy("unit_id", "lexeme").count().filter("count > 1").count() == 0


def test_fold_takes_many_pairs_in_parts(spark):
    import pyarrow as pa

    from quarrylamp.operators.covers import fold_batches
    from quarrylamp.operators.textmatch import WEIGHTS

    plan = '[{"group_no":0,"literal_no":0,"lexemes":[{"lexeme":"a","offset":0}],"negated":false},' \
        '{"group_no":0,"literal_no":1,"lexemes":[{"lexeme":"b","offset":0}],"negated":false}]'
    hits = [[{"lexeme": "a", "gaps": [1 + k, 5], "weights": "DD"}, {"lexeme": "b", "gaps": [3 + k], "weights": "D"}] for k in range(50)]
    kind = pa.list_(pa.struct([("lexeme", pa.string()), ("gaps", pa.list_(pa.int32())), ("weights", pa.string())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1] * 50), pa.array(range(50)), pa.array(hits, kind), pa.array([plan] * 50)],
        ["query_id", "unit_id", "hits", "plan"],
    )
    whole, parts = (pa.Table.from_batches(fold_batches(WEIGHTS, n)(iter([batch]))).to_pylist() for n in (1 << 20, 7))
    assert whole == parts and len({r["text_rank"] for r in whole}) == 1
    words = "a x b x x a".split()
    assert whole[0]["text_rank"] == brute_rank(words, [["a", "b"]])


def test_lists_are_packed_before_they_are_gathered():
    import numpy as np
    import pyarrow as pa

    from quarrylamp.operators import covers

    numbers = np.array([0, 1, 127, 128, 16383, 16384, 1 << 21, (1 << 28) - 1, 1 << 28, (1 << 31) - 1, 5])
    raw, taken = covers._packed(numbers)
    assert covers._unpacked(raw).tolist() == numbers.tolist() and taken.tolist() == [1, 1, 1, 2, 2, 3, 4, 4, 5, 5, 1]
    # Unit 7 has its lists apart, one without a place; unit 9 a far place.
    units, codes = [7, 9, 7, 7, None], [3, 300, 1, 2, 0]
    gaps, weights = [[1, 2, 200], [70_000], [4], [], [6]], ["ABA", "D", "C", "", "B"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(units, pa.int64()), pa.array(codes, pa.int32()), pa.array(gaps, pa.list_(pa.int32())), pa.array(weights)],
        ["unit_id", "code", "gaps", "weights"],
    )
    rows = pa.Table.from_batches(covers.pack_hits(iter([batch]))).combine_chunks()
    assert rows.column("unit_id").to_pylist() == [7, 9, None]
    one = pa.array([[{c: r[c] for c in covers.PACKED}] for r in rows.to_pylist()],
                   pa.list_(pa.struct([(c, pa.binary()) for c in covers.PACKED])))
    inverse = np.zeros(256)
    inverse[[ord(c) for c in "ABCD"]] = 1, 2, 3, 4
    found = covers._Lists(pa.RecordBatch.from_arrays([one], ["hits"]), inverse, 301)
    got = list(zip(found.unit.tolist(), found.pos.tolist(), found.code.tolist(), found.inverse.tolist()))
    assert got == [(0, 1, 3, 1), (0, 3, 3, 2), (0, 4, 1, 3), (0, 203, 3, 1), (1, 70_000, 300, 4), (2, 6, 0, 2)]
    assert sum(rows.column(c).nbytes for c in covers.PACKED) < batch.nbytes
