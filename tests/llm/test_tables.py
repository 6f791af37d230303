"""Packing, classifier, voting rules, top-k search and mixing against plain versions."""

import collections
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylamp.llm import classifier, kdsearch, mixing, packing, votes
from quarrylamp.llm.queries import tokenizer_file

TEXT = "doc_id long, text string"


def placed(histogram, capacity, runs):
    """Check that runs place every piece once without gaps; the number of sequences."""
    seen, sequences = set(), collections.defaultdict(list)
    for r in runs:
        for k in range(r.count):
            assert (r.length, r.first + k) not in seen
            seen.add((r.length, r.first + k))
            sequences[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert collections.Counter(length for length, _ in seen) == {k: n for k, n in histogram.items() if n}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit(histogram, capacity):
    rooms, count = [], 0
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                room = min(fits)
                rooms.remove(room)
            else:
                room, count = capacity, count + 1
            rooms.append(room - length)
    return count


@pytest.mark.parametrize("low, high, n", [(1, 4096, 400), (700, 2500, 900), (1300, 1500, 300), (1, 60, 500), (4096, 4096, 5)])
def test_plan_packs_everything_well(low, high, n):
    draw = random.Random(n)
    histogram = collections.Counter(draw.randint(low, high) for _ in range(n))
    used = placed(histogram, 4096, packing.plan(dict(histogram), 4096))
    assert used <= best_fit(histogram, 4096)
    assert used >= -(-sum(k * c for k, c in histogram.items()) // 4096)


def test_plan_beats_best_fit_where_pairs_hide_triples():
    # Two sizes that best fit pairs up badly: 2 * 1900 leaves no room for 1000.
    histogram = {1900: 300, 1100: 600, 996: 300}
    assert placed(histogram, 4096, packing.plan(histogram, 4096)) <= best_fit(histogram, 4096)
    assert packing.plan({}, 4096) == []


def test_every_plan_is_a_grouped_one(monkeypatch):
    draw = random.Random(8)
    histogram = collections.Counter(min(4096, int(draw.lognormvariate(6.5, 1)) + 1) for _ in range(4000))
    solved = []
    real = packing.configurations

    def spy(sizes, demand, capacity, **options):
        found = real(sizes, demand, capacity, **options)
        solved.append((len(sizes), sum(often for often, _ in found)))
        return found

    monkeypatch.setattr(packing, "configurations", spy)
    used = placed(histogram, 4096, packing.plan(dict(histogram), 4096))
    assert len(solved) == len(packing.GROUPINGS) and all(sizes > 1 and often > 0.01 * used for sizes, often in solved)
    # Rounding up within groups costs at most a few sequences.
    assert used <= 1.01 * best_fit(histogram, 4096)
    for wrong in ((), ((0, 3),), ((128, 0),)):
        with pytest.raises(ValueError, match="group"):
            packing.plan(dict(histogram), 4096, wrong)


def test_pack(spark, table):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()] + brute.ODD
    rows += [(950, "<|endoftext|> Foo\x01bar's <|startoftext|>"), (951, "\x01"), (952, "Å ́ İ ΣΑΣ 漢字　かな ½"), (953, "word " * 9000)]
    out = packing.pack(spark.createDataFrame(rows, TEXT).withColumn("length", F.lit("x")), tokenizer_file()).collect()
    want = collections.Counter()
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, first in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[first : first + 4096], "<u4")
            want[doc, piece, first, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= 1.01 * sum(r.length for r in out) / 4096 + 2
    assert packing.pack(spark.createDataFrame([], TEXT), tokenizer_file()).count() == 0


def test_isotonic_means():
    level = classifier.pool_violators(np.array([1.0, 1, 2, 1]), np.array([0.0, 1, 0, 1]))
    assert level.tolist() == pytest.approx([0, 1 / 3, 1 / 3, 1])
    assert classifier.pool_violators(np.empty(0), np.empty(0)).size == 0


def test_ridge_is_solved():
    draw = np.random.default_rng(0)
    z, y = draw.normal(size=(80, 12)), draw.normal(size=80)
    sums = np.hstack([np.triu(z.T @ z), (z.T @ y)[:, None]])
    w = classifier._ridge(sums, 0.5)
    assert (z.T @ z + 0.5 * np.eye(12)) @ w == pytest.approx(z.T @ y)


def test_classifier_on_held_out_labels(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    documents, labels = read("documents"), read("labels")
    found = classifier.scores(documents, labels)
    judged = [tuple(r) for r in found.join(labels, "doc_id").filter("held_out").select("score", "quality").collect()]
    assert len(judged) > 50 and all(0 <= s <= 1 for s, _ in judged)
    assert np.mean([(s >= 0.3) == (q == 1) for s, q in judged]) > 0.95
    assert found.filter("held_out").count() == sum(
        brute.remainder(r.doc_id, 5) == 0 for r in documents.select("doc_id").collect()
    )
    # Labels of held-out rows and other columns are no input.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.scores(documents.withColumn("source", F.lit("x")).withColumn("lang", F.lit("x")), flipped)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, again.collect()))
    kept = classifier.reject(documents.withColumn("score", F.lit(1)), labels)
    assert kept.columns == [*documents.columns, "score"]
    assert kept.count() == found.filter("score >= 0.3").count()


def test_classifier_edges(spark):
    documents = spark.createDataFrame(brute.ODD, TEXT).withColumn("x", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.scores(documents, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1, 0) for k in range(900, 910)] + [(None, 0, 0), (905, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.scores(documents, one).collect()} == {1.0}
    both = spark.createDataFrame([(k, k % 2, 0) for k in range(900, 910)] * 2, "doc_id long, quality int, toxic int")
    assert classifier.scores(documents, both).count() == len(brute.ODD)
    assert classifier.scores(documents.limit(0), both).count() == 0
    assert classifier.reject(documents.limit(0), both).count() == 0


def test_rule_counts_and_verdicts(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()] + brute.ODD
    out = votes.quality(spark.createDataFrame(rows, TEXT).withColumn("words", F.lit(1)).withColumn("n_words", F.lit("x")))
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()), key=str)
    want = []
    for doc, text in rows:
        c = brute.rule_counts(text)
        want.append((doc is None, doc, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want, key=str)
    assert out.filter("base_failed and kept").count() == 0
    assert votes.quality(spark.createDataFrame([], TEXT)).count() == 0


def test_votes_agree_with_labels(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    judged = votes.quality(read("documents")).join(read("labels"), "doc_id").filter("not base_failed")
    rows = [(r.kept, r.quality == 1) for r in judged.select("kept", "quality").collect()]
    assert np.mean([k == q for k, q in rows]) > 0.95


def test_estimation_finds_a_careless_rule():
    draw = random.Random(4)
    patterns = collections.Counter()
    for _ in range(20000):
        good = draw.random() < 0.8
        vote = lambda right, p: (1 if good == (draw.random() < right) else -1) if draw.random() < p else 0
        patterns[vote(0.95, 0.9), vote(0.9, 0.9), vote(0.9, 0.8), vote(0.52, 0.9)] += 1
    bias, weights = votes.estimate(dict(patterns))
    gain = [w[1] - w[-1] for w in weights]
    assert min(gain[:3]) > 3 and abs(gain[3]) < 1
    assert votes.estimate({}) == (0.0, [])


def plain_top(vectors, queries, k):
    out = []
    for own, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), other) for other, v in vectors if other != own and len(v) == len(q))
        out += [(own, rank, other, -score) for rank, (score, other) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, leaf", [(1 << 17, 256), (60, 8)])
def test_top_k_is_exact(spark, table, shard_rows, leaf):
    vectors = kdsearch.whole_vectors(table("embeddings").withColumn("v", F.lit(1)).withColumn("shard", F.lit(1)))
    held = [(r.vec_id, r.v) for r in vectors.collect()]
    out = kdsearch.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, shard_rows, 3, leaf)
    assert sorted(map(tuple, out.collect())) == plain_top(held, [h for h in held if h[0] % 50 == 0], 5)


def test_top_k_edges(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [
        (0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, None]),
        (7, [float("inf"), 0.0]), (8, [-0.001, 0.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [0.25, 0.5]),
    ]
    vectors = kdsearch.whole_vectors(spark.createDataFrame(rows, schema))
    held = {r.vec_id: r.v for r in vectors.collect()}
    assert held[8] == [-1.0, 0.0] and set(held) == {0, 1, 2, 8, 9, 10, None}
    out = kdsearch.top_k(vectors, vectors, 3)
    items = [(k, v) for k, v in held.items() if k is not None]
    assert sorted(map(tuple, out.collect())) == plain_top(items, items, 3)
    assert kdsearch.top_k(vectors.limit(0), vectors, 3).count() == 0
    assert kdsearch.top_k(vectors, vectors.limit(0), 3).count() == 0


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: share * weight[s] for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}


def test_mix(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text", "source").collect()]
    rows += [(d, t, s) for (d, t), s in zip(brute.ODD, [None, None, "", "zé", "zé", "z", None, "Z", "tiny", None, "", "", "nul"])]
    rows += [(990, "only a few words", "few"), (991, None, "none at all")]
    documents = spark.createDataFrame(rows, TEXT + ", source string").withColumn("size", F.lit("x"))
    out = mixing.mix(documents).collect()
    assert len(out) == len(rows)
    want = collections.Counter((d, len(brute.words(t))) for d, t, _ in rows)
    assert collections.Counter((r.doc_id, r.size) for r in out) == want
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    sizes = collections.Counter()
    for d, t, s in rows:
        sizes[s] += len(brute.words(t))
    aims = plain_targets(dict(sizes))
    source_of = {d: s for d, _, s in rows if d is not None}
    taken = collections.Counter()
    for r in out:
        if r.doc_id is not None:
            source = source_of[r.doc_id]
            assert r.source_size == sizes[source]
            assert r.target == pytest.approx(aims[source])
            taken[source] += r.taken
    for source in set(source_of.values()) - {None}:
        assert taken[source] == pytest.approx(aims[source], rel=0.03, abs=3)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(documents.repartition(5)).collect()))
    copies = mixing.mixed(documents.withColumn("turn", F.lit(2)))
    assert copies.columns == [*documents.columns, "turn"]
    assert max(collections.Counter(r.doc_id for r in copies.collect() if r.doc_id not in (None, 903)).values()) <= 3
    assert mixing.mix(documents.limit(0)).count() == 0 and mixing.mixed(documents.limit(0)).count() == 0


def test_van_der_corput_points(spark):
    points = [r[0] for r in spark.range(8).orderBy("id").select(mixing.van_der_corput(F.col("id"))).collect()]
    assert points == [0, 1 / 2, 1 / 4, 3 / 4, 1 / 8, 5 / 8, 3 / 8, 7 / 8]


def test_schedule_spreads_slots(spark):
    shares = {"a": 300.0, None: 500.0, "c": 200.0}
    slots = mixing.schedule(spark.createDataFrame(list(shares.items()), "source string, slots double"), cells=16, span=64).collect()
    assert sorted(r.slot for r in slots) == list(range(1000))
    for source, n in shares.items():
        own = sorted((r.slot, r.turn) for r in slots if r.source == source)
        assert [t for _, t in own] == list(range(len(own)))
        assert abs(len(own) - n) <= 6
        # Every stretch of the schedule has its share.
        for first in range(0, 1000, 100):
            assert abs(sum(first <= s < first + 100 for s, _ in own) - n / 10) <= 7
