"""The pipeline as a whole: every stage against a plain version on what the stage before it kept."""

import collections
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_tables import plain_targets
from test_text_models import plain_line_dedup, same

from quarrylamp.llm import classifier
from quarrylamp.llm.queries import tokenizer_file


def plain_scores(rows, labels, size=256, width=0.7, penalty=1.0, seed=7):
    """Scores of (doc_id, text) rows: the whole chain in one place, isotonic means by their definition."""
    x = np.array([classifier.statistics(t) for _, t in rows])
    features = classifier.Features(x.mean(0), x.std(0), size, width, seed)
    z = features(x)
    chosen = [(k, y) for k, (d, _) in enumerate(rows) for i, y in labels if d is not None and i == d and brute.remainder(d, 5)]
    at, y = np.array([k for k, _ in chosen]), np.array([float(y) for _, y in chosen])
    half = np.array([brute.remainder(rows[k][0], 5) % 2 for k in at])

    def fit(which):
        part = z[at[which]]
        return classifier._ridge(part.T @ np.hstack([part, y[which][:, None]]), penalty)

    models = fit(half == 0), fit(half == 1)
    raw = np.array([z[k] @ models[1 - h] for k, h in zip(at, half)])
    bins = np.clip(np.floor((raw - classifier.LOW) * classifier.BINS / 3), 0, classifier.BINS - 1)
    used = np.unique(bins)
    n, total = np.array([[(bins == b).sum(), y[bins == b].sum()] for b in used]).T
    mean = lambda a, b: total[a : b + 1].sum() / n[a : b + 1].sum()
    level = [max(min(mean(a, b) for b in range(k, len(used))) for a in range(k + 1)) for k in range(len(used))]
    level = np.round(level, 12)
    centres = (used + 0.5) * 3 / classifier.BINS + classifier.LOW
    values = np.unique(level)
    knots = [centres[level == v].mean() for v in values]
    return np.clip(np.interp(z @ fit(np.full(len(y), True)), knots, values), 0, 1)


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """Labels, and the documents before and after each stage of one run."""
    folder = tmp_path_factory.mktemp("pipeline")
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    copies = documents.filter("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 5000)
    edited = documents.filter("doc_id % 7 = 0").select(
        *(F.concat("text", F.lit(" one more end")).alias(c) if c == "text" else
          (F.col(c) + 7000).alias(c) if c == "doc_id" else c for c in documents.columns)
    )
    odd = spark.createDataFrame(brute.ODD, "doc_id long, text string")
    long_text = spark.createDataFrame([(960, " ".join(f"word{k % 5003} and" for k in range(90_000)))], odd.schema)
    table = documents.unionByName(copies).unionByName(edited).unionByName(odd.unionByName(long_text), allowMissingColumns=True)
    table.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")

    seen, keep = [spark.read.parquet(f"{folder}/documents.parquet")], corpus_pipeline.stored
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "stored", lambda docs: seen.append(keep(docs)) or seen[-1])
        seen.append(corpus_pipeline.run(spark, str(folder)))
    assert [name for name, _ in corpus_pipeline.STAGES][0::4] == ["quality classifier", "best-fit packing"]
    assert all(step.columns == table.columns for step in seen[:-1])
    labels = [tuple(r) for r in spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect()]
    return labels, [[r.asDict() for r in step.collect()] for step in seen]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def test_rejected_documents_go(steps):
    labels, (before, after, *_) = steps
    rows = pairs(before)
    score = plain_scores(rows, labels)
    best = collections.defaultdict(float)
    for (doc, _), s in zip(rows, score):
        best[doc] = max(best[doc], s)
    assert not any(abs(s - 0.3) < 1e-9 for s in best.values())
    same(pairs(after), [r for r in rows if r[0] is None or best[r[0]] >= 0.3])
    assert 0 < len(after) < len(before)


def test_recurring_lines_go(steps):
    _, (_, before, after, *_) = steps
    want = [(doc, text) for doc, text, *_ in plain_line_dedup(pairs(before))]
    same(pairs(after), want)
    assert sum(len(t or "") for _, t in want) < sum(len(r["text"] or "") for r in before)


def test_one_of_each_group_stays(steps):
    _, (_, _, before, after, *_) = steps
    named = [r["doc_id"] for r in after if r["doc_id"] is not None]
    assert sorted(named) == sorted(brute.alike([r for r in pairs(before) if r[0] is not None]))
    assert len(named) < len(before)


def test_sources_come_near_their_targets(steps):
    _, (_, _, _, before, after, _) = steps
    size = lambda r: len(brute.words(r["text"]))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before:
        sizes[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    whole = max(map(size, before))
    for source, aim in plain_targets({s: n for s, n in sizes.items()}).items():
        assert abs(taken[source] - aim) <= max(0.05 * aim, whole)
    texts = {(r["doc_id"], r["text"]) for r in before}
    turns = collections.Counter(pairs(after))
    assert set(turns) <= texts and max(n for (doc, _), n in turns.items() if doc is not None) <= 3


def test_everything_mixed_is_packed(steps):
    from tokenizers import Tokenizer

    _, (*_, before, after) = steps
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = collections.Counter()
    for doc, text in pairs(before):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, first in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[first : first + 4096], "<u4")
            want[doc, piece, first, len(part), zlib.crc32(part.tobytes())] += 1
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert collections.Counter(tuple(r[c] for c in names) for r in after) == want
    sequences = collections.defaultdict(list)
    for r in after:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
