"""Byte-level BPE against the tiktoken library and exact round trips."""

import base64
import hashlib
import random

import brute
import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylamp.llm import bytebpe
from quarrylamp.llm.queries import op13_bytebpe, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bytebpe.vocabulary(PATH)
CLASSES = bytebpe.code_point_classes()

#: Characters that meet in every way: blanks of many kinds, apostrophes, endings, numbers, marks.
LETTERS = "''''strevlmdSLx  \n\t 　\x1c\x85\0 1½٣é漢ª!?-😀​"


def encoded(texts):
    ids, ends, counts = bytebpe.encode_texts(texts, OWN, CLASSES)
    stops = np.cumsum(counts)
    return [(ids[s - c : s].tolist(), ends[s - c : s].tolist()) for s, c in zip(stops, counts)]


def check(texts):
    for text, (ids, ends) in zip(texts, encoded(texts), strict=True):
        assert ids == LIBRARY.encode_ordinary(text), text
        assert ends == np.cumsum([len(LIBRARY.decode_single_token_bytes(i)) for i in ids]).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS), max_size=30) | st.text(max_size=20).filter(lambda t: t.isprintable()), max_size=8))
def test_same_ids_as_the_library(texts):
    check(texts or [""])


def test_starts_are_those_of_the_pattern():
    draw = random.Random(3)
    ascii_only = "''strevlmdSL  \n\t1!?-"
    for _ in range(3000):
        text = "".join(draw.choice(ascii_only) for _ in range(draw.randint(1, 25)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        want = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]
        assert bytebpe.piece_starts(points, np.empty(0, np.int64), CLASSES).tolist() == want, text


@pytest.mark.parametrize("block", [1, 3, 64, 512])
def test_scan_equals_one_step_after_another(block):
    kinds = np.random.default_rng(block).integers(0, 9, 1000).astype(np.uint8)
    state, want = bytebpe.FRESH, []
    for kind in kinds:
        want.append(state)
        state = bytebpe.AFTER[kind, state]
    assert bytebpe.states(kinds, block).tolist() == want


def test_long_pieces():
    draw = random.Random(7)
    check(["a" * 200_000, " " * 70_000 + "x", "".join(draw.choice("abcdeiou") for _ in range(60_000)), "ab" * 40_000 + "\n" * 999])
    pieces = ["".join(draw.choice("etaoin") for _ in range(n)).encode() for n in range(2, 300)]
    assert OWN._merge_short(pieces) == [OWN._merge_long(piece) for piece in pieces]


def test_table_of_pieces_starts_anew(monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE", 5)
    known = bytebpe.Vocabulary(PATH)
    texts = ["one two three four five six seven eight nine ten"] * 3
    ids, _, _ = bytebpe.encode_texts(texts, known, CLASSES)
    assert ids.tolist() == LIBRARY.encode_ordinary(texts[0]) * 3 and len(known.merged) <= 5


def digests(doc, text):
    ids = LIBRARY.encode_ordinary(text or "")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return doc, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_round_trip_of_documents(spark, table):
    rows = [tuple(r) for r in table("documents").select("doc_id", "text").collect()] + brute.ODD
    rows += [(950, "<|endoftext|> it's we'll \r\n\n x"), (951, "😀" * 5000), (952, "é" * 9), (953, "word's " * 250_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("ends", F.lit(1))
    out = bytebpe.encode(frame, PATH)
    assert out.columns == ["doc_id", "ids", "ends"]
    got = bytebpe.digests(bytebpe.decode(out, PATH)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((digests(*r) for r in rows), key=str)
    none = frame.limit(0)
    assert bytebpe.digests(bytebpe.decode(bytebpe.encode(none, PATH), PATH)).count() == 0


def test_whole_table(spark, sf):
    want = [digests(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_bytebpe(spark, sf).collect())) == sorted(want)


def test_places_that_do_not_fit_raise(spark):
    wrong = spark.createDataFrame([(1, [5, 6], [1, 9])], "doc_id long, ids array<int>, ends array<int>")
    with pytest.raises(Exception, match="do not belong together"):
        bytebpe.decode(wrong, PATH).collect()
