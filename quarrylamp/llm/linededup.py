"""Line dedup with a log-template tree of fixed depth.

A line goes down the tree by its token count, its leading token and a branch.  Its tokens are pieces
(a line of more than 16 is cut into 16 equal pieces); the pieces after the first are cut into runs,
and there is a branch for the content of each run.  On the way a piece with a digit is a wildcard.
A branch holds templates.  A line joins a template of its branch if three quarters of its pieces
agree with it (wildcards never count), so the other pieces are the template's variable fields; else
it opens a template of its own.  There are as many runs as fields are allowed plus one, so that one
run at least is free of fields, but four at most: fields in all four runs are not seen.

A line goes when it joins, in any of its branches, a template that an earlier document
(smaller doc_id) has opened, or when an earlier document has the same line.  Lines under five tokens
and lines with too few pieces without digits (rows of numbers) have no branch: they go only where the
same line comes again.  So each recurring template stays in the first document that has it.

Every task grows the tree of its own lines first and sends on what its own templates do not cover;
a template found everywhere is sent once a task.  Branches then meet by key, in order of documents,
and are merged by the same rule in a stream that holds only the templates of one branch.  A line may
join a template that another task's template covers in turn, so where templates form chains, which
of them stay depends on how the input is split.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, slices, whole_text

_DIGIT = re.compile(rb"\d")
#: Lines from this many tokens on have branches.
LEAST = 5
#: Pieces of a line at most, and the share of them that must agree with a template.
PIECES, AGREE = 16, 0.75
#: Branches of a line at most.
BRANCHES = 4
#: Bytes of a tag, the tag of a piece with a digit, and the one for a digest that looks like it.
WIDTH = 3
FIELD, OTHER = bytes(WIDTH), bytes(WIDTH - 1) + b"\1"
LAST = (1 << 63) - 1


def needed(pieces: int) -> int:
    """Pieces that must agree."""
    return math.ceil(AGREE * pieces)


@cache
def runs(pieces: int) -> list[tuple[int, int]]:
    """Bounds of the runs of the pieces after the first one."""
    number = min(BRANCHES, pieces - needed(pieces) + 1)
    edges = [1 + (pieces - 1) * k // number for k in range(number + 1)]
    return list(zip(edges, edges[1:]))


def _key(*parts: bytes) -> int:
    value = xxhash.xxh64_intdigest(b" ".join(parts))
    return value - (1 << 64) if value >> 63 else value


def paths(line: bytes) -> tuple[bytes, list[int]]:
    """Tags of a line's pieces, three bytes each, and its keys: of the whole line, then of its branches.

    The tag of a piece with a digit is FIELD.  No key for a line without a token.
    """
    tokens = line.split()
    n = len(tokens)
    if not n:
        return b"", []
    keys = [_key(b"%d" % n, *tokens)]
    if n < LEAST:
        return b"", keys
    lead, pieces = tokens[0], tokens
    if n > PIECES:
        edges = [n * k // PIECES for k in range(PIECES + 1)]
        pieces = [b" ".join(tokens[a:b]) for a, b in zip(edges, edges[1:])]
    tags = [xxhash.xxh32_digest(piece)[:WIDTH] for piece in pieces]
    if FIELD in tags:
        tags = [OTHER if tag == FIELD else tag for tag in tags]
    size = len(tags)
    if _DIGIT.search(line):
        fields = [k for k, piece in enumerate(pieces) if _DIGIT.search(piece)]
        if size - len(fields) < needed(size):
            return b"", keys
        pieces = pieces.copy()
        for k in fields:
            pieces[k], tags[k] = b"<*>", FIELD
        if _DIGIT.search(lead):
            lead = b"<*>"
    keys += [_key(b"%d %d" % (n, k), lead, *pieces[a:b]) for k, (a, b) in enumerate(runs(size))]
    return b"".join(tags), keys


def shown(tags: bytes, branch: int) -> bytes:
    """What a branch has to compare: how many pieces must agree outside its own run, and their tags.

    Nothing for branch 0, the whole line, as its key says all.
    """
    if not branch:
        return b""
    size = len(tags) // WIDTH
    a, b = runs(size)[branch - 1]
    own = b - a
    if FIELD in tags:
        own = sum(tags[k : k + WIDTH] != FIELD for k in range(a * WIDTH, b * WIDTH, WIDTH))
    return b"%c" % (needed(size) - own) + tags[: a * WIDTH] + tags[b * WIDTH :]


def joined(docs: np.ndarray, tags: list[bytes], templates: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Which lines of a branch, in order of documents, join a template of an earlier document.

    `tags` are as `shown` gives them; where that is nothing, all lines agree.  Lines that join none
    are added to `templates`.
    """
    least = tags[0][0] if tags[0] else 0
    parts = np.frombuffer(b"".join(tags), np.uint8).reshape(len(tags), len(tags[0]))[:, 1:]
    parts = parts.reshape(len(tags), -1 if parts.size else 0, WIDTH).astype(np.uint32)
    rows = parts[..., 0] | parts[..., 1] << 8 | parts[..., 2] << 16
    known = np.zeros(len(docs), bool)
    gone = np.zeros(len(docs), bool)

    def meet(owner: int, template: np.ndarray, start: int) -> None:
        agree = ((rows[start:] == template) & (template != 0)).sum(1) >= least
        known[start:] |= agree
        gone[start:] |= agree & (docs[start:] > owner)

    for owner, template in templates:
        meet(owner, template, 0)
    start = 0
    while not known[start:].all():
        start += int(np.argmin(known[start:]))
        templates.append((int(docs[start]), rows[start].copy()))
        meet(*templates[-1], start)
    return gone


_SENT = "key long, doc long, text_key long, line int, tags binary"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: lines that its own tree covers (tags null), and for all other keys the lines to merge."""
    keys, lined = [], []
    tags: list[bytes] = []
    docs: list[int] = []
    texts: list[int] = []
    for batch in slices(batches, "text"):
        own_keys: list[int] = []
        own_lines: list[tuple[int, int, int]] = []
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for number, line in enumerate(raw.split(b"\n")):
                tag, found = paths(line)
                if found:
                    own_keys += found
                    own_lines.append((len(found), len(docs), number))
                    tags.append(tag)
            docs.append(doc)
            value = xxhash.xxh64_intdigest(raw, 42)  # as Spark's xxhash64
            texts.append(value - (1 << 64) if value >> 63 else value)
        # As arrays: a Python number for every key and line would take several times as much.
        keys.append(np.array(own_keys, np.int64))
        lined.append(np.array(own_lines, np.int32).reshape(-1, 3))
    if not tags:
        return
    key = np.concatenate(keys)
    count, rows, number_of = np.concatenate(lined).T
    del keys, lined
    owner = np.repeat(np.arange(len(count)), count)
    branch = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
    doc_of, text_of = np.array(docs, np.int64)[rows], np.array(texts, np.int64)[rows]
    del docs, texts
    order = np.lexsort((number_of[owner], text_of[owner], doc_of[owner], key))
    key, owner, branch = key[order], owner[order], branch[order]
    doc = doc_of[owner]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    settled = np.zeros(len(count), bool)
    settled[owner[(branch == 0) & (doc > np.repeat(doc[starts], sizes))]] = True
    # A line that has come before joins what its like has joined, in every branch.
    covered = settled[owner]
    several = (branch[starts] > 0) & (doc[starts] < doc[starts + sizes - 1])
    for start, size in zip(starts[several], sizes[several]):
        some = np.arange(start, start + size)
        some = some[~covered[some]]
        if len(some) > 1:
            own = int(branch[start])
            covered[some] = joined(doc[some], [shown(tags[k], own) for k in owner[some].tolist()], [])
    settled[owner[covered]] = True

    sent = np.flatnonzero(~covered)
    for lines, at in ((np.flatnonzero(settled), None), (owner[sent], sent)):
        for first in range(0, len(lines), 1 << 14):
            some, part = lines[first : first + (1 << 14)], slice(first, first + (1 << 14))
            if at is None:
                their, content = np.zeros(len(some), np.int64), [None] * len(some)
            else:
                their = key[at[part]]
                content = [shown(tags[k], b) for k, b in zip(some.tolist(), branch[at[part]].tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(their), pa.array(doc_of[some]), pa.array(text_of[some]),
                    pa.array(number_of[some]), pa.array(content, pa.binary()),
                ],
                ["key", "doc", "text_key", "line", "tags"],
            )
    del tags, key, count, rows, number_of, owner, branch, order, doc_of, text_of, doc, covered, settled, sent
    give_back()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that go, of rows sorted by key and document."""
    last, templates = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        doc = batch.column("doc").to_numpy()
        gone = batch.column("tags").is_null().to_numpy(zero_copy_only=False).copy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        asked = sizes > 1
        asked[-1] = True  # the next batch may go on with its branch
        asked[0] |= key[0] == last
        for start, size in zip(starts[asked], sizes[asked]):
            if gone[start]:
                last = None
                continue
            if key[start] != last:
                last, templates = key[start], []
            part = slice(start, start + size)
            gone[part] = joined(doc[part], batch.column("tags").slice(start, size).to_pylist(), templates)
        yield batch.select(["doc", "text_key", "line"]).filter(pa.array(gone))
    give_back()


def recurring_lines(documents: DataFrame) -> DataFrame:
    """(doc, text_key, lines): line numbers (from 0) that recur from an earlier document."""
    named = documents.select(F.coalesce("doc_id", F.lit(LAST)).cast("long").alias("doc"), "text")
    grown = named.mapInArrow(_grow, _SENT)
    # Lines already settled are spread by themselves; the others meet by key.
    spread = F.when(F.col("tags").isNull(), F.xxhash64("doc", "text_key", "line")).otherwise(F.col("key"))
    met = grown.withColumn("key", spread).repartition("key").sortWithinPartitions("key", "doc", "text_key", "line")
    return (
        met.mapInArrow(_merge, "doc long, text_key long, line int")
        .groupBy("doc", "text_key").agg(F.collect_set("line").alias("lines"))
    )


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts, totals, gone = [], [], []
        for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist()):
            parts = (text or "").split("\n")
            drop = set(lines or ())
            texts.append("\n".join(p for k, p in enumerate(parts) if k not in drop) if drop else text)
            totals.append(len(parts) if text else 0)
            gone.append(len(drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column("rest"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
            ["rest", "text", "n_lines", "n_dropped"],
        )
    give_back()


def deduped(documents: DataFrame) -> DataFrame:
    """Every row of `documents` with its recurring lines taken out of `text`.

    Adds n_lines (before) and n_dropped; columns of these names are replaced.  Lines without a
    token always stay, as does what recurs only within one document.  Null and empty
    texts stay as they are (0 lines); a document may become empty.  Rows that share a doc_id
    count as one document.  Rows without doc_id come after all others and cannot recur among
    themselves.  Other columns stay, whatever their names; an empty table gives an empty one.
    """
    drops = recurring_lines(documents)
    names = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    rest = documents.select(*(c for c in names if c != "text"))
    whole = documents.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc"),
        F.xxhash64(whole_text()).alias("text_key"),
        F.struct(*rest.columns).alias("rest"),
        "text",
    )
    kind = rest.select(F.struct(*rest.columns).alias("rest")).schema["rest"].dataType.simpleString()
    return (
        whole.join(drops, ["doc", "text_key"], "left").select("rest", "text", "lines")
        .mapInArrow(_rebuild, f"rest {kind}, text string, n_lines long, n_dropped long")
        .select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in names), "n_lines", "n_dropped")
    )


def without_recurring(documents: DataFrame) -> DataFrame:
    """`documents` with its recurring lines taken out and n_chars, where there is one, set anew.

    Null and empty texts stay, ties and rows without doc_id count as in `deduped`; an empty table
    gives an empty one.
    """
    out = deduped(documents)
    changed = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")) if "n_chars" in documents.columns else None
    return out.select(*(
        changed.cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else c for c in documents.columns
    ))
