"""SimHash near-duplicates: 64-bit fingerprints compared bit plane by bit plane.

A fingerprint bit is set when more than half of a text's word-shingle hashes have it.  Equal
fingerprints are grouped first, so copies cost one row.  Two fingerprints within radius r of
64 bits cut into m bands agree on at least m - r whole bands; each choice of m - r bands is a
table of buckets, and every linked pair meets in one of them.  Inside a bucket the candidates
are held as bit planes (one machine word of candidates per bit and block); a query updates all
distances of a block with carry-save counters and leaves it as soon as all exceed the radius.

For similarity in the usual sense (word shingles, Jaccard) a small radius is too strict and a
large one cannot be banded without loss.  `similar_groups` therefore takes more bits, over single
words, buckets them in many tables, compares prints within a bucket as above, and lets an exact
comparison of the shingles decide.  What the buckets leave apart meets by exact prefixes: texts of
similarity t share one of the first (1 - t) of their shingles in any order that all texts keep.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, slices, stored
from quarrylamp.llm.components import connected_components

BITS = 64


def _tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task after which its worker keeps no freed memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        give_back()

    return run


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text as an unsigned number; zero where there is no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(s, seed) for s in shingles), "<u8")
    sums = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 14):
        part = hashes[first : first + (1 << 14)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = np.array(
                [fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], "<u8"
            ).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "print"]
            )

    return run


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, print): the fingerprint of every row as a signed 64-bit number."""
    return documents.select("doc_id", "text").mapInArrow(
        _fingerprints(words, seed), "doc_id long, print long"
    )


def close_pairs(prints: np.ndarray, radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of distinct unsigned prints that differ in 1 to `radius` bits.

    Candidates are held in blocks of `block` as BITS planes; candidate j is bit j of a plane.
    For each query, plane XOR query bit is added to saturating carry-save counters; `over`
    marks candidates beyond the radius, and a block all over is left early.
    """
    left, right = [], []
    n = len(prints)
    for first in range(0, n, block):
        part = prints[first : first + block]
        bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes = [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(BITS)]
        full = (1 << len(part)) - 1
        # Bits on which the whole block agrees (those of the bucket) say nothing within it.
        varying = [b for b in range(BITS) if planes[b] not in (0, full)]
        fixed = [b for b in range(BITS) if planes[b] in (0, full)]
        for q in range(min(first + len(part), n)):
            value = int(prints[q])
            # Distance on agreeing bits is the same for all candidates: count it once.
            base = sum(1 for b in fixed if (planes[b] != 0) != bool(value >> b & 1)) if q < first else 0
            if base > radius:
                continue
            near = _within(planes, varying, full, value, radius - base)
            if q >= first:
                near &= ~((1 << (q - first + 1)) - 1)
            while near:
                low = near & -near
                j = first + low.bit_length() - 1
                left.append(q)
                right.append(j)
                near ^= low
    return np.array(left, np.int64), np.array(right, np.int64)


def _within(planes: list[int], bits: range | list[int], full: int, value: int, limit: int) -> int:
    """Candidates (as bits) whose planes differ from `value` in at most `limit` of `bits`."""
    counters = [0] * (limit.bit_length() + 1)
    over = 0
    for b in bits:
        carry = planes[b] ^ full if value >> b & 1 else planes[b]
        for s in range(len(counters)):
            counters[s], carry = counters[s] ^ carry, counters[s] & carry
            if not carry:
                break
        over |= carry
        for s in range(len(counters)):
            if not limit >> s & 1:
                over |= _above(counters, limit, s, full)
        if over == full:
            break
    return full & ~over


def _above(counters: list[int], limit: int, stage: int, full: int) -> int:
    """Candidates whose counter exceeds `limit` first at bit `stage` (equal above it)."""
    found = counters[stage]
    for s in range(stage + 1, len(counters)):
        found &= counters[s] if limit >> s & 1 else full & ~counters[s]
    return found


def _pairs(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def finish() -> pa.RecordBatch | None:
            prints = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            if len(prints) < 2:
                return None
            i, j = close_pairs(prints.view(np.uint64), radius)
            if not len(i):
                return None
            return pa.RecordBatch.from_arrays([pa.array(prints[i]), pa.array(prints[j])], ["a", "b"])

        # Rows come sorted by bucket; a bucket may run over several batches.
        for batch in batches:
            key = np.stack([batch.column("choice").to_numpy(), batch.column("bucket").to_numpy()], 1)
            prints = batch.column("print").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            starts = [0, *cuts.tolist()]
            ends = [*cuts.tolist(), len(prints)]
            for s, e in zip(starts, ends) if len(prints) else ():
                if s or held_key is None or tuple(key[0]) != held_key:
                    if (done := finish()) is not None:
                        yield done
                    held_key, held = tuple(key[s]), []
                held.append(prints[s:e])
        if (done := finish()) is not None:
            yield done

    return run


def _band_masks(bands: int) -> list[int]:
    edges = [round(k * BITS / bands) for k in range(bands + 1)]
    return [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(bands)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(distinct: DataFrame, radius: int = 2, bands: int = 5) -> DataFrame:
    """(a, b): all pairs of distinct prints that differ in 1 to `radius` bits.

    Each print goes to one bucket per choice of bands - radius bands.  Only buckets with two
    or more prints are compared.
    """
    masks = _band_masks(bands)
    choices = [
        _signed(sum(masks[k] for k in chosen)) for chosen in combinations(range(bands), bands - radius)
    ]
    buckets = distinct.select(
        "print",
        F.explode(
            F.array(*(
                F.struct(F.lit(n).alias("choice"), F.col("print").bitwiseAND(F.lit(m)).alias("bucket"))
                for n, m in enumerate(choices)
            ))
        ).alias("at"),
    ).select("print", "at.choice", "at.bucket")
    return (
        buckets.repartition("choice", "bucket")
        .sortWithinPartitions("choice", "bucket")
        .mapInArrow(_pairs(radius), "a long, b long")
        .distinct()
    )


def near_duplicates(
    documents: DataFrame, words: int = 3, radius: int = 2, bands: int = 5, seed: int = 42
) -> DataFrame:
    """(doc_id, print, component_id) for every row of `documents` (doc_id, text, ...).

    component_id is the smallest doc_id reached over chains of prints that differ in at most
    `radius` bits.  Null, empty and blank texts have print 0 and link like any other.  Repeated
    rows stay repeated; a null doc_id gets its component's smallest id, null if there is none.
    Other columns are ignored.  An empty table gives an empty one.
    """
    prints = stored(fingerprints(documents, words, seed))
    distinct = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("print"), radius, bands))
    classed = distinct.join(roots, distinct["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = classed.join(least, "root").select("print", "component_id")
    return prints.join(member, "print").select("doc_id", "print", "component_id")


def hex_print(print_: Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


#: Similarity search: bits of all prints of a text, cut into tables of so many bits each.
PRINTS, TABLE_BITS = 12, 24
_MIXERS = np.random.default_rng(5).integers(1, 1 << 62, PRINTS, np.uint64) * np.uint64(2) + np.uint64(1)


def word_prints(tokens: list[bytes], seed: int = 42) -> np.ndarray:
    """PRINTS fingerprints over the different words of a text; few edits change few bits."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in set(tokens)), np.uint64)
    sums = np.zeros((PRINTS, BITS), np.int64)
    for first in range(0, len(hashes), 1 << 10):
        mixed = hashes[None, first : first + (1 << 10)] * _MIXERS[:, None]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(*mixed.shape, 8), axis=2, bitorder="little")
        sums += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * sums > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: its word sequence as a digest, one print, and its bucket in every table."""
    tables = PRINTS * BITS // TABLE_BITS
    for batch in slices(batches, "text"):
        classes, prints, keys = [], [], []
        for text in batch.column("text").to_pylist():
            tokens = _tokens(text)
            own = word_prints(tokens)
            bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(tables, TABLE_BITS)
            buckets = bits.astype(np.int64) @ (1 << np.arange(TABLE_BITS, dtype=np.int64))
            classes.append(_class(tokens))
            prints.append(int(own[:1].view(np.int64)[0]))
            keys.append(buckets + (np.arange(tables) << TABLE_BITS))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(classes, pa.binary()), pa.array(prints, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            ["doc_id", "class", "print", "keys"],
        )


def _leaders(radius: int):
    """Link every member of a bucket to the leaders within the radius; without any it leads.

    A bucket gives at most a few links a member, however many members it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders, ids, planes = None, [], [], [0] * BITS
        for batch in batches:
            left, right = [], []
            columns = (batch.column(c).to_pylist() for c in ("key", "print", "id"))
            for own_key, print_, id_ in zip(*columns):
                if own_key != key:
                    key, leaders, ids, planes = own_key, [], [], [0] * BITS
                value = print_ & ((1 << BITS) - 1)
                if len(leaders) <= BITS:
                    near = [k for k, other in enumerate(leaders) if (value ^ other).bit_count() <= radius]
                else:
                    mask = _within(planes, range(BITS), (1 << len(leaders)) - 1, value, radius)
                    near = [k for k in range(len(leaders)) if mask >> k & 1] if mask else []
                if near:
                    left += [ids[k] for k in near]
                    right += [id_] * len(near)
                    continue
                for b in range(BITS):
                    planes[b] |= (value >> b & 1) << len(leaders)
                leaders.append(value)
                ids.append(id_)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def shingles(tokens: list[bytes], words: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the `words`-word shingles; one under `words` tokens."""
    n = len(tokens)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    size = min(words, n)
    made = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        made = made * np.uint64(0x9E3779B97F4A7C15) + each[k : n - size + 1 + k]
    made ^= made >> np.uint64(31)
    made *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(made ^ (made >> np.uint64(29)))


def _tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _class(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, sets = [], []
            columns = (batch.column(c).to_pylist() for c in ("id", "class", "text"))
            for id_, class_, text in zip(*columns):
                if _class(tokens := _tokens(text)) == class_:
                    ids.append(id_)
                    sets.append(shingles(tokens, words).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


#: Cells that count shingles, rows of one message of counts, and members of a shingle compared in one task.
CELLS, CELL_ROWS, MEMBERS = 1 << 21, 1 << 15, 1 << 13


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text"):
            found = [_cells(shingles(_tokens(t), words)) for t in batch.column("text").to_pylist()]
            counts += np.bincount(np.concatenate(found), minlength=CELLS)
        for part, some in enumerate(counts.reshape(-1, CELL_ROWS)):
            at = np.flatnonzero(some)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()),
                        pa.array([some[at].astype("<i8").tobytes()], pa.binary()),
                    ],
                    ["part", "at", "n"],
                )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the counts of all tasks; a task holds the parts dealt to it, whatever their messages."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, at, n in zip(*(batch.column(c).to_pylist() for c in ("part", "at", "n"))):
            total = sums.setdefault(part, np.zeros(CELL_ROWS, np.int64))
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
    for part, total in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "n"]
        )


def _heat(documents: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell: a byte that grows with the count of its shingles, and blocks to deal them over.

    Both only order and spread work; any values give the same links.
    """
    sums = (
        documents.select("text").mapInArrow(_tidy(_counts(words)), "part int, at binary, n binary")
        .repartition("part").mapInArrow(_tidy(_summed), "part int, n binary")
    )
    counts = np.zeros((CELLS // CELL_ROWS, CELL_ROWS), np.int64)
    for part, n in sums.toLocalIterator():
        counts[part] = np.frombuffer(n, np.int64)
    counts = counts.ravel()
    extra = np.maximum(0, counts - 2 * int(counts.mean()))
    heat = np.minimum(255, np.round(6 * np.log2(counts + 1))).astype(np.uint8)
    return heat, np.minimum(1 + extra // MEMBERS, (1 << 15) - 1).astype(np.int16)


PREFIX = "key long, root long, id long, size int, at int, side byte"


def _prefixes(words: int, least: float, heat: np.ndarray, blocks: np.ndarray):
    """The first shingles of every text, rarest first: two texts of similarity `least` share one.

    A frequent shingle's texts are dealt over blocks, and every two blocks meet under one key.
    """
    mix = np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            made: list[list[np.ndarray]] = [[] for _ in range(6)]
            columns = (batch.column(c).to_pylist() for c in ("id", "root", "class", "text"))
            for id_, root, class_, text in zip(*columns):
                if _class(tokens := _tokens(text)) != class_:
                    continue
                own = shingles(tokens, words)
                n = len(own)
                cells = _cells(own)
                order = np.argsort(
                    (heat[cells].astype(np.uint64) << np.uint64(56)) | (own >> np.uint64(8)), kind="stable"
                )[: n - math.ceil(least * n - 1e-9) + 1]
                key, count, at = own[order], blocks[cells[order]].astype(np.int64), np.arange(len(order))
                side = np.zeros(len(key), np.int8)
                if (count > 1).any():
                    copy = np.repeat(np.arange(len(key)), count)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(count) - count, count)
                    block = ((xxhash.xxh3_64_intdigest(b"%d" % id_) >> 2) % count)[copy]
                    low, high = np.minimum(block, other).astype(np.uint64), np.maximum(block, other).astype(np.uint64)
                    side = np.where(block == other, 0, np.where(block < other, 1, 2)).astype(np.int8)
                    key, at = key[copy] + (low * mix + high) * mix, at[copy]
                for held, column in zip(made, (key, np.full(len(key), root), np.full(len(key), id_), np.full(len(key), n), at, side)):
                    held.append(column)
            if made[0]:
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int8)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(k)) for c, k in zip(made, kinds)],
                    ["key", "root", "id", "size", "at", "side"],
                )

    return run


def _meetings(least: float, limit: int = 1 << 16):
    """Pairs of different roots under one key that can still be alike, by sizes and places.

    Rows come sorted by key and root.  Rows of the last key are held, as it may go on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "root", "id", "size", "at", "side")]
            if not len(rows[0]):
                continue
            done = 0
            if held is not None:
                done = len(held[0])
                rows = [np.concatenate(x) for x in zip(held, rows)]
            key, root, id_, size, at, side = rows
            n = len(key)
            new_key = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, n]
            end = new_key[np.searchsorted(new_key, np.arange(n), "right")]
            new_root = np.r_[np.flatnonzero((key[1:] != key[:-1]) | (root[1:] != root[:-1])) + 1, n]
            next_ = np.maximum(new_root[np.searchsorted(new_root, np.arange(n), "right")], done)
            i = np.flatnonzero(next_ < end)
            j = next_[i]
            found, waiting = [], 0
            while len(i):
                x, y = size[i].astype(float), size[j].astype(float)
                fits = np.minimum(x, y) >= least * np.maximum(x, y) - 1e-6
                # The first shingle that both have leaves room for all that they must share.
                rest = np.minimum(x - at[i], y - at[j])
                fits &= rest * (1 + least) >= least * (x + y) - 1e-6
                fits &= (side[i] == 0) | (side[i] != side[j])
                if fits.any():
                    found.append((i[fits], j[fits]))
                    waiting += len(found[-1][0])
                j = j + 1
                on = j < end[i]
                i, j = i[on], j[on]
                if found and (waiting >= limit or not len(i)):
                    yield _met(id_, root, *(np.concatenate(x) for x in zip(*found)))
                    found, waiting = [], 0
            keep = int(np.searchsorted(new_key, n - 1, "right"))
            first = int(new_key[keep - 1]) if keep else 0
            held = [x[first:].copy() for x in rows]

    return run


def _met(id_: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    i, j = np.where(id_[i] < id_[j], i, j), np.where(id_[i] < id_[j], j, i)
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (id_[i], id_[j], root[i], root[j])], ["a", "b", "root_a", "root_b"]
    )


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            # One pair at a time: lists of all sets of a batch would hold it once more.
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.drop_columns(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _own_texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of `wanted` (id, class, ...) among the rows of that id, every one once."""
    texts = documents.select(F.col("doc_id").alias("id"), "text").join(wanted, "id")
    return texts.groupBy(*texts.columns).agg(F.lit(1).alias("one")).drop("one")


def _checked(documents: DataFrame, pairs: DataFrame, named: DataFrame, words: int, least: float) -> DataFrame:
    """The rows of `pairs` (a, b, ...) whose texts have a similarity of at least `least`."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(
        _own_texts(documents, named.select("id", "class").join(asked, "id", "left_semi"))
        .mapInArrow(_tidy(_shingle_sets(words)), "id long, shingles binary")
    )
    kind = ", ".join(f"{c} long" for c in pairs.columns)
    return (
        pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        .select(*pairs.columns, "x", "y").mapInArrow(_tidy(_alike(least)), kind)
    )


def similar_groups(documents: DataFrame, words: int = 5, least: float = 0.8, radius: int = 16) -> DataFrame:
    """(doc_id, component_id): rows of `documents` (doc_id, text) by similarity of their shingles.

    Two texts are linked when their sets of `words`-word shingles have a Jaccard similarity of at
    least `least`; component_id is the smallest doc_id reached over chains of links.  Texts that
    share a bucket of SimHash bits with a leader within `radius` bits are linked first.  Every
    other linked pair is then found by shingle prefixes, so none is missed (shingles are compared
    by 64-bit hashes).  Texts under `words` words are one shingle.
    """
    documents = documents.filter("doc_id is not null").select("doc_id", "text")
    rows = stored(documents.mapInArrow(_tidy(_profiles), "doc_id long, class binary, print long, keys array<long>"))
    distinct = rows.groupBy("class").agg(
        F.min("doc_id").alias("id"), F.first("print").alias("print"), F.first("keys").alias("keys")
    )
    buckets = distinct.select("id", "print", F.explode("keys").alias("key"))
    pairs = stored(
        buckets.repartition("key").sortWithinPartitions("key", F.xxhash64("id", "key"))
        .mapInArrow(_tidy(_leaders(radius)), "a long, b long").filter("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    named = distinct.select("id", "class")
    roots = connected_components(_checked(documents, pairs, named, words, least)).toDF("id", "root")
    named = stored(named.join(roots, "id", "left").select("id", "class", F.coalesce("root", "id").alias("root")))
    prefixes = _own_texts(documents, named).mapInArrow(
        _tidy(_prefixes(words, least, *_heat(documents, words))), PREFIX
    )
    apart = stored(
        prefixes.repartition("key").sortWithinPartitions("key", "root")
        .mapInArrow(_tidy(_meetings(least)), "a long, b long, root_a long, root_b long").distinct()
    )
    joined = _checked(documents, apart, named, words, least).select(
        F.col("root_a").alias("a"), F.col("root_b").alias("b")
    )
    tops = connected_components(joined).toDF("root", "top")
    members = rows.select("doc_id", "class").join(named.select("class", "root"), "class")
    return members.join(tops, "root", "left").select("doc_id", F.coalesce("top", "root").alias("component_id"))


def keep_one(documents: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """Keep the row with the smallest doc_id of every group of similar texts; all columns stay.

    Groups are chains of links of `similar_groups`; texts without words are all alike.  Of rows
    that repeat the kept doc_id one stays.  A row without doc_id cannot be told from others and
    stays.  An empty table gives an empty one.
    """
    found = similar_groups(documents, words, least)
    kept = found.filter("doc_id = component_id").select("doc_id").distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))
    # Rows travel as one struct, so that no column can clash; the join leaves them sorted by
    # doc_id, so the window moves nothing.
    rows = documents.filter("doc_id is not null").select("doc_id", F.struct(*documents.columns).alias("row"))
    named = rows.join(kept.hint("merge"), "doc_id", "left_semi").withColumn("turn", turn).filter("turn = 1")
    return named.select("row.*").unionByName(documents.filter("doc_id is null"))
