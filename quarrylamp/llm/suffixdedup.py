"""Removal of repeated byte strings over a sparse, distributed suffix array.

Every string of `length` bytes has one anchor: the place in it whose next `seed` bytes have the
smallest hash (the leftmost of equals).  Equal strings have their anchor at the same place, so it
is enough to sort the suffixes that begin at anchors, about one byte in thirty, and of these only
those whose seed occurs more than once.

1. Texts are packed into units (stretches of one scan task).  Each unit names its different seed
   hashes; hashes met once in all are dropped.
2. Units with the remaining hashes cut out each anchor's suffix and what stands before it (its
   context, all strings with this anchor).  Contexts that repeat within a unit are settled
   there; the others are sent as sorted, front-coded runs of suffixes, dealt out by seed,
   each run packed column by column into one row.
3. Runs are merged by a loser tree that never compares known prefixes again.  Suffixes that share
   a seed come out together: contexts that repeat are settled, and different contexts of one
   seed are compared string by string.
4. A seed met very often is not gathered in one place: its strings are dealt out one by one, by
   digest, each unit sending the earliest of those it has.
5. The removed stretches go back to the units, which cut them out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, stored
from quarrylamp.llm.losertree import common_prefix, merged
from quarrylamp.llm.units import text_units, unpacked

SEED = 32
LAST = (1 << 63) - 1
#: Bytes of text that are hashed at once.
STRETCH = 1 << 20

_rng = np.random.default_rng(11)
_TABLE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2 ** 64."""
    have = next(iter(_powers.values()), None)
    if have is None or len(have[0]) < size:
        size = max(size, 2 * STRETCH)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers.clear()
        _powers[size] = have = (tables[0], tables[1])
    return have


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED bytes at every place of a byte array."""
    n = len(data) - SEED + 1
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * down[: len(data)], out=sums[1:])
    found = (sums[SEED:] - sums[:-SEED]) * up[:n]
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found


def anchors(data: np.ndarray, ends: np.ndarray, length: int):
    """Anchors of all strings of `length` bytes that lie within one text.

    `data` holds texts end to end; `ends` are where they end.  Returns arrays: place of the
    anchor, first and last start of the strings that have it, and its seed hash.
    """
    windows = len(data) - length + 1
    if windows <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, np.empty(0, np.uint64)
    hashes = seed_hashes(data)
    place = np.uint64((1 << 24) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    reach, size = length - SEED + 1, 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if reach > size:
        least = np.minimum(least[: size - reach], least[reach - size :])
    at = (least & place).astype(np.int64)
    within = np.ones(windows, bool)
    for end in ends[:-1].tolist():
        within[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(within)
    at = at[start]
    fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]) if len(at) else np.empty(0, np.int64)
    last = np.r_[fresh[1:] - 1, len(at) - 1] if len(at) else fresh
    return at[fresh], start[fresh], start[last], hashes[at[fresh]]


def stretches(texts: list[bytes], length: int):
    """(rows, offsets, starts, data): texts joined to stretches of about STRETCH bytes.

    A longer text is cut into parts that overlap by length - 1 bytes, so that each of its
    strings lies in one of them.
    """
    rows: list[int] = []
    offsets: list[int] = []
    parts: list[bytes] = []
    held = 0
    for row, text in enumerate(texts):
        for first in range(0, max(1, len(text) - length + 1), STRETCH):
            part = text[first : first + STRETCH + length - 1]
            if held and held + len(part) > STRETCH:
                yield _joined(rows, offsets, parts)
                rows, offsets, parts, held = [], [], [], 0
            rows.append(row)
            offsets.append(first)
            parts.append(part)
            held += len(part)
    if rows:
        yield _joined(rows, offsets, parts)


def _joined(rows, offsets, parts):
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.array(rows), np.array(offsets), ends, b"".join(parts)


def _name(length: int):
    """Each unit's different seed hashes and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, packed in zip(batch.column("unit").to_pylist(), batch.column("packed")):
                texts = unpacked(packed.as_py())[1]
                found = [anchors(np.frombuffer(data, np.uint8), ends, length)[3] for _, _, ends, data in stretches(texts, length)]
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                for first in range(0, len(hashes), 1 << 16):
                    some = slice(first, first + (1 << 16))
                    n = len(hashes[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, unit)), pa.array(hashes[some].view(np.int64)), pa.array(counts[some].astype(np.int32))],
                        ["unit", "seed", "n"],
                    )

    return run


#: Rows that units send: settled stretches, sorted runs of suffixes, and strings by digest.  Of the latter two a row
#: holds all that a unit has for a bucket, and `row` is their number.
GONE, SUFFIX, STRING = 0, 1, 2
_SENT = "kind int, unit long, row int, doc long, start long, stop long, bucket int, run binary"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]
_SENT_TYPES = [
    pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(),
]


def packed_run(suffixes: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """A sorted run of (suffix, before, doc, start, row, stop), front-coded and packed by columns."""
    shared, tails, previous = [], [], b""
    for suffix, *_ in suffixes:
        known = common_prefix(previous, suffix)
        shared.append(known)
        tails.append(suffix[known:])
        previous = suffix
    _, before, doc, start, row, stop = zip(*suffixes)
    numbers = np.array([doc, start, stop, row, shared, [*map(len, tails)], [*map(len, before)]], np.int64)
    # Bytes of equal weight side by side: the high ones are nearly all zero.
    numbers = numbers.view(np.uint8).reshape(7, -1, 8).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=3).compress(b"".join([numbers.tobytes(), *tails, *before]))


def unpacked_run(data: bytes, rows: int) -> tuple[list, ...]:
    """(shared, tails, before, doc, start, row, stop): the columns of a packed run of so many rows."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    numbers = np.frombuffer(raw, np.uint8, 56 * rows).reshape(7, 8, rows).transpose(0, 2, 1)
    *numbers, tail, before = np.ascontiguousarray(numbers).view(np.int64)[:, :, 0]
    ends = (56 * rows + np.cumsum(np.r_[0, tail, before])).tolist()
    parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
    doc, start, stop, row, shared = (column.tolist() for column in numbers)
    return shared, parts[:rows], parts[rows:], doc, start, row, stop


class _Earliest:
    """Occurrences by content: the earliest of each, and those that come after it."""

    def __init__(self):
        self.kept: dict[bytes, list[tuple]] = {}
        self.late: list[tuple] = []

    def add(self, content: bytes, at: tuple) -> None:
        """`at` begins with (doc, start); occurrences at equal places (a repeated row) all stay."""
        have = self.kept.get(content)
        if have is None:
            self.kept[content] = [at]
        elif at[:2] > have[0][:2]:
            self.late.append(at)
        elif at[:2] < have[0][:2]:
            self.late += have
            self.kept[content] = [at]
        else:
            have.append(at)


def _joined_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(row, start, stop) sorted, with those that touch made one."""
    out: list[list[int]] = []
    for row, start, stop in sorted(spans):
        if out and out[-1][0] == row and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], stop)
        else:
            out.append([row, start, stop])
    return [tuple(x) for x in out]


def _send(length: int, buckets: int):
    def run(units: pa.Table, asked: pa.Table) -> pa.Table:
        if not units.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in _SENT_TYPES], names=_SENT_NAMES)
        unit = units.column("unit")[0].as_py()
        ids, texts = unpacked(units.column("packed")[0].as_py())
        order = np.argsort(asked.column("seed").to_numpy())
        seeds = asked.column("seed").to_numpy()[order]
        hot = asked.column("hot").to_numpy()[order]
        # A seed with one occurrence left in a unit may still occur in others.
        contexts, strings = _Earliest(), _Earliest()
        for rows, offsets, ends, data in stretches(texts, length):
            at, first, last, hashes = anchors(np.frombuffer(data, np.uint8), ends, length)
            signed = hashes.view(np.int64)
            where = np.minimum(np.searchsorted(seeds, signed), len(seeds) - 1)
            chosen = np.flatnonzero(seeds[where] == signed)
            part = np.searchsorted(ends, at[chosen], side="right")
            begin = np.r_[0, ends[:-1]][part]
            shift = offsets[part] - begin
            columns = (at[chosen], first[chosen], last[chosen], signed[chosen], hot[where[chosen]], rows[part], shift)
            for a, s, e, seed, often, row, move in zip(*(c.tolist() for c in columns)):
                doc = LAST if ids[row] is None else ids[row]
                if often:
                    for k in range(s, e + 1):
                        strings.add(
                            xxhash.xxh3_128_digest(data[k : k + length]), (doc, k + move, row, k + move + length)
                        )
                else:
                    contexts.add(data[s : e + length], (doc, s + move, row, e + move + length, a - s, seed))
        out: list[tuple] = []
        settled = [(row, start, stop) for doc, start, row, stop, *_ in contexts.late + strings.late]
        for row, start, stop in _joined_spans(settled):
            out.append((GONE, unit, row, None, start, stop, unit % buckets, None))
        dealt = defaultdict(list)
        while strings.kept:
            digest, places = strings.kept.popitem()
            one, two = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
            dealt[one % buckets] += [(one, two, doc, start, row) for doc, start, row, _ in places]
        for bucket in list(dealt):
            some = np.array(dealt.pop(bucket), np.int64)
            out.append((STRING, unit, len(some), None, None, None, bucket, some.tobytes()))
        runs = defaultdict(list)
        while contexts.kept:  # what has been taken over need not be held twice
            content, places = contexts.kept.popitem()
            for doc, start, row, stop, cut, seed in places:
                runs[seed % buckets].append((content[cut:], content[:cut], doc, start, row, stop))
        for bucket in list(runs):
            suffixes = sorted(runs.pop(bucket))
            out.append((SUFFIX, unit, len(suffixes), None, None, None, bucket, packed_run(suffixes)))
        columns = list(zip(*out)) or [()] * len(_SENT_TYPES)
        del contexts, strings, runs, out
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(columns, _SENT_TYPES)], names=_SENT_NAMES)

    return run


def _settle(group: list[tuple], length: int, gone: dict) -> None:
    """Settle suffixes of one seed: (context, doc, start, unit, row, stop)."""
    found = _Earliest()
    for context, *at in group:
        found.add(context, tuple(at))
    for doc, start, unit, row, stop in found.late:
        gone[unit].append((row, start, stop))
    if len(found.kept) < 2:
        return
    # Different contexts: the earliest of each, compared string by string in their order.
    seen: dict[bytes, tuple[int, int]] = {}
    for context, places in sorted(found.kept.items(), key=lambda x: x[1][0][:2]):
        doc, start = places[0][:2]
        for k in range(len(context) - length + 1):
            own = (doc, start + k)
            if seen.setdefault(context[k : k + length], own) < own:
                for _, first, unit, row, _ in places:
                    gone[unit].append((row, first + k, first + k + length))


_SPANS = "unit long, row int, start long, stop long"
_SPAN_NAMES = [c.split()[0] for c in _SPANS.split(", ")]


def _spans(gone: dict[int, list]) -> pa.RecordBatch:
    out = [(u, *span) for u, spans in gone.items() for span in _joined_spans(spans)]
    columns = list(zip(*out)) or [()] * 4
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_SPAN_NAMES)


def _merge(held: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """What the runs of one bucket, (unit, rows, run) by unit, settle among each other."""
    runs = [unpacked_run(data, rows) for _, rows, data in held]
    gone: dict = defaultdict(list)
    group: list[tuple] = []
    for at, place, suffix, known in merged([(shared, tails) for shared, tails, *_ in runs]):
        if known < SEED and group:
            if len(group) > 1:
                _settle(group, length, gone)
            group = []
        before, doc, start, row, stop = (column[place] for column in runs[at][2:])
        group.append((before + suffix, doc, start, held[at][0], row, stop))
    if len(group) > 1:
        _settle(group, length, gone)
    return _spans(gone)


def _late(held: list[tuple[int, int, bytes]], length: int) -> pa.RecordBatch:
    """Strings of one bucket, (unit, rows, packed), that stand after the first of their digest."""
    rows = np.concatenate([np.frombuffer(data, np.int64).reshape(-1, 5) for *_, data in held])
    unit = np.repeat([u for u, *_ in held], [n for _, n, _ in held])
    order = np.lexsort(rows[:, 3::-1].T)
    rows, unit = rows[order], unit[order]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    late = (rows[:, 2:4] != rows[first, 2:4]).any(axis=1)
    start, row = rows[late, 3], rows[late, 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(unit[late]), pa.array(row.astype(np.int32)), pa.array(start), pa.array(start + length)], _SPAN_NAMES
    )


def _settled(length: int):
    """Removed stretches from rows sorted by kind, bucket and unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> pa.RecordBatch:
            return (_late if key[0] == STRING else _merge)(held, length)

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            yield batch.select(_SPAN_NAMES).filter(pa.array(kind == GONE))
            sent = batch.filter(pa.array(kind != GONE))
            for at, bucket, unit, rows, data in zip(*(sent.column(c) for c in ("kind", "bucket", "unit", "row", "run"))):
                if held and key != (at.as_py(), bucket.as_py()):
                    yield settle()
                    held = []
                key = at.as_py(), bucket.as_py()
                held.append((unit.as_py(), rows.as_py(), data.as_py()))
        if held:
            yield settle()
        held = []
        give_back()

    return run


def _cut_out(keep_text: bool):
    def run(units: pa.Table, spans: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], []]
        by_row = defaultdict(list)
        for row, start, stop in zip(*(spans.column(c).to_pylist() for c in ("row", "start", "stop"))):
            by_row[row].append((row, start, stop))
        for packed in units.column("packed"):
            for row, (doc, text) in enumerate(zip(*unpacked(packed.as_py()))):
                gone = _joined_spans(by_row.get(row, []))
                kept, at = [], 0
                for _, start, stop in gone:
                    kept.append(text[at:start])
                    at = stop
                kept = b"".join([*kept, text[at:]])
                values = (doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_text else None)
                for column, value in zip(rows, values):
                    column.append(value)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    return run


def remove_repeats(
    documents: DataFrame, length: int = 100, often: int = 8192, keep_text: bool = False
) -> DataFrame:
    """Take out of every row every byte of a `length`-byte string that also starts earlier.

    `documents` has doc_id and text; other columns are ignored.  Earlier is: in a row with a
    smaller doc_id, or in the same text further left; overlaps count, and strings are judged on
    the input.  Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): maximal removed
    runs, the digest of the remaining bytes, and these bytes if `keep_text`.  Null texts are
    empty.  Rows without doc_id come last; rows that share a doc_id are as early as each other
    at equal places.  An empty table gives an empty one.  Seeds with more than `often`
    occurrences are dealt out string by string; the result is the same.
    """
    units = stored(text_units(documents))
    named = units.mapInArrow(_name(length), "unit long, seed long, n int")
    total = F.sum("n").over(Window.partitionBy("seed"))
    asked = named.withColumn("total", total).filter("total > 1").select(
        "unit", "seed", (F.col("total") > often).alias("hot")
    )
    # Four a unit, but fewer where units are small: a unit may send a run to every bucket.
    number, size = units.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("packed")), F.lit(0))).first()
    buckets = max(16, min(4 * number, size >> 18))
    sent = units.groupBy("unit").cogroup(asked.groupBy("unit")).applyInArrow(_send(length, buckets), _SENT)
    # All kinds of rows go through one shuffle, so that none has to be written first.
    spans = (
        sent.repartition("bucket").sortWithinPartitions("kind", "bucket", "unit")
        .mapInArrow(_settled(length), _SPANS)
    )
    return units.groupBy("unit").cogroup(spans.groupBy("unit")).applyInArrow(
        _cut_out(keep_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary",
    )
