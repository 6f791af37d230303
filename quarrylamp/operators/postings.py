"""Posting lists: one row per (unit, lexeme), positions as gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import words
from quarrylamp.operators.sizing import give_back

Lexicon = Callable[[Column], Column]

WEIGHT_CLASSES = ("A", "B", "C", "D")

#: Words that are sorted, and places that are told, at once; one unit, or list, may have more.
WORDS_AT_ONCE = 1 << 17


def simple_lexicon(tokens: Column) -> Column:
    """Every word is its own lexeme."""
    return tokens


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about `limit` words in all."""
    first, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield first, at
            first, held = at, 0
        held += size
    if first < len(sizes):
        yield first, len(sizes)


#: Columns, all bytes, of the lists of a unit in one row: the lexemes and their lengths, the numbers of
#: places, gaps and weights.
_BY_UNIT = ("lexemes", "lengths", "sizes", "gaps", "weights")


def _cut(values: np.ndarray, places: np.ndarray) -> pa.Array:
    """The bytes of values between places, a row for every stretch."""
    offsets = (places * values.itemsize).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(offsets), data])


def _letters(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin and end, and their bytes."""
    texts = texts if texts.offset == 0 else pa.concat_arrays([texts])
    bounds = np.frombuffer(texts.buffers()[1] or bytes(4), np.int32)[: len(texts) + 1]
    return bounds, np.frombuffer(texts.buffers()[2] or b"", np.uint8)


def _flat(column: pa.BinaryArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, number of values of each row)."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return data.view(kind) if data.flags.aligned and data.ctypes.data % np.dtype(kind).itemsize == 0 else (
        np.frombuffer(data.tobytes(), kind)
    ), np.diff(bounds) // np.dtype(kind).itemsize


def _opened(batch: pa.RecordBatch, kept: list[str], weighted: bool) -> pa.RecordBatch:
    """The rows (kept columns, lexeme, gaps, weights) of lists that lie in a row for every unit."""
    lengths, lists = _flat(batch.column("lengths"), np.int32)
    text, _ = _flat(batch.column("lexemes"), np.uint8)
    sizes, _ = _flat(batch.column("sizes"), np.int32)
    gaps, _ = _flat(batch.column("gaps"), np.int32)
    letters, bounds = (np.append(0, np.cumsum(n)).astype(np.int32) for n in (lengths, sizes))
    lexemes = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(letters), pa.py_buffer(text.tobytes()))
    owner = pa.array(np.repeat(np.arange(batch.num_rows), lists))
    columns = [lexemes if c == "lexeme" else batch.column(c).take(owner) for c in kept]
    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(gaps)))
    if weighted:
        weight, _ = _flat(batch.column("weights"), np.uint8)
        columns.append(pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(weight.tobytes())))
    return pa.RecordBatch.from_arrays(columns, [*kept, "gaps", *(["weights"] if weighted else [])])


def _listed(keep: list[str], classes: list[str], by_unit: bool = False):
    """Task body over (unit_id, kept columns, one array of lexemes per field)."""

    def lists(rows: pa.RecordBatch) -> pa.RecordBatch:
        n = rows.num_rows
        start = np.zeros(n, np.int64)
        row, pos, weight, tokens = [], [], [], []
        for number, name in enumerate(classes):
            found = rows.column(f"_lexemes{number}")
            sizes = np.diff(found.offsets.to_numpy())
            flat = found.flatten()
            of = np.repeat(np.arange(n), sizes)
            at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
            real = flat.is_valid().to_numpy(zero_copy_only=False)
            row.append(of[real])
            pos.append((start[of] + at)[real])
            weight.append(np.full(int(real.sum()), ord(name), np.uint8))
            tokens.append(flat.filter(pa.array(real)))
            used = np.zeros(n, np.int64)
            used[of[real]] = at[real]  # the last one of a row stays
            start += used
        row, pos, weight = np.concatenate(row), np.concatenate(pos), np.concatenate(weight)
        coded = pa.concat_arrays(tokens).dictionary_encode()
        key = row * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.argsort(key, kind="stable")  # positions rise within a unit already
        key, row, pos, weight = key[order], row[order], pos[order], weight[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        gaps = np.diff(pos, prepend=0)
        gaps[starts] = pos[starts]
        bounds = np.append(starts, len(key)).astype(np.int32)
        if by_unit:
            return gathered(rows, row[starts], coded.dictionary.take(coded.indices.take(pa.array(order[starts]))),
                            np.append(starts, len(key)), gaps, weight)
        owner = pa.array(row[starts])
        weights = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(weight.tobytes()))
        lexemes = coded.dictionary.take(coded.indices.take(pa.array(order[starts])))
        return pa.RecordBatch.from_arrays(
            [
                rows.column("unit_id").take(owner), *(rows.column(c).take(owner) for c in keep), lexemes,
                pa.ListArray.from_arrays(pa.array(bounds), pa.array(gaps, pa.int32())), weights,
            ],
            ["unit_id", *keep, "lexeme", "gaps", "weights"],
        )

    def gathered(rows, owner, lexemes, bounds, gaps, weight) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
        lists = np.append(first, len(owner))
        letters, text = _letters(lexemes)
        units = pa.array(owner[first])
        return pa.RecordBatch.from_arrays(
            [
                rows.column("unit_id").take(units), *(rows.column(c).take(units) for c in keep),
                _cut(text, letters[lists]), _cut(np.diff(letters), lists), _cut(np.diff(bounds).astype(np.int32), lists),
                _cut(gaps.astype(np.int32), bounds[lists]), _cut(weight, bounds[lists]),
            ],
            ["unit_id", *keep, *_BY_UNIT],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(f"_lexemes{k}") for k in range(len(classes))]
            sizes = sum(np.diff(c.offsets.to_numpy()) for c in columns)
            for first, last in runs(sizes, WORDS_AT_ONCE):
                yield lists(batch.slice(first, last - first))

    return run


def build_postings(
    df: DataFrame,
    unit: str,
    fields: dict[str, str],
    lexicon: Lexicon = simple_lexicon,
    keep: list[str] | None = None,
    by_unit: bool = False,
) -> DataFrame:
    """`(unit_id, lexeme, gaps, weights)` of the given text columns.

    A list holds the first position of the lexeme and the steps to the next ones, and a letter
    for the weight class of each.  `fields` maps a column to its weight class; later fields
    continue after the last position an earlier field really uses.  A lexicon maps an array of
    words to an array of lexemes of the same length, with NULL for stop words, which keep their
    position.  Units without an id are left out.  The whole job is row-local: no shuffle,
    whatever the vocabulary.  With `by_unit` the lists of a unit are one row, as bytes, which `positions`
    and `lexeme_totals` open: a row travels for a unit, not for each of its words.
    """
    if not set(fields.values()) <= set(WEIGHT_CLASSES):
        raise ValueError(f"weight classes are {WEIGHT_CLASSES}")
    keep = keep or []
    rows = df.filter(F.col(unit).isNotNull()).select(
        F.col(unit).cast("long").alias("unit_id"),
        *keep,
        *[
            lexicon(words(F.coalesce(F.col(column), F.lit("")))).alias(f"_lexemes{i}")
            for i, column in enumerate(fields)
        ],
    )
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keep)
    lists = ", ".join(f"{c} binary" for c in _BY_UNIT) if by_unit else "lexeme string, gaps array<int>, weights string"
    return rows.mapInArrow(_listed(keep, list(fields.values()), by_unit), f"unit_id long, {kept}{lists}")


def lies_by_unit(postings: DataFrame) -> bool:
    """Whether the lists of a unit are one row."""
    return "lengths" in postings.columns


def positions(postings: DataFrame, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """One row per (unit, lexeme, pos, weight) of posting lists; other columns stay.

    Lists without weights give rows without.  A task body `then`, which makes rows of `schema`, takes
    the rows in the task that tells them, texts coded: they then do not leave it one by one.
    """
    packed = lies_by_unit(postings)
    kept = [c for c in postings.columns if c not in (*_BY_UNIT, "bucket")]
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in postings.schema.fields if f.name in kept)
    weighted = "weights" in postings.columns
    lists = postings.drop("bucket")
    if packed:
        kept, types = [*kept, "lexeme"], f"{types}lexeme string, "
    if then is None:
        told = f"{types}pos int{', weight string' if weighted else ''}"
        return lists.mapInArrow(_unnested(kept, weighted, packed=packed), told)
    tell = _unnested(kept, weighted, packed=packed, coded=True)
    return lists.mapInArrow(lambda batches: then(tell(batches)), schema)


def lexeme_totals(places: DataFrame) -> DataFrame:
    """`(lexeme, units, documents, places, pos_sum)` of rows (lexeme, unit_id, document_id, pos, ...).

    Instead of what `positions` gives, its lists may be given: the places are then told in the task that
    packs them.  Units have an id.  A task packs the different units and documents of its lexemes, some
    places at a time, into a row for every bucket of lexemes and of 2 ** BLOCK_BITS ids; what the rows
    of a bucket hold is counted after they have met.  So a frequent lexeme has many blocks, which lie in
    many tasks, and a rare one is no row of its own.
    """
    if "gaps" in places.columns:
        packed = positions(places.drop("weights"), _pack_places, _PACKED)
    else:
        packed = places.select("lexeme", "unit_id", "document_id", "pos").mapInArrow(_pack_places, _PACKED)
    counted = packed.groupBy("bucket").applyInArrow(
        _count_ids, "lexeme string, unit boolean, different long, n long, pos long"
    )
    of = lambda side: F.coalesce(F.sum(F.when(side, F.col("different"))), F.lit(0))
    return counted.groupBy("lexeme").agg(
        of(F.col("unit")).alias("units"), of(~F.col("unit")).alias("documents"),
        F.sum("n").alias("places"), F.sum("pos").alias("pos_sum"),
    )


#: Neighbouring ids that are counted together have all but so many low bits in common.
BLOCK_BITS = 24
#: Rows that a task's lexemes are dealt over at a time; what a bucket holds is counted at once.
TOTAL_BUCKETS = 1 << 10

_PACKED = (
    "bucket int, unit boolean, lexemes binary, lengths binary, blocks binary, sizes binary, ids binary, "
    "n binary, pos binary"
)


def _shortened(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers below 2 ** 28 as bytes, seven bits each, and where each number ends."""
    size = 1 + (numbers >= 1 << 7) + (numbers >= 1 << 14) + (numbers >= 1 << 21)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    left, size, at, more = numbers, size, ends - size, None
    while len(left):
        more = size > 1
        out[at] = (left & 127) | (more << 7)
        left, size, at = left[more] >> 7, size[more] - 1, at[more] + 1
    return out, ends


def _lengthened(coded: np.ndarray) -> np.ndarray:
    """The numbers that `_shortened` wrote."""
    ends = np.flatnonzero(coded < 128)
    at = np.append(0, ends[:-1] + 1)[: len(ends)]
    numbers = (coded[at] & 127).astype(np.int64)
    open_, shift = np.flatnonzero(ends > at), 7
    while len(open_):
        at[open_] += 1
        numbers[open_] |= (coded[at[open_]] & 127).astype(np.int64) << shift
        open_, shift = open_[ends[open_] > at[open_]], shift + 7
    return numbers


def _pack_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over (lexeme, unit_id, document_id, pos): the ids of the lexemes of a bucket as one row."""

    def packed(table: pa.Table, coded: pa.DictionaryArray, hashes: np.ndarray, unit: bool) -> pa.RecordBatch:
        column = table.column("unit_id" if unit else "document_id")
        code, pos = coded.indices.to_numpy().astype(np.int64), table.column("pos").to_numpy()
        if column.null_count:
            given = column.is_valid().to_numpy()
            column, code, pos = column.drop_null(), code[given], pos[given]
        ids = column.to_numpy()
        mixed = (ids >> BLOCK_BITS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bucket = ((hashes[code] ^ (mixed >> np.uint64(32))) % np.uint64(TOTAL_BUCKETS)).astype(np.int64)
        key = bucket << 32 | code
        least = int(ids.min()) if len(ids) else 0
        if len(ids) and int(ids.max()) - least < 1 << 31 and len(coded.dictionary) < 1 << 22:
            # Bucket, lexeme and id as one number: numbers alone are sorted several times as fast.
            both = np.sort(bucket << 53 | code << 31 | (ids - least))
            key, ids = both >> 53 << 32 | both >> 31 & (1 << 22) - 1, (both & (1 << 31) - 1) + least
        else:
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
        block = ids >> BLOCK_BITS
        other = np.append(True, key[1:] != key[:-1])[: len(key)]
        fresh = other | np.append(True, ids[1:] != ids[:-1])[: len(ids)]
        starts = np.flatnonzero(other | np.append(True, block[1:] != block[:-1])[: len(ids)])
        # The first number of a list, then the steps to the next ones: few bytes each.
        held = np.append(0, np.cumsum(fresh))[np.append(starts, len(ids))]
        number = ids[fresh] & ((1 << BLOCK_BITS) - 1)
        low = np.diff(number, prepend=0)
        low[held[:-1]] = number[held[:-1]]
        low, ends = _shortened(low)
        named = coded.dictionary.take(pa.array(key[starts] & 0xFFFFFFFF))
        letters, text = _letters(named)
        bucket = key[starts] >> 32
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        bounds = np.append(first, len(starts))

        # Places are counted with the units; the sum of a lexeme's positions goes with one of its lists.
        none, summed = _cut(np.empty(0, np.int64), 0 * bounds), np.zeros(len(starts), np.int64)
        if unit:
            there, at = np.unique(key[starts] & 0xFFFFFFFF, return_index=True)
            total = np.bincount(code, weights=pos, minlength=len(coded.dictionary))  # whole numbers below 2 ** 53
            summed[at] = total[there].astype(np.int64)
        n = _cut(np.diff(np.append(starts, len(ids))), bounds) if unit else none
        summed = _cut(summed, bounds) if unit else none
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[first], pa.int32()), pa.array(np.full(len(first), unit)), _cut(text, letters[bounds]),
             _cut(np.diff(letters), bounds), _cut(block[starts], bounds), _cut(np.diff(held).astype(np.int32), bounds),
             _cut(low, np.append(0, ends)[held[bounds]]), n, summed],
            ["bucket", "unit", "lexemes", "lengths", "blocks", "sizes", "ids", "n", "pos"],
        )

    held, rows = [], 0
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            rows += batch.num_rows
        if rows >= 16 * WORDS_AT_ONCE or batch is None and rows:
            table = pa.Table.from_batches(held).unify_dictionaries().combine_chunks()
            held, rows = [], 0
            # One chunk, unless there is more text than one may have.
            coded = _whole(table.column("lexeme").dictionary_encode())
            hashes = np.array([crc32(word) for word in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
            yield packed(table, coded, hashes, True)
            yield packed(table, coded, hashes, False)
            give_back()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    column = column.unify_dictionaries().combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _count_ids(table: pa.Table) -> pa.Table:
    """How many different ids, and places, the lexemes of a bucket have, apart for units and documents."""

    def joined(rows: pa.Table, name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)

    counts = []
    for unit in (True, False):
        rows = table.filter(pc.equal(table.column("unit"), unit))
        lengths, sizes = joined(rows, "lengths", np.int32), joined(rows, "sizes", np.int32)
        if not len(sizes):
            continue
        letters = np.append(0, np.cumsum(lengths)).astype(np.int64)
        text = pa.Array.from_buffers(
            pa.large_string(), len(lengths),
            [None, pa.py_buffer(letters), pa.py_buffer(b"".join(rows.column("lexemes").to_pylist()))],
        )
        coded = text.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        listed, block = np.unique(joined(rows, "blocks", np.int64), return_inverse=True)
        of, key, often = np.unique(code * len(listed) + block, return_inverse=True, return_counts=True)
        # A list has no id twice; lists of the same lexeme and block may have the same one.
        different = np.bincount(key, weights=sizes).astype(np.int64)
        low = np.cumsum(_lengthened(joined(rows, "ids", np.uint8)))
        ends = np.cumsum(sizes, dtype=np.int64)
        low -= np.repeat(np.append(0, low)[ends - sizes], sizes)
        several = often > 1
        mine = np.repeat(several[key], sizes)
        met = np.unique(np.repeat(key, sizes)[mine] << BLOCK_BITS | low[mine]) >> BLOCK_BITS
        different[several] = np.bincount(met, minlength=len(of))[several]
        order = np.argsort(code, kind="stable")
        firsts = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
        zeros = np.zeros(len(coded.dictionary), np.int64)
        n, pos = (
            np.add.reduceat(joined(rows, name, np.int64)[order], firsts) if unit else zeros for name in ("n", "pos")
        )
        counts.append(pa.table({
            "lexeme": coded.dictionary.cast(pa.string()), "unit": pa.array(np.full(len(zeros), unit)),
            "different": np.bincount(of // len(listed), weights=different).astype(np.int64), "n": n, "pos": pos,
        }))
    give_back()
    return pa.concat_tables(counts)


def summed_gaps(gaps: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the list, position) of every entry of lists of gaps."""
    sizes = np.diff(gaps.offsets.to_numpy())
    steps = gaps.flatten().to_numpy().astype(np.int64)
    total = np.cumsum(steps)
    before = np.append(0, total)[np.cumsum(sizes) - sizes]
    return np.repeat(np.arange(len(sizes)), sizes), total - np.repeat(before, sizes)


def _unnested(kept: list[str], weighted: bool = True, packed: bool = False, coded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            gaps = whole.column("gaps")
            places = pc.binary_length(gaps).to_numpy() // 4 if packed else np.diff(gaps.offsets.to_numpy())
            for first, last in runs(places, WORDS_AT_ONCE):
                batch = whole.slice(first, last - first)
                if packed:
                    batch = _opened(batch, kept, weighted)
                row, pos = summed_gaps(batch.column("gaps"))
                columns = [batch.column(c) for c in kept]
                if coded:
                    columns = [c.dictionary_encode() if pa.types.is_string(c.type) else c for c in columns]
                told = [*(c.take(pa.array(row)) for c in columns), pa.array(pos, pa.int32())]
                if weighted:
                    letters = np.frombuffer("".join(batch.column("weights").to_pylist()).encode(), np.uint8)
                    told.append(pa.StringArray.from_buffers(
                        len(pos), pa.py_buffer(np.arange(len(pos) + 1, dtype=np.int32)), pa.py_buffer(letters.tobytes())
                    ))
                yield pa.RecordBatch.from_arrays(told, [*kept, "pos", *(["weight"] if weighted else [])])

    return run


def chunk_postings(chunks: DataFrame, lexicon: Lexicon = simple_lexicon, by_unit: bool = False) -> DataFrame:
    """Unweighted posting lists of chunk contents, with the owning document."""
    return build_postings(chunks, "id", {"content": "D"}, lexicon, keep=["document_id"], by_unit=by_unit)


def document_postings(documents: DataFrame, lexicon: Lexicon = simple_lexicon) -> DataFrame:
    """Title (A), description (B) and content (C) posting lists of documents."""
    fields = {"title": "A", "description": "B", "content": "C"}
    return build_postings(documents, "id", fields, lexicon)


BUCKETS = 64


def lexeme_bucket(lexeme: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(lexeme), F.lit(buckets)).cast("int")


def laid_out_like(stored: DataFrame, postings: DataFrame) -> DataFrame:
    """New postings with the columns of a stored table."""
    if "bucket" in stored.columns:
        postings = postings.withColumn("bucket", lexeme_bucket(F.col("lexeme")))
    return postings.select(*stored.columns)


def write_postings(postings: DataFrame, path: str) -> None:
    """Store postings for lookup: a folder per lexeme bucket, sorted by lexeme inside.

    A bucket of any size is spread over several files by unit.
    """
    laid = postings.withColumn("bucket", lexeme_bucket(F.col("lexeme")))
    (
        laid.repartition("bucket", F.pmod(F.xxhash64("unit_id"), F.lit(4)))
        .sortWithinPartitions("bucket", "lexeme", "unit_id")
        .write.partitionBy("bucket").parquet(path)
    )
