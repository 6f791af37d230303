"""Language-model scores by prediction by partial matching over bytes, next to a word baseline.

The model is a trie of byte contexts up to `ORDER` bytes, pretrained on the counts of all
training texts.  A symbol seen in a context gets n / (T + D) of it (T: symbols counted there, D:
different ones); otherwise D / (T + D) is spent on escaping to the context one byte shorter, in
which the symbols of the longer ones are excluded; below the empty context stands a uniform one.
A text is followed by an end symbol and preceded by a start context, so probabilities of all
texts add up to one.

The trie never sits in one place.  Texts are packed into units.  Each unit asks for the keys it
needs, its different words and byte strings, once; the keys are counted and priced where they
meet, and the answers go back to the units.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, stored
from quarrylamp.llm.units import text_units, unpacked

ORDER = 5
#: Bytes that no UTF-8 text holds: start context and end symbol.
START, END = 0xFE, 0xFF
WORD, GRAM = 0, 1


def held_out(doc_id: int | None, folds: int, held: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == held


def _runs(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about `limit` bytes."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def grams(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every predicted symbol of some texts as one number each.

    Returns the numbers, text after text, and where each text's begin.
    """
    start = bytes([START]) * ORDER
    end = bytes([END])
    data = np.frombuffer(b"".join(start + t + end for t in raw), np.uint8)
    codes = np.zeros(max(0, len(data) - ORDER), np.int64)
    for k in range(ORDER + 1):
        codes <<= 8
        codes |= data[k : k + len(codes)]
    codes = codes[data[ORDER:] != START]
    sizes = np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw))
    return codes, np.cumsum(sizes) - sizes


def word_key(word: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _distinct_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    words: Counter = Counter()
    for own in texts:
        words.update(own)
    return np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    counts = np.concatenate([c for _, c in held])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _gather(is_held):
    """Per unit: its different words and grams with their numbers in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {WORD: [], GRAM: []}
        unit = None

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                if not parts:
                    continue
                keys, counts = _merged(parts)
                parts.clear()
                for at in range(0, len(keys), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    n = len(keys[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, unit, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(keys[some]), pa.array(counts[some])],
                        ["unit", "kind", "key", "n"],
                    )

        for batch in batches:
            for unit, packed in zip(batch.column("unit").to_pylist(), batch.column("packed")):
                ids, texts = unpacked(packed.as_py())
                for first, last in _runs(texts):
                    raw = [t.lower() for t in texts[first:last]]
                    for trains in (True, False):
                        some = [t for t, d in zip(raw, ids[first:last]) if is_held(d) != trains]
                        if not some:
                            continue
                        keys, counts = _distinct_words([t.split() for t in some])
                        held[WORD].append((keys, counts if trains else np.zeros_like(counts)))
                        keys, counts = np.unique(grams(some)[0], return_counts=True)
                        held[GRAM].append((keys, counts if trains else np.zeros_like(counts)))
                    for parts in held.values():
                        if len(parts) > 8:
                            parts[:] = [_merged(parts)]
                del ids, texts
                yield from flush()
        give_back()

    return run


def _price(order: int):
    """One step down the trie for grams that no longer context has predicted.

    Rows hold the excluded symbols as a bit set and the log10 spent so far; `symbols` and
    `counts` are the context's own, null where the trie lacks it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            columns = (batch.column(c).to_pylist() for c in ("key", "spent", "excluded", "symbols", "counts"))
            for key, spent, excluded, symbols, counts in zip(*columns):
                gone = int.from_bytes(excluded, "little")
                done = False
                if symbols:
                    rest = [(s, n) for s, n in zip(symbols, counts) if not gone >> s & 1]
                    total = sum(n for _, n in rest) + len(rest)
                    own = next((n for s, n in rest if s == key & 255), 0)
                    if own:
                        spent, done = spent + math.log10(own / total), True
                    elif rest:
                        spent += math.log10(len(rest) / total)
                        for s, _ in rest:
                            gone |= 1 << s
                if not done and order == 0:
                    spent, done = spent - math.log10(256 - gone.bit_count()), True
                out[0].append(spent)
                out[1].append(None if done else gone.to_bytes(32, "little"))
                out[2].append(done)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(out[0], pa.float64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())],
                ["key", "spent", "excluded", "done"],
            )

    return run


def unseen_prices(trie: DataFrame, unseen: DataFrame) -> DataFrame:
    """(key, value): log10 probability of grams (key) that the trie (key, n) lacks."""
    trie = trie.select(
        F.shiftright("key", 8).alias("context"), F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "n"
    )
    pending = unseen.select("key", F.lit(0.0).alias("spent"), F.lit(bytes(32)).alias("excluded"))
    found = None
    for order in range(ORDER, -1, -1):
        mask = (1 << 8 * order) - 1
        nodes = (
            trie.groupBy(F.col("context").bitwiseAND(mask).alias("at"), "symbol").agg(F.sum("n").alias("n"))
            .groupBy("at").agg(F.collect_list(F.struct("symbol", "n")).alias("seen"))
            .select("at", F.col("seen.symbol").alias("symbols"), F.col("seen.n").alias("counts"))
        )
        asked = pending.withColumn("at", F.shiftright("key", 8).bitwiseAND(mask)).join(nodes, "at", "left")
        stepped = stored(
            asked.select("key", "spent", "excluded", "symbols", "counts").mapInArrow(
                _price(order), "key long, spent double, excluded binary, done boolean"
            )
        )
        done = stepped.filter("done").select("key", F.col("spent").alias("value"))
        found = done if found is None else found.unionByName(done)
        pending = stepped.filter("not done").select("key", "spent", "excluded")
    return found


class _Lookup:
    """Values by key for whole arrays of different keys that are all there.

    Of keys whose hashes point to one slot the last holds it; the others go to a further, smaller table.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray, factor: int = 0x9E3779B97F4A7C15):
        self.keys, self.values, self.factor, self.rest = keys, values, np.uint64(factor), None
        bits = max(10, int(len(keys)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, np.int32)
        at, places = self._at(keys), np.arange(len(keys), dtype=np.int32)
        self.slot[at] = places
        lost = np.flatnonzero(self.slot[at] != places)
        if len(lost):
            # An odd factor keeps different keys apart in 64 bits, so in the end each has a slot.
            self.rest = _Lookup(keys[lost], values[lost], factor * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.factor) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._at(keys)]
        found = self.values[at]
        if self.rest is not None:
            missed = np.flatnonzero(self.keys[at] != keys)
            found[missed] = self.rest(keys[missed])
        return found


def _score(total: int, different: int, end_count: int, is_held):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy()
        keys, values = right.column("key").to_numpy(), right.column("value").to_numpy()
        word_of = _Lookup(keys[kind == WORD], values[kind == WORD])
        gram_of = _Lookup(keys[kind == GRAM], values[kind == GRAM])
        del kind, keys, values
        floor = math.log10(total + different + 1)
        end = math.log10(end_count + 1) - floor
        rows: list[list] = [[], [], [], [], [], []]
        for packed in left.column("packed"):
            ids, texts = unpacked(packed.as_py())
            rows[0] += ids
            rows[1] += map(is_held, ids)
            for begin, stop in _runs(texts):
                raw = [t.lower() for t in texts[begin:stop]]
                words = [t.split() for t in raw]
                # Every word is looked at once: a new one gets the next number.
                known: defaultdict = defaultdict()
                known.default_factory = known.__len__
                ends = np.cumsum([0, *map(len, words)]).tolist()
                own = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, ends[-1])
                counts = word_of(np.fromiter(map(word_key, known), np.int64, len(known))) if known else np.empty(0)
                seen, logs = (counts > 0)[own], np.log10(counts + 1)[own]
                codes, starts = grams(raw)
                rows[5] += np.add.reduceat(gram_of(codes), starts).tolist()
                for first, last in zip(ends, ends[1:]):
                    rows[2].append(last - first + 1)
                    rows[3].append(int(np.count_nonzero(seen[first:last])) + (end_count > 0))
                    rows[4].append(float(logs[first:last].sum()) - floor * (last - first) + end)
        del word_of, gram_of
        give_back()
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([pa.array(r, t) for r, t in zip(rows, types)], names=names)

    return run


def scores(documents: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Score every row of `documents` (doc_id, text; other columns are ignored).

    Rows whose crc32(doc_id as text) mod `folds` is `held` are held out; all others train.
    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): words and an
    end token, those seen in training, all training tokens, the add-one word score, and the trie's
    log10 probability of the bytes.  A-Z are lower-cased.  Null texts are empty: one token.  A
    null doc_id counts as empty text for the remainder.  Repeated rows train as often as they
    stand there.  With nothing to train on every symbol is uniform; an empty table gives an
    empty one.  Words are told apart by 64-bit hashes.
    """
    is_held = functools.partial(held_out, folds=folds, held=held)
    texts = stored(text_units(documents))
    asked = texts.mapInArrow(_gather(is_held), "unit long, kind int, key long, n long")
    # Rows of a context meet in one shuffle, which serves both windows; a word is its own context.
    asked = asked.withColumn(
        "context", F.when(F.col("kind") == GRAM, F.shiftright("key", 8)).otherwise(F.col("key"))
    ).repartition("kind", "context")
    node, item = Window.partitionBy("kind", "context"), Window.partitionBy("kind", "context", "key")
    counted = asked.withColumns({"total": F.sum("n").over(item), "turn": F.row_number().over(item.orderBy("unit"))})
    fresh = F.when((F.col("turn") == 1) & (F.col("total") > 0), 1)
    spread = F.sum("n").over(node) + F.count(fresh).over(node)
    counted = stored(
        counted.select("unit", "kind", "key", "turn", F.col("total").alias("n"), spread.alias("spread"))
        .withColumn("value", F.when(F.col("kind") == WORD, F.col("n").cast("double")).when(F.col("n") > 0, F.log10(F.col("n") / F.col("spread"))))
        .drop("spread")
    )
    first = counted.filter("turn = 1")
    sums = first.filter(F.col("kind") == WORD).agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))
    ).first()
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    end_count = documents.filter(remainder != held).count()
    tokens, different = sums[0] + end_count, sums[1] + (end_count > 0)
    grams_ = first.filter(F.col("kind") == GRAM)
    trie = stored(grams_.filter("n > 0").select("key", "n"))
    priced = unseen_prices(trie, grams_.filter("n = 0").select("key"))
    missing = counted.filter((F.col("kind") == GRAM) & (F.col("n") == 0))
    answers = counted.filter("value is not null").select("unit", "kind", "key", "value").unionByName(
        missing.select("unit", "kind", "key").join(priced, "key").select("unit", "kind", "key", "value")
    )
    scored = texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(
        _score(tokens, different, end_count, is_held),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double",
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
