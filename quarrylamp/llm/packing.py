"""Best-fit packing of token pieces into sequences by linear grouping.

Only the number of pieces of each length matters for the plan, and there are at most `capacity`
lengths, so the plan is made from a bounded histogram:

1. full pieces are sequences of their own;
2. the other large lengths are sorted and cut into groups of equal cardinality, each rounded up
   to its largest length;
3. for these few sizes the best mix of configurations (multisets that fit one sequence) comes
   from a linear program with column generation; its whole parts become sequences;
4. the actual pieces take the places of their group, and what they leave free is known;
5. small pieces, and the large ones left over, go best-fit in falling length.

All steps work on runs of equal sequences.  The plan is a table of runs; rows find their place
by their rank within their length.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import slices, stored

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _WordIds:
    """Token ids of texts as little-endian bytes, word by word.

    The tokenizer lower-cases and drops blanks, and no token spans one, so a text's ids are its
    words' ids in a row; each different word is tokenized once while the store of known words is
    not full, and the store begins anew when it is.
    """

    def __init__(self, path: str, end_id: int, limit: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.end = int(end_id).to_bytes(4, "little")
        self.limit = limit

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        words = [_words(t) for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {}
            new = set().union(*words)
        self._learn([w for w in new if MARK not in w])
        for word in new:
            if MARK in word:
                self.known[word] = np.array(self._ids([word])[0], "<u4").tobytes()
        known = self.known
        return [b"".join([known[w] for w in own]) + self.end for own in words]

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        texts = [t.decode("utf-8", "surrogatepass") for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes], together: int = 1024) -> None:
        """Tokenize many words in one text each, with a mark of one id between them."""
        (mark,) = self._ids([MARK])[0]
        groups = [words[k : k + together] for k in range(0, len(words), together)]
        for group, ids in zip(groups, self._ids([(b" " + MARK + b" ").join(g) for g in groups])):
            ids = np.array(ids, "<u4")
            ends = [*np.flatnonzero(ids == mark).tolist(), len(ids)]
            data, first = ids.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self.known[word] = data[4 * first : 4 * end]
                first = end + 1


#: A control character that words hardly hold; words with it are tokenized alone.
MARK = b"\x01"


def _words(text: str | None) -> list[bytes]:
    """The words of a text; A-Z lower-cased as the tokenizer does, unless it may hold special tokens."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw if b"<|" in raw else raw.lower()).split()


@functools.lru_cache(maxsize=1)
def _word_ids(path: str, end_id: int) -> _WordIds:
    """One store of known words for all tasks of a Python worker."""
    return _WordIds(path, end_id)


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(path, end_id)
        for batch in slices(batches, "text"):
            rows = []
            ids = ids_of(batch.column("text").to_pylist())
            for doc, data in zip(batch.column("doc_id").to_pylist(), ids):
                for piece, first in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[first : first + 4 * capacity]
                    rows.append((doc, piece, first // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Cut every row's token ids, closed by `end_id`, into pieces of at most `capacity` ids.

    A null or empty text has the one id `end_id`.  `tokenizer` is the file of a tokenizer that
    lower-cases and drops blanks; it must be installed on every executor.
    """
    return documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, end_id, capacity), PIECE)


class Run(NamedTuple):
    """Pieces `first` to `first + count - 1` of a length, `each` in a sequence from `sequence` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1000):
    """Solve the configuration program: (how often, pieces per size) pairs, covering `demand`.

    Sizes are distinct.  Columns are generated by an unbounded knapsack over the dual prices;
    the basis always has one column a size.
    """
    n = len(sizes)
    columns = np.diag([float(capacity // s) for s in sizes])
    costs = np.ones(n)
    inverse = np.diag(1 / np.diag(columns))
    needed = np.array(demand, float)
    for _ in range(rounds):
        # Small products: plain loops, as threads of a linear algebra library only get in the way.
        prices = np.einsum("i,ij->j", costs, inverse)
        if prices.min() < -1e-9:  # covering more than is asked costs nothing
            entering, cost = np.zeros(n), 0.0
            entering[int(prices.argmin())] = -1.0
        else:
            entering, value = _knapsack(sizes, prices, capacity)
            cost = 1.0
            if value <= 1 + 1e-4:
                break
        step = np.einsum("ij,j->i", inverse, entering)
        rising = step > 1e-9
        if not rising.any():
            break
        amounts = np.maximum(np.einsum("ij,j->i", inverse, needed), 0)
        leaving = int(np.where(rising, amounts / np.where(rising, step, 1), np.inf).argmin())
        columns[:, leaving], costs[leaving] = entering, cost
        pivot = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, pivot)
        inverse[leaving] = pivot
    amounts = np.einsum("ij,j->i", inverse, needed)
    return [
        (int(x + 1e-6), [int(round(c)) for c in columns[:, k]])
        for k, x in enumerate(amounts)
        if costs[k] and x >= 1 - 1e-6
    ]


def _knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of the highest price that fits."""
    worth = sorted((s, p) for s, p in zip(sizes, prices.tolist()) if p > 0)
    best = np.zeros(capacity + 1)
    for _ in range(capacity // min(sizes)):  # one piece more in every pass
        more = best.copy()
        for size, price in worth:
            np.maximum(more[size:], best[: capacity + 1 - size] + price, out=more[size:])
        if (more <= best + 1e-13).all():
            break
        best = more
    found = np.zeros(len(sizes))
    step, room = np.array(sizes), capacity
    while best[room] > 0:
        fits = np.flatnonzero(step <= room)
        k = int(fits[np.abs(prices[fits] + best[room - step[fits]] - best[room]).argmin()])
        if abs(prices[k] + best[room - step[k]] - best[room]) > 1e-9:
            break
        found[k] += 1
        room -= sizes[k]
    return found, float(prices @ found)


#: Groupings of which the plan with the fewest sequences is taken: (groups, part of the capacity
#: from which on a length is large).  Many groups lose little to rounding where two pieces fill a
#: sequence; sequences of many pieces gain more from their configurations than fine groups would.
GROUPINGS = ((256, 3), (128, 4), (64, 8))


def plan(
    histogram: dict[int, int], capacity: int, groupings: tuple[tuple[int, int], ...] = GROUPINGS
) -> list[Run]:
    """Runs that place every piece of the histogram (length: count) once, in few sequences.

    Every plan tried groups the large lengths and fills configurations of the groups first.
    """
    if not groupings or min(min(g) for g in groupings) < 1:
        raise ValueError("a plan needs at least one group and a part of the capacity")
    plans = [_grouped(histogram, capacity, groups, part) for groups, part in groupings]
    return min(plans, key=lambda p: p[1])[0]


def _grouped(histogram: dict[int, int], capacity: int, groups: int, large_part: int) -> tuple[list[Run], int]:
    left = {length: n for length, n in histogram.items() if n}
    taken = dict.fromkeys(left, 0)
    runs: list[Run] = []
    sequences = 0
    # Sequences with room: room -> [(first sequence, how many)].
    free: dict[int, list[tuple[int, int]]] = {}

    if capacity in left:
        runs.append(Run(capacity, 0, left[capacity], 1, 0, 0))
        sequences = left.pop(capacity)

    # Linear grouping of the large lengths: equal cardinality, rounded up to the largest.
    large = sorted((length for length in left if length * large_part > capacity), reverse=True)
    total = sum(left[length] for length in large)
    if total:
        share = -(-total // groups)
        members: list[list[list[int]]] = []
        room = 0
        for length in large:
            n = left[length]
            while n:
                if not room:
                    members.append([])
                    room = share
                some = min(n, room)
                members[-1].append([length, some])
                n -= some
                room -= some
        sizes: list[int] = []
        pools: list[list[list[int]]] = []
        for group in members:
            if sizes and sizes[-1] == group[0][0]:
                pools[-1] += group
            else:
                sizes.append(group[0][0])
                pools.append(list(group))
        demand = [sum(n for _, n in pool) for pool in pools]
        for often, configuration in configurations(sizes, demand, capacity):
            # Actual pieces take the places; the run of sequences splits where lengths change.
            often = min([often, *(demand[k] // c for k, c in enumerate(configuration) if c)])
            if not often:
                continue
            stretches = [(sequences, often, 0)]
            sequences += often
            for k, c in enumerate(configuration):
                demand[k] -= c * often
                for _ in range(c):
                    stretches = _substitute(stretches, pools[k], taken, left, runs)
            for first, count, used in stretches:
                free.setdefault(capacity - used, []).append((first, count))

    # Best fit of all that is left, in falling length.
    rooms = sorted(free)
    for length in sorted((x for x in left if left[x]), reverse=True):
        n = left[length]
        while n:
            at = _first_at_least(rooms, length)
            if at is None:
                each = capacity // length
                count = -(-n // each)
                stretch = (sequences, count)
                room = capacity
                sequences += count
            else:
                room = rooms[at]
                stretch = free[room].pop()
                if not free[room]:
                    del free[room], rooms[at]
                each = room // length
            first, count = stretch
            whole = min(count, n // each)
            if whole:
                runs.append(Run(length, taken[length], whole * each, each, first, capacity - room))
                _put(free, rooms, room - each * length, (first, whole))
                taken[length] += whole * each
                n -= whole * each
            rest = count - whole
            if rest and n and n < each:
                runs.append(Run(length, taken[length], n, n, first + whole, capacity - room))
                _put(free, rooms, room - n * length, (first + whole, 1))
                taken[length] += n
                n = 0
                whole += 1
                rest -= 1
            if rest:
                _put(free, rooms, room, (first + whole, rest))
    return runs, sequences


def _put(free: dict, rooms: list[int], room: int, stretch: tuple[int, int]) -> None:
    if room <= 0:
        return
    if room not in free:
        free[room] = []
        at = _first_at_least(rooms, room)
        rooms.insert(len(rooms) if at is None else at, room)
    free[room].append(stretch)


def _first_at_least(rooms: list[int], length: int) -> int | None:
    at = bisect.bisect_left(rooms, length)
    return at if at < len(rooms) else None


def _substitute(stretches, pool, taken, left, runs):
    """Give one piece of a group to every sequence of the stretches, largest pieces first."""
    out = []
    for first, count, used in stretches:
        while count:
            length, n = pool[0]
            some = min(n, count)
            runs.append(Run(length, taken[length], some, 1, first, used))
            taken[length] += some
            left[length] -= some
            out.append((first, some, used + length))
            if some == n:
                pool.pop(0)
            else:
                pool[0][1] -= some
            first += some
            count -= some
    return out


def _place(runs: list[Run]):
    """Find each row's sequence and offset from its length and rank within it."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    base = 1 << 44  # more pieces of one length than that are not expected on any cluster
    keys = table[:, 0] * base + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, length * base + rank, side="right") - 1]
            turn = rank - own[:, 1]
            sequence = own[:, 4] + turn // own[:, 3]
            offset = own[:, 5] + turn % own[:, 3] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(
    documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096,
    groupings: tuple[tuple[int, int], ...] = GROUPINGS,
) -> DataFrame:
    """Pack all rows' tokens into sequences of at most `capacity` ids.

    Returns, per piece, doc_id, piece, start, length, ids_crc32 (of its ids as little-endian
    32-bit numbers), sequence_id and offset, gapless from 0.  Null and empty texts are one
    closing id.  Rows with null or repeated doc_ids are packed like any other.  Pieces of equal
    length are interchangeable, so ties change nothing but which of them goes where.  An empty
    table gives an empty one; other columns are ignored.
    """
    cut = stored(pieces(documents, tokenizer, end_id, capacity))
    # Ranks within a length are counted in salted parts, so that a common length is split.
    parts = max(16, cut.count() >> 16)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), parts))
    counts = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {
        r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }  # at most `capacity` rows
    runs = plan(histogram, capacity, groupings)
    before = F.sum("n").over(
        Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start"))
    return (
        salted.withColumn("turn", turn).join(starts, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("turn") - 1 + F.col("before")).alias("rank"))
        .mapInArrow(_place(runs), PIECE + ", sequence_id long, offset long")
    )
