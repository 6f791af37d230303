"""Boolean match and cover density of many (query, unit) pairs at once, from their posting lists.

`fold_units` takes the lists of a unit, packed by `pack_hits`, once and lets every query of a batch pick its own there;
`fold_batches` takes pairs that bring their lists and their query along.

All hits of a batch lie in one array, ordered by query, unit and position.  Occurrences of
literals, covers and ranks are array operations over the hits of all pairs of a query; places of
different pairs are far apart, so nothing reaches from one pair into the next.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarrylamp.operators.postings import WORDS_AT_ONCE, runs, summed_gaps

#: Distance between the places of two pairs; no unit has so many positions.
APART = 1 << 32

#: What `pack_hits` gives for a unit.
PACKED = ["lists", "steps", "letters"]


class Hits:
    """Hits of the pairs of one query in order of pair and position."""

    def __init__(self, pair: np.ndarray, pos: np.ndarray, lexeme: np.ndarray, inverse: np.ndarray):
        self.pair, self.lexeme = pair, lexeme
        self.place = pair * APART + pos
        fresh = np.append(True, pair[1:] != pair[:-1])
        self.first = np.maximum.accumulate(np.where(fresh, np.arange(len(pair)), 0))
        self.total = np.append(0.0, np.cumsum(inverse))

    def occurrences(self, lexemes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """First and last hit of every occurrence of a literal, given as (lexeme, offset)."""
        begin = end = np.flatnonzero(self.lexeme == lexemes[0][0])
        base = self.place[begin] - lexemes[0][1]
        for lexeme, offset in lexemes[1:]:
            own = np.flatnonzero(self.lexeme == lexeme)
            if not len(own):
                return own, own
            at = own[np.minimum(np.searchsorted(self.place[own], base + offset), len(own) - 1)]
            there = self.place[at] == base + offset
            base, at = base[there], at[there]
            begin, end = np.minimum(begin[there], at), np.maximum(end[there], at)
        return begin, end

    def covers(self, literals: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For each end at which all literals are complete: the end and its latest beginning."""
        ends = np.unique(np.concatenate([end for _, end in literals]))
        begins = np.full(len(ends), np.iinfo(np.int64).max)
        for begin, end in literals:
            if not len(end):
                return ends[:0], begins[:0]
            order = np.argsort(end, kind="stable")
            latest = np.maximum.accumulate(begin[order])
            at = np.searchsorted(end[order], ends, side="right") - 1
            begins = np.minimum(begins, np.where(at >= 0, latest[np.maximum(at, 0)], -1))
        whole = begins >= self.first[ends]  # else a literal has not been met in this pair
        return ends[whole], begins[whole]


def fold(hits: Hits, pairs: int, groups: list) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Text rank of every pair (NaN without a match), and per excluding group the pairs it hits.

    `groups` holds (group_no, [(lexemes with offsets, negated)]).  For each end at which a group
    is complete the latest beginning counts; the first end of a beginning closes a minimal cover.
    """
    rank = np.full(pairs, np.nan)
    hit, ends, begins = [], [], []
    for number, literals in groups:
        excluded = np.zeros(pairs, bool)
        for lexemes, negated in literals:
            if negated:
                excluded[hits.pair[hits.occurrences(lexemes)[0]]] = True
        positive = [hits.occurrences(lexemes) for lexemes, negated in literals if not negated]
        if not positive:
            hit.append((number, np.flatnonzero(excluded)))
            continue
        end, begin = hits.covers(positive)
        kept = ~excluded[hits.pair[end]]
        ends.append(end[kept])
        begins.append(begin[kept])
    end, begin = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (ends, begins))
    if not len(end):
        return rank, hit
    # The latest beginning of an end, over all groups; then only ends that start anew.
    order = np.lexsort((begin, end))
    end, begin = end[order], begin[order]
    last = np.append(end[1:] != end[:-1], True)
    end, begin = end[last], begin[last]
    fresh = begin > np.append(-1, np.maximum.accumulate(begin)[:-1])
    end, begin = end[fresh], begin[fresh]
    inside = end + 1 - begin
    noise = hits.place[end] - hits.place[begin] + 1 - inside
    density = inside / (hits.total[end + 1] - hits.total[begin]) / (1 + noise)
    found = np.unique(hits.pair[end])
    summed = np.bincount(hits.pair[end], density, minlength=pairs)[found]
    rank[found] = summed / (summed + 1)
    return rank, hit


@lru_cache(maxsize=4096)
def _parsed(plan: str) -> list:
    groups: dict[int, list] = {}
    for literal in sorted(json.loads(plan), key=lambda x: (x["group_no"], x["literal_no"])):
        lexemes = [(e["lexeme"], e["offset"]) for e in literal["lexemes"]]
        groups.setdefault(literal["group_no"], []).append((lexemes, literal["negated"]))
    return list(groups.items())


def _folded(batch: pa.RecordBatch, inverse: np.ndarray) -> pa.RecordBatch:
    n = batch.num_rows
    hits = batch.column("hits")
    counts = np.diff(hits.offsets.to_numpy())
    lists = hits.flatten()
    gaps, weights, lexemes = (lists.field(lists.type.get_field_index(c)) for c in ("gaps", "weights", "lexeme"))
    coded = lexemes.dictionary_encode()
    code_of = {lexeme: code for code, lexeme in enumerate(coded.dictionary.to_pylist())}
    plans = batch.column("plan").dictionary_encode()
    plan = plans.indices.to_numpy()
    # Pairs numbered by plan, so that the hits of a query lie together.
    turn = np.empty(n, np.int64)
    turn[np.argsort(plan, kind="stable")] = np.arange(n)
    of_list, pos = summed_gaps(gaps)
    pair = turn[np.repeat(np.arange(n), counts)[of_list]]
    order = np.argsort(pair * APART + pos, kind="stable")
    pair, pos = pair[order], pos[order]
    lexeme = coded.indices.to_numpy().astype(np.int64)[of_list][order]
    letters = np.frombuffer("".join(weights.to_pylist()).encode(), np.uint8)
    weight = inverse[letters][order]
    ranks = np.full(n, np.nan)
    hit_pair, hit_group = [], []
    sizes = np.bincount(plan, minlength=len(plans.dictionary))
    first = 0
    for text, size in zip(plans.dictionary.to_pylist(), sizes.tolist()):
        a, b = np.searchsorted(pair, (first, first + size))
        own = Hits(pair[a:b] - first, pos[a:b], lexeme[a:b], weight[a:b])
        groups = [
            (number, [([(code_of.get(word, -1), at) for word, at in words], negated) for words, negated in literals])
            for number, literals in _parsed(text)
        ]
        ranks[first : first + size], found = fold(own, size, groups)
        for number, pairs in found:
            hit_pair.append(pairs + first)
            hit_group.append(np.full(len(pairs), number, np.int32))
        first += size
    pairs, numbers = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (hit_pair, hit_group))
    by = np.argsort(pairs, kind="stable")
    offsets = np.append(0, np.cumsum(np.bincount(pairs, minlength=n))).astype(np.int32)
    hit = pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[by], pa.int32())).take(pa.array(turn))
    rank = ranks[turn]
    return pa.RecordBatch.from_arrays(
        [batch.column("query_id"), batch.column("unit_id"), pa.array(rank, mask=np.isnan(rank)), hit],
        ["query_id", "unit_id", "text_rank", "hit"],
    )


def _parts(batch: pa.RecordBatch, sizes: np.ndarray, hits_at_once: int) -> Iterator[tuple[int, int]]:
    """Some rows at a time: a batch of long lists would take several times its size.

    `sizes` has the number of places in each element of `hits`.
    """
    ends = np.append(0, np.cumsum(sizes))[np.cumsum(np.diff(batch.column("hits").offsets.to_numpy()))]
    part = ends // hits_at_once
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return ((first, last) for first, last in zip(cuts, cuts[1:]) if last > first)


def fold_batches(weights: dict[str, float], hits_at_once: int = 1 << 20):
    """Task body over (query_id, unit_id, hits(lexeme, gaps, weights), plan)."""
    inverse = np.zeros(256)
    for name, weight in weights.items():
        inverse[ord(name)] = 1.0 / weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = batch.column("hits").flatten()
            sizes = np.diff(gaps.field(gaps.type.get_field_index("gaps")).offsets.to_numpy())
            for first, last in _parts(batch, sizes, hits_at_once):
                yield _folded(batch.slice(first, last - first), inverse)

    return run


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers as bytes, seven bits in each and the lowest first, and how many bytes each takes.

    The top bit of a byte says that the number goes on.
    """
    values = values.astype(np.uint32)
    size = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        there = np.flatnonzero(size > k)
        out[start[there] + k] = (values[there] >> (7 * k)) & 127 | np.where(size[there] > k + 1, 128, 0)
    return out, size


def _unpacked(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    values = np.zeros(len(ends), np.uint32)
    for k in range(5):
        there = np.flatnonzero(ends - starts >= k)
        values[there] |= (raw[starts[there] + k] & 127).astype(np.uint32) << (7 * k)
    return values.view(np.int32).astype(np.int64)


def _binaries(data: np.ndarray, taken: np.ndarray, owner: np.ndarray, owners: int) -> pa.BinaryArray:
    """The bytes of every owner, of parts that take some each and lie in order of their owners."""
    offsets = np.append(0, np.cumsum(np.bincount(owner, taken, owners))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), owners, [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])


def pack_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task body over (unit_id, code, gaps, weights): the lists of a unit that lie in one batch as one row.

    `lists` has the code and the length of each list and `steps` the gaps of all, as numbers of few
    bytes, `letters` all their weights, so that little moves when the rows of a unit are gathered.
    """
    for whole in batches:
        for first, last in runs(np.diff(whole.column("gaps").offsets.to_numpy()), WORDS_AT_ONCE):
            batch = whole.slice(first, last - first)
            # Units without an id are one, as in a grouping.
            unit = batch.column("unit_id").dictionary_encode("encode")
            number = unit.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(number, kind="stable")
            gaps, weights = (batch.column(c).take(pa.array(order)) for c in ("gaps", "weights"))
            number, units = number[order], len(unit.dictionary)
            sizes = np.diff(gaps.offsets.to_numpy())
            heads = np.stack([batch.column("code").to_numpy()[order], sizes], 1).ravel()
            letters = np.frombuffer("".join(weights.to_pylist()).encode(), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    unit.dictionary,
                    _binaries(*_packed(heads), np.repeat(number, 2), units),
                    _binaries(*_packed(gaps.flatten().to_numpy()), np.repeat(number, sizes), units),
                    _binaries(letters, np.ones(len(letters), np.int64), np.repeat(number, sizes), units),
                ],
                ["unit_id", *PACKED],
            )


class _Query:
    """A query of a batch, with its words as codes."""

    def __init__(self, query_id: int | None, literals: list[tuple], codes: dict[str, int]):
        self.query_id = query_id
        groups: dict[int, list] = {}
        for number, _, lexemes, negated in sorted(literals, key=lambda x: x[:2]):
            groups.setdefault(number, []).append(([(codes[word], at) for word, at in lexemes], negated))
        # Words of a literal, of a group, of a query: each once.
        self.positive = [(n, g) for n, g in groups.items() if not all(negated for _, negated in g)]
        self.excluding = [[words for words, _ in g] for g in groups.values() if all(negated for _, negated in g)]
        self.needs = [
            sorted({code for words, negated in g if not negated for code, _ in words}) for _, g in self.positive
        ]
        self.codes = sorted({code for g in groups.values() for words, _ in g for code, _ in words})


def _bytes(column: pa.BinaryArray) -> np.ndarray:
    """The bytes of all values, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _numbers(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers packed in all values, one after the other, and how many each value has."""
    raw = _bytes(column)
    before = np.append(0, np.cumsum(raw < 128))
    ends = np.cumsum([len(value) for value in column.to_pylist()], dtype=np.int64)
    return _unpacked(raw), np.diff(before[ends], prepend=0)


class _Lists:
    """Hits of some units, in order of unit and position, and where each word has its own."""

    def __init__(self, batch: pa.RecordBatch, inverse: np.ndarray, words: int):
        hits = batch.column("hits")
        rows = hits.flatten()
        heads, steps, letters = (rows.field(rows.type.get_field_index(c)) for c in PACKED)
        self.n = batch.num_rows
        owner = np.repeat(np.arange(self.n), np.diff(hits.offsets.to_numpy()))
        numbers, count = _numbers(heads)
        codes, sizes = numbers[::2], numbers[1::2]
        owner = np.repeat(owner, count // 2)
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
        of_list, pos = summed_gaps(pa.ListArray.from_arrays(pa.array(bounds), pa.array(_numbers(steps)[0])))
        unit, code = owner[of_list], codes[of_list]
        order = np.argsort(unit * APART + pos, kind="stable")
        self.unit, self.pos, self.code = unit[order], pos[order], code[order]
        self.inverse = inverse[_bytes(letters)][order]
        self.by_code = np.argsort(self.code, kind="stable")
        self.bounds = np.searchsorted(self.code[self.by_code], np.arange(words + 1))

    def of(self, code: int) -> np.ndarray:
        return self.by_code[self.bounds[code] : self.bounds[code + 1]]

    def holding(self, codes: list[int]) -> np.ndarray:
        """Units that have every one of the words."""
        found = sorted((self.of(code) for code in codes), key=len)
        return reduce(lambda a, b: np.intersect1d(a, np.unique(b)) if len(a) else a, (self.unit[x] for x in found[1:]), np.unique(self.unit[found[0]]))

    def hits(self, codes: list[int], units: np.ndarray | None = None) -> Hits:
        """Hits of the words, in all units or in some, which are numbered in their order."""
        at = np.sort(np.concatenate([self.of(code) for code in codes]))
        if units is not None:
            inside = np.zeros(self.n, bool)
            inside[units] = True
            at = at[inside[self.unit[at]]]
        unit = self.unit[at]
        pair = unit if units is None else np.searchsorted(units, unit)
        return Hits(pair, self.pos[at], self.code[at], self.inverse[at])

    def ranks(self, query: _Query) -> tuple[np.ndarray, np.ndarray]:
        """Units that match a group with a word to find, and their ranks."""
        found = [self.holding(need) for need in query.needs]
        units = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        if not len(units):
            return units, np.empty(0)
        rank, _ = fold(self.hits(query.codes, units), len(units), query.positive)
        there = ~np.isnan(rank)
        return units[there], rank[there]

    def spared(self, query: _Query) -> np.ndarray:
        """For every unit: is there a group that only excludes, of which it has nothing?"""
        spared = np.zeros(self.n, bool)
        for literals in query.excluding:
            hits = self.hits(sorted({code for words in literals for code, _ in words}))
            hit = np.zeros(self.n, bool)
            for words in literals if query.query_id is not None else ():
                hit[hits.pair[hits.occurrences(words)[0]]] = True
            spared |= ~hit
        return spared


def fold_units(
    literals: list[tuple], codes: dict[str, int], weights: dict[str, float], kept: tuple[str, ...] | list[str] = (),
    hits_at_once: int = 1 << 19, rows_at_once: int = 1 << 16,
):
    """Task body over (unit_id, hits(lists, steps, letters), listed): ranks of all queries of a batch.

    `literals` holds (query_id, group_no, literal_no, [(lexeme, offset)], negated).  Listed units
    also answer the groups that only exclude, with rank 0.  A query without id matches no hit.
    Columns of the units that are `kept` go with every row.
    """
    inverse = np.zeros(256)
    for name, weight in weights.items():
        inverse[ord(name)] = 1.0 / weight
    of_query: dict[int | None, list] = {}
    for query_id, *literal in literals:
        of_query.setdefault(query_id, []).append(tuple(literal))
    queries = [_Query(query_id, mine, codes) for query_id, mine in of_query.items()]

    def found(part: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray, np.ndarray]]:
        lists = _Lists(part, inverse, len(codes))
        listed = part.column("listed").to_numpy(zero_copy_only=False).astype(bool)
        for query in queries:
            units, rank = lists.ranks(query) if query.query_id is not None else (np.empty(0, np.int64), np.empty(0))
            if query.excluding and listed.any():
                free = lists.spared(query) & listed
                free[units] = False
                others = np.flatnonzero(free)
                units, rank = np.append(units, others), np.append(rank, np.zeros(len(others)))
            if len(units):
                yield query.query_id, units, rank

    def rows(part: pa.RecordBatch, held: list) -> pa.RecordBatch:
        ids = [pa.repeat(pa.scalar(query_id, pa.int64()), len(units)) for query_id, units, _ in held]
        units = np.concatenate([units for _, units, _ in held])
        ranks = np.concatenate([rank for _, _, rank in held])
        own = [part.column(c).take(pa.array(units)) for c in ("unit_id", *kept)]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(ids), own[0], pa.array(ranks), *own[1:]], ["query_id", "unit_id", "text_rank", *kept]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_of = batch.column("hits").flatten()
            letters = rows_of.field(rows_of.type.get_field_index("letters"))
            for first, last in _parts(batch, pc.binary_length(letters).to_numpy(), hits_at_once):
                part = batch.slice(first, last - first)
                held, count = [], 0
                for one in found(part):
                    held.append(one)
                    count += len(one[1])
                    if count >= rows_at_once:
                        yield rows(part, held)
                        held, count = [], 0
                if held:
                    yield rows(part, held)

    return run
