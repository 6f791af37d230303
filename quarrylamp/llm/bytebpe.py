"""Byte-level BPE of whole texts: token boundaries by scans of transition functions, no regex.

A batch of texts becomes one array of code points, each mapped to a class (letter, number, other,
blank, apostrophe of a contraction, ...).  A class is a function from states to states; composing
such functions is associative, so the states at all places come from one prefix scan: blocks are
composed side by side, the blocks' functions are chained, and a second pass over the blocks gives
every place its state and tells where a piece starts.  The pieces are slices of the UTF-8 bytes;
each different piece is merged once per worker and then looked up.  Every token keeps its end in
the text's bytes, which is what decoding puts the tokens' bytes back by.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import give_back, slices, whole_text

# Classes of code points.  The last blank of a run goes with what follows if it is a plain space.
LETTER, NUMBER, OTHER, BLANK, SPACE_BEFORE, BLANK_BEFORE, SHORT, LONG, EDGE = range(9)
# States: what the piece that holds the last code point is; FRESH means that the next starts a piece.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_BLANKS, AFTER_SPACE, ONE_TO_GO, TWO_TO_GO = range(8)

#: The endings of contractions after an apostrophe, by length.
ENDINGS = {1: "stmd", 2: ("re", "ve", "ll")}

#: Entries that a worker's table of merged pieces may hold before it starts anew.
CACHE = 1 << 17

#: Bytes up to which pieces are merged side by side; longer ones are merged alone, with a heap.
SHORT_PIECE = 32

#: Bytes of text, or ids, that are worked on at once: a batch takes some fifty times its size.
AT_ONCE, IDS_AT_ONCE = 1 << 19, 1 << 17


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a piece start here) by class and state before."""
    after = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: IN_BLANKS}
    for kind, state in runs.items():
        after[kind] = state
        starts[kind, state] = False
        if kind != BLANK:
            starts[kind, AFTER_SPACE] = False
    # Letters that end a contraction; a piece starts after the last of them.
    after[LETTER, ONE_TO_GO], after[LETTER, TWO_TO_GO] = FRESH, ONE_TO_GO
    starts[LETTER, ONE_TO_GO] = starts[LETTER, TWO_TO_GO] = False
    # An apostrophe begins a contraction only where it begins a piece.
    for kind, state in ((SHORT, ONE_TO_GO), (LONG, TWO_TO_GO)):
        after[kind] = state
        for inside in (IN_OTHERS, AFTER_SPACE):
            after[kind, inside], starts[kind, inside] = IN_OTHERS, False
    after[SPACE_BEFORE] = AFTER_SPACE
    after[BLANK_BEFORE] = after[EDGE] = FRESH
    return after, starts


AFTER, STARTS = _machine()


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK for every code point, by the tables of the tiktoken library.

    Unicode grows from version to version, so the classes are asked of the library whose pieces
    are to be met: one run over all code points for each of the three classes, on the driver; tasks
    get the packed table.
    """
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(every)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def states(kinds: np.ndarray, block: int = 512) -> np.ndarray:
    """State before every place, by a scan over the transition functions of the classes."""
    n = len(kinds)
    rows = -(-n // block)
    padded = np.full(rows * block, EDGE, np.uint8)
    padded[:n] = kinds
    laid = np.ascontiguousarray(padded.reshape(rows, block).T)
    # The function of a whole block: eight results, one for each state it may be entered in.
    flat = AFTER.ravel()
    composed = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8))
    for column in laid:
        composed = flat[(column[:, None].astype(np.intp) << 3) + composed]
    # Blocks are chained by doubling: after step k a row holds the function of 2 ** k blocks.
    step = 1
    while step < rows:
        later = np.take_along_axis(composed[step:], composed[:-step].astype(np.intp), axis=1)
        composed = np.concatenate([composed[:step], later])
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = composed[:-1, FRESH]
    before = np.empty((block, rows), np.uint8)
    for at, column in enumerate(laid):
        before[at] = state
        state = flat[(column.astype(np.intp) << 3) + state]
    return before.T.ravel()[:n]


def piece_starts(points: np.ndarray, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Places where a piece starts; `edges` are the places of separators between texts."""
    kinds = classes[points]
    kinds[edges] = EDGE
    if not len(kinds):
        return np.empty(0, np.int64)
    blank = kinds == BLANK
    solid_next = np.append(kinds[1:] < BLANK, False)
    last = np.flatnonzero(blank & solid_next)
    mark = np.flatnonzero((points == ord("'")) & (kinds == OTHER))
    if len(mark):
        # A separator reads as no letter here, so endings never reach into the next text.
        seen = np.where(kinds == EDGE, 0, points)
        first, second = (seen[np.minimum(mark + k, len(seen) - 1)] for k in (1, 2))
        short = (mark + 1 < len(seen)) & np.isin(first, [ord(c) for c in ENDINGS[1]])
        long = (mark + 2 < len(seen)) & np.isin(first * (1 << 21) + second, [(ord(a) << 21) + ord(b) for a, b in ENDINGS[2]])
        kinds[mark[short]], kinds[mark[long]] = SHORT, LONG
    kinds[last] = np.where(points[last] == ord(" "), SPACE_BEFORE, BLANK_BEFORE)
    return np.flatnonzero(STARTS[kinds, states(kinds)])


def _ranks(path: str) -> dict[bytes, int]:
    """Ranks of byte strings in a file of them."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Tokens:
    """The bytes of all tokens in one array with their places: all that decoding needs."""

    def __init__(self, rank: dict[bytes, int]):
        tokens = [b""] * (max(rank.values(), default=-1) + 1)
        for token, number in rank.items():
            tokens[number] = token
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)


class Vocabulary(Tokens):
    """Tokens with the ranks of byte strings, and the pieces merged so far."""

    def __init__(self, path: str):
        self.rank = _ranks(path)
        super().__init__(self.rank)
        size = len(self.length)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        # Every way in which two tokens make a third.
        ways = sorted(
            (self.rank[token[:k]] * size + self.rank[token[k:]], rank)
            for token, rank in self.rank.items()
            for k in range(1, len(token))
            if token[:k] in self.rank and token[k:] in self.rank
        )
        self.pairs, self.pair_rank = np.array(ways, np.int64).reshape(-1, 2).T.copy()
        self.merged: dict[bytes, tuple[int, ...]] = {}

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together; the vocabulary's size where there is none."""
        key = left * len(self.length) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], len(self.length))

    def _merge_short(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of many pieces side by side: each round joins one pair of every piece.

        The pair of lowest rank is joined, the leftmost of equals; pieces without one are done.
        """
        none = len(self.length)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        pair = np.append(np.where(piece[1:] == piece[:-1], self._joined(ids[:-1], ids[1:]), none), none)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            counts = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(pair, starts)
            going = least < none
            stay = np.repeat(going, counts)
            done.append((piece[~stay], ids[~stay]))
            ids, piece, pair = ids[stay], piece[stay], pair[stay]
            least, counts = least[going], counts[going]
            if not len(ids):
                break
            hits = np.flatnonzero(pair == np.repeat(least, counts))
            at = hits[np.append(True, piece[hits][1:] != piece[hits][:-1])]
            ids[at] = least
            kept = np.ones(len(ids), bool)
            kept[at + 1] = False
            ids, piece, pair = ids[kept], piece[kept], pair[kept]
            # Every piece before has lost one place.
            at -= np.arange(len(at))
            for first in (at, at[at > 0] - 1):
                second = np.minimum(first + 1, len(ids) - 1)
                same = (piece[first] == piece[second]) & (first < second)
                pair[first] = np.where(same, self._joined(ids[first], ids[second]), none)
        owner = np.concatenate([p for p, _ in done])
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate([i for _, i in done])[order].tolist()
        stops = np.cumsum(np.bincount(owner, minlength=len(pieces))).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *stops], stops)]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Pairs wait in a heap and neighbours in linked lists, so the cost is n log n."""
        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts here; 0 once it is joined away
        before = list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := rank.get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts has changed since
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
                if (r := rank.get(piece[at : end[stop]])) is not None:
                    heapq.heappush(heap, (r, at, end[stop]))
            left = before[at]
            if left >= 0 and (r := rank.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
        ids, at = [], 0
        while at < n:
            ids.append(rank[piece[at : end[at]]])
            at = end[at]
        return tuple(ids)

    def ids(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of every piece; each different piece is merged once while the table holds it."""
        found = list(map(self.merged.get, pieces))
        if None not in found:
            return found
        new = list({piece for piece, ids in zip(pieces, found) if ids is None})
        known = {piece: (rank,) for piece in new if (rank := self.rank.get(piece)) is not None}
        short = [p for p in new if p not in known and len(p) <= SHORT_PIECE]
        known.update(zip(short, self._merge_short(short) if short else ()))
        if len(self.merged) + len(known) > CACHE:
            self.merged.clear()
        if len(known) <= CACHE:
            self.merged.update(known)
        known.update((p, self._merge_long(p)) for p in new if p not in known)
        return [known[piece] if ids is None else ids for piece, ids in zip(pieces, found)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> Tokens:
    return Tokens(_ranks(path))


def encode_texts(
    texts: list[str], vocabulary: Vocabulary, classes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, ends of the tokens in bytes of their text, number of ids per text)."""
    joined = "\0".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    edges = (np.cumsum(sizes) + np.arange(len(texts)))[:-1]
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = piece_starts(points, edges, classes)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    real = ~np.isin(starts, edges, assume_unique=True)
    # A separator starts a piece too, so each piece ends where the next one starts.
    bounds = np.append(place[starts], place[-1])
    first, last = bounds[:-1][real], bounds[1:][real]
    data = joined.encode()
    pieces = [data[a:b] for a, b in zip(first.tolist(), last.tolist())]
    found = vocabulary.ids(pieces)
    per_piece = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.int32, int(per_piece.sum()))
    text_of = np.searchsorted(edges, starts[real], side="left")
    per_text = np.bincount(text_of, per_piece, minlength=len(texts)).astype(np.int64)
    ends = np.cumsum(vocabulary.length[ids])
    stops = np.cumsum(per_text)
    before = np.concatenate([[0], ends])[stops - per_text]
    return ids, ends - np.repeat(before, per_text), per_text


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _encode(path: str, classes: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds = vocabulary(path), np.frombuffer(zlib.decompress(classes), np.uint8)
        for part in slices(batches, "text", AT_ONCE):
            ids, ends, counts = encode_texts(part.column("text").to_pylist(), known, kinds)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), _lists(ids, counts, pa.int32()), _lists(ends, counts, pa.int32())],
                ["doc_id", "ids", "ends"],
            )
        give_back()

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, ends) of every row's whole text; no shuffle.

    `path` names a file of ranks (base64 token, rank) that every machine has.  `ends` holds where
    each token ends in the text's UTF-8 bytes.  Null and empty texts give empty lists, rows without
    doc_id and repeated rows come out as they are, other columns are ignored.  A text is worked on
    whole, however long, up to the two gigabytes that a value may have.
    """
    return documents.select("doc_id", whole_text().alias("text")).mapInArrow(
        _encode(path, zlib.compress(code_point_classes().tobytes())), "doc_id long, ids array<int>, ends array<int>"
    )


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = token_bytes(path)
        for batch in batches:
            counts = np.diff(batch.column("ids").offsets.to_numpy())
            parts = np.cumsum(counts) // IDS_AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                some = batch.slice(first, last - first)
                ids = some.column("ids").flatten().to_numpy()
                ends = some.column("ends").flatten().to_numpy()
                count = counts[first:last]
                stops = np.cumsum(count)
                length = known.length[ids]
                sizes = np.zeros(len(count), np.int64)
                full = count > 0
                sizes[full] = ends[stops[full] - 1]
                base = np.cumsum(sizes) - sizes
                # Each token's bytes go before its end in its text.
                begin = np.repeat(base, count) + ends - length
                if len(ids) and (length.sum() != sizes.sum() or (np.diff(begin) != length[:-1]).any()):
                    raise ValueError("tokens and their places in the text do not belong together")
                source = np.repeat(known.place[ids] - begin, length) + np.arange(int(length.sum()))
                data = known.bytes[source].tobytes()
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                texts = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(count), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("ids"), texts], ["doc_id", "ids", "decoded"]
                )
        give_back()

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the tokens (doc_id, ids, ends) stand for; no shuffle.

    Empty lists give no bytes.  Tokens whose places do not fit their lengths raise an error.
    """
    return encoded.select("doc_id", "ids", "ends").mapInArrow(
        _decode(path), "doc_id long, ids array<int>, decoded binary"
    )


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
