"""Merging sorted runs of byte strings with a loser tree that knows common prefixes.

Every string of a run comes with the length of the prefix it shares with the string before it
(front coding).  The tree keeps, for every candidate, the prefix it shares with the string given
out last.  A candidate that shares more is smaller without a look at it; only candidates that
share equally much are compared, and from that length on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two strings that agree on their first `known` bytes."""
    end = min(len(a), len(b))
    differ = int.from_bytes(a[known:end], "big") ^ int.from_bytes(b[known:end], "big")
    return end - (differ.bit_length() + 7) // 8


def front_coded(strings: Sequence[bytes]) -> Iterator[tuple[int, bytes]]:
    """(shared, tail) of sorted strings: the prefix shared with the one before and the rest."""
    before = b""
    for string in strings:
        shared = common_prefix(before, string)
        yield shared, string[shared:]
        before = string


class _Run:
    """A front-coded run being read: its current string and the prefix shared with the last one."""

    __slots__ = ("shared", "tails", "at", "string")

    def __init__(self, shared: Sequence[int], tails: Sequence[bytes]):
        self.shared, self.tails, self.at, self.string = shared, tails, -1, b""

    def step(self) -> int:
        """Go to the next string; the prefix it shares with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= len(self.tails):
            return -1
        shared = self.shared[self.at]
        self.string = self.string[:shared] + self.tails[self.at]
        return shared


def merged(runs: Sequence[tuple[Sequence[int], Sequence[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge front-coded runs: (run, place in it, string, prefix shared with the string before).

    Equal strings come in the order of their runs.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads = [_Run(*run) for run in runs] + [_Run((), ())] * (width - len(runs))
    shared = [0 if head.step() >= 0 else -1 for head in heads]
    losers = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared prefix becomes that with the winner."""
        own, other = shared[a], shared[b]
        if own != other:
            return (a, b) if own > other else (b, a)
        if own < 0:
            return a, b
        x, y = heads[a].string, heads[b].string
        known = common_prefix(x, y, own)
        # Past the common prefix the smaller byte wins; a string that ends there is smaller.
        if known == len(x):
            first = known < len(y) or a < b
        else:
            first = known < len(y) and x[known] < y[known]
        if first:
            shared[b] = known
            return a, b
        shared[a] = known
        return b, a

    winners = [0] * width + list(range(width))
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if width > 1 else 0
    while shared[best] >= 0:
        head = heads[best]
        yield best, head.at, head.string, shared[best]
        shared[best] = head.step()
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
