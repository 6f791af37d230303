"""Plain versions of the operators' results, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

LAST = 1 << 63

#: Rows that every operator has to take: nulls, empty and blank texts, ties, repeated rows.
ODD = [
    (900, None), (901, ""), (902, " \t\n\x0b\f\r "), (903, "One two three"), (903, "One two three"),
    (904, "one"), (905, "ab" * 700), (906, "A\x1cb c d e ÄÖ É"), (None, "one two three four"),
    (None, None), (907, "x " * 3000), (908, "line of seven words in this text\n" * 9), (909, "Ünï\ncödé 7 # | % * &"),
]


def words(text):
    return (text or "").encode().lower().split()


def repeats(rows, length):
    first = {}
    ordered = sorted((LAST if d is None else d, k, (t or "").encode()) for k, (d, t) in enumerate(rows))
    for doc, _, text in ordered:
        for at in range(len(text) - length + 1):
            string = text[at : at + length]
            first[string] = min(first.get(string, (LAST + 1, 0)), (doc, at))
    out = []
    for doc, _, text in ordered:
        gone = bytearray(len(text))
        for at in range(len(text) - length + 1):
            if first[text[at : at + length]] < (doc, at):
                gone[at : at + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(text, gone) if not g)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((None if doc == LAST else doc, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def fingerprint(text):
    tokens = words(text)
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(rows, radius):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), LAST), doc)
    return [(doc, f"{prints[k]:016x}", least.get(find(k))) for k, (doc, _) in enumerate(rows)]


def alike(rows, size=5, least=0.8):
    """Smallest doc_id of every row's group of similar shingle sets, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    lowest = {}
    for g, (doc, _) in zip(group, rows):
        lowest[g] = min(lowest.get(g, LAST), doc)
    return {lowest[g] for g in group}


def remainder(doc, folds):
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds


def rule_counts(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(tokens[k : k + 3]) for k in range(len(tokens) - 2)]
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(covered),
    )


def base_scores(rows, folds, held):
    train = [t for d, t in rows if remainder(d, folds) != held]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
    out = []
    for doc, text in rows:
        c = [counts[w] for w in words(text)] + [len(train)]
        out.append((
            doc, remainder(doc, folds) == held, len(c), sum(x > 0 for x in c), n,
            sum(math.log10((x + 1) / (n + v + 1)) for x in c),
        ))
    return out


def trie_score(train, text, order, start=0xFE, end=0xFF):
    """log10 probability by escape and exclusion, straight from counts of all contexts."""
    counts = {}
    for t in train:
        data = bytes([start]) * order + (t or "").encode().lower() + bytes([end])
        for at in range(order, len(data)):
            for k in range(order + 1):
                counts.setdefault(data[at - k : at], Counter())[data[at]] += 1
    data = bytes([start]) * order + (text or "").encode().lower() + bytes([end])
    total = 0.0
    for at in range(order, len(data)):
        gone = set()
        for k in range(order, -1, -1):
            rest = {s: n for s, n in counts.get(data[at - k : at], {}).items() if s not in gone}
            whole = sum(rest.values()) + len(rest)
            if data[at] in rest:
                total += math.log10(rest[data[at]] / whole)
                break
            if rest:
                total += math.log10(len(rest) / whole)
                gone |= set(rest)
        else:
            total -= math.log10(256 - len(gone))
    return total
