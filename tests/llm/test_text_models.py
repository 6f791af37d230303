"""Suffix dedup, fingerprints, language-model scores, line dedup and licences against plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrylamp.llm import licences, linededup, losertree, ppm, simhash, suffixdedup
from quarrylamp.llm.components import connected_components

TEXT = "doc_id long, text string"


def _key(row):
    return tuple((x is None, str(x)) for x in row)


def same(got, want):
    assert sorted(map(tuple, got), key=_key) == sorted(map(tuple, want), key=_key)


@pytest.fixture(scope="module")
def rows(table):
    return [tuple(r) for r in table("documents").select("doc_id", "text").collect()] + brute.ODD


def test_loser_tree_merges_and_shares_prefixes():
    draw = random.Random(5)
    for _ in range(300):
        runs, want = [], []
        for r in range(draw.randint(1, 9)):
            strings = sorted(bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 8))) for _ in range(draw.randint(0, 9)))
            coded = list(losertree.front_coded(strings))
            runs.append(([s for s, _ in coded], [t for _, t in coded]))
            want += [(s, r, k) for k, s in enumerate(strings)]
        got = list(losertree.merged(runs))
        assert [(s, r, k) for r, k, s, _ in got] == sorted(want)
        for (_, _, before, _), (_, _, string, shared) in zip(got, got[1:]):
            assert shared == losertree.common_prefix(before, string)


@pytest.mark.parametrize("often", [8192, 3])
def test_repeated_strings_are_removed_exactly(spark, rows, often):
    # Clashing extra columns are no matter.
    table = spark.createDataFrame(rows, TEXT).withColumn("unit", F.lit("x")).withColumn("row", F.lit(1))
    got = suffixdedup.remove_repeats(table, 100, often).drop("kept").collect()
    same(got, brute.repeats(rows, 100))


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    draw = random.Random(2)
    part = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    texts = [(b"x" + part.encode() * 2), b"", part[700:1400].encode()]
    monkeypatch.setattr(suffixdedup, "STRETCH", 500)
    found = set()
    for rows, offsets, ends, data in suffixdedup.stretches(texts, 100):
        at, first, last, _ = suffixdedup.anchors(np.frombuffer(data, np.uint8), ends, 100)
        part_of = np.searchsorted(ends, at, side="right")
        begin = np.r_[0, ends[:-1]][part_of]
        for r, o, a, s, e in zip(rows[part_of], offsets[part_of], at - begin, first - begin, last - begin):
            for k in range(s, e + 1):
                assert k <= a <= k + 100 - suffixdedup.SEED
                found.add((int(r), int(o + k)))
    assert found == {(r, k) for r, t in enumerate(texts) for k in range(len(t) - 99)}


def test_a_unit_sends_one_row_for_each_run_of_suffixes():
    from quarrylamp.llm.units import _packed

    draw = random.Random(6)
    texts = [bytes(draw.choice(b"abcdefgh ") for _ in range(900)) for _ in range(20)]
    unit = pa.table([pa.array([7]), pa.array([_packed([*range(19), None], texts)])], names=["unit", "packed"])
    named = pa.Table.from_batches(suffixdedup._name(100)(iter(unit.to_batches())))
    asked = named.append_column("hot", pa.array([False] * named.num_rows))
    sent = suffixdedup._send(100, 3)(unit, asked).to_pylist()
    # A row for every suffix took most of the room in stored tables and shuffles.
    assert sorted(r["bucket"] for r in sent) == [0, 1, 2] and sum(r["row"] for r in sent) == named.num_rows
    for row in sent:
        columns = suffixdedup.unpacked_run(row["run"], row["row"])
        strings, last = [], b""
        for shared, tail, before, doc, start, place, stop in zip(*columns):
            last = last[:shared] + tail
            strings.append(last)
            assert texts[place][start:stop] == before + last and doc == (suffixdedup.LAST if place == 19 else place)
        assert strings == sorted(strings)


def test_the_first_of_a_digest_stays_over_batches():
    draw = random.Random(9)
    rows = [(draw.randrange(-4, 4), draw.randrange(2), draw.randrange(3), draw.randrange(3), u) for u in range(200)]
    least = {r[:2]: min(x[2:4] for x in rows if x[:2] == r[:2]) for r in rows}
    # A unit sends its strings of a bucket as one row, however many it has.
    units = [rows[k : k + 4] for k in range(0, len(rows), 4)]
    table = pa.Table.from_arrays(
        [
            pa.array(c, t) for c, t in zip(
                zip(*((suffixdedup.STRING, n, 4, None, None, None, 1, np.array(u, np.int64).tobytes()) for n, u in enumerate(units))),
                suffixdedup._SENT_TYPES,
            )
        ],
        names=suffixdedup._SENT_NAMES,
    )
    got = [r for b in suffixdedup._settled(100)(iter(table.to_batches(7))) for r in b.to_pylist()]
    assert sorted(r["row"] for r in got) == [r[4] for r in rows if r[2:4] > least[r[:2]]]
    assert all(r["stop"] == r["start"] + 100 and rows[r["row"]][3] == r["start"] and r["row"] // 4 == r["unit"] for r in got)


def test_suffix_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], TEXT)
    assert suffixdedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("radius, block", [(1, 64), (2, 7), (2, 4096), (3, 4096), (5, 100)])
def test_bit_planes_find_all_close_pairs(radius, block):
    draw = np.random.default_rng(radius)
    prints = set()
    for base in draw.integers(0, 1 << 63, 30).tolist():
        for _ in range(7):
            value = base
            for bit in draw.integers(0, 64, draw.integers(0, 6)).tolist():
                value ^= 1 << bit
            prints.add(value)
    prints = np.array(sorted(prints), np.uint64)
    i, j = simhash.close_pairs(prints, radius, block)
    values = prints.tolist()
    want = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if (values[a] ^ values[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_near_duplicates(spark, rows):
    table = spark.createDataFrame(rows, TEXT).withColumn("print", F.lit("clash"))
    found = simhash.near_duplicates(table)
    same(found.select("doc_id", simhash.hex_print(F.col("print")), "component_id").collect(), brute.classes(rows, 2))
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_one_of_similar_texts_stays(spark, rows):
    draw = random.Random(8)
    copies = []
    for doc, text in rows[:60]:
        tokens = (text or "").split(" ")
        for edits in (0, 1, len(tokens) // 60, len(tokens) // 12):
            changed = tokens.copy()
            for _ in range(edits):
                changed[draw.randrange(len(changed))] = f"new{draw.randrange(10 ** 6)}"
            copies.append((2000 + len(copies), " ".join(changed)))
    some = rows + copies
    table = spark.createDataFrame(some, TEXT).withColumn("turn", F.lit(5)).withColumn("id", F.lit("x"))
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    named = [r.doc_id for r in kept.filter("doc_id is not null").collect()]
    want = brute.alike([r for r in some if r[0] is not None])
    assert len(named) == len(set(named)) and want <= set(named)
    assert len(set(named) - want) <= 0.02 * len(want)
    assert kept.filter("doc_id is null").count() == sum(d is None for d, _ in some)
    assert simhash.keep_one(table.limit(0)).count() == 0


def _kept_of_pairs(spark, texts):
    """Numbers of pairs (texts 2k and 2k + 1) of which not exactly the first stays."""
    table = spark.createDataFrame(list(enumerate(texts)), TEXT)
    kept = {r.doc_id for r in simhash.keep_one(table).collect()}
    return [k for k in range(len(texts) // 2) if {2 * k, 2 * k + 1} & kept != {2 * k}]


def test_near_copies_within_a_family_of_template_pages(spark):
    draw = random.Random(11)
    page = [f"page{k}" for k in range(240)]
    texts = []
    for k in range(400):
        own = page.copy()
        for place in draw.sample(range(0, 240, 10), 8):
            own[place] = f"own{draw.randrange(10 ** 9)}"
        other = own.copy()
        other[draw.randrange(2, 238)] = f"edit{k}"
        texts += [" ".join(own), " ".join(other)]
    sets = [frozenset(simhash.shingles(t.encode().split(), 5).tolist()) for t in texts]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    assert not any(len(a & b) >= 0.8 * len(a | b) for a in sets[::8] for b in sets[2::8])
    assert _kept_of_pairs(spark, texts) == []


def test_near_copies_with_an_added_or_cut_passage(spark):
    draw = random.Random(12)
    texts = []
    for k in range(400):
        size = draw.choice((12, 60, 160, 600))
        own = [f"w{draw.randrange(10 ** 6)}" for _ in range(size)]
        # 0.8 of the shingles exactly, or a little more.
        more = draw.randint(1, (size - 4) // 4)
        if k % 2:
            texts += [" ".join(own), " ".join(own + [f"n{draw.randrange(10 ** 6)}" for _ in range(more)])]
        else:
            texts += [" ".join(own), " ".join(own[: size - max(1, (size - 4) // 5)])]
    assert _kept_of_pairs(spark, texts) == []


def test_meetings_compare_all_pairs_once_over_batches_and_blocks(monkeypatch):
    draw = random.Random(13)
    monkeypatch.setattr(simhash, "CELLS", 1 << 12)
    texts = {k: " ".join(draw.choice("abc") for _ in range(draw.randint(1, 14))) for k in range(150)}
    batch = pa.RecordBatch.from_pydict({
        "id": list(texts), "root": [k // 2 for k in texts], "text": list(texts.values()),
        "class": [simhash._class(simhash._tokens(t)) for t in texts.values()],
    })
    sets = {k: set(simhash.shingles(simhash._tokens(t), 2).tolist()) for k, t in texts.items()}
    want = {
        (a, b) for a in texts for b in texts
        if a < b and a // 2 != b // 2 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    }
    for blocks in (1, 3):
        heat = np.random.default_rng(blocks).integers(0, 255, 1 << 12).astype(np.uint8)
        spread = np.full(1 << 12, blocks, np.int16)
        rows = pa.Table.from_batches(simhash._prefixes(2, 0.8, heat, spread)(iter([batch])))
        rows = rows.sort_by([("key", "ascending"), ("root", "ascending")])
        made = pa.Table.from_batches(simhash._meetings(0.8)(iter(rows.to_batches(max_chunksize=7))))
        pairs = set(zip(made["a"].to_pylist(), made["b"].to_pylist()))
        assert want and want <= pairs
        assert all(a // 2 != b // 2 and sets[a] & sets[b] for a, b in pairs)


def test_a_large_bucket_gives_few_links():
    draw = random.Random(3)
    base = draw.getrandbits(64)
    prints = [base ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for _ in range(500)]
    prints += [draw.getrandbits(64) for _ in range(500)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    batch = pa.RecordBatch.from_pydict({"key": [1] * 1000, "print": signed, "id": list(range(1000))})
    (out,) = simhash._leaders(6)(iter([batch]))
    linked = list(zip(out.column("a").to_pylist(), out.column("b").to_pylist()))
    assert all((prints[a] ^ prints[b]).bit_count() <= 6 for a, b in linked)
    led = {b for _, b in linked}
    assert set(range(1, 500)) <= led and len(linked) < 1500
    leaders = [k for k in range(1000) if k not in led]
    assert not any((prints[a] ^ prints[b]).bit_count() <= 6 for a in leaders for b in leaders if a < b)


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)]
    draw = random.Random(1)
    draw.shuffle(chain)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language_model(spark, rows):
    some = rows[:40] + brute.ODD
    got = ppm.scores(spark.createDataFrame(some, TEXT).withColumn("key", F.lit("clash"))).collect()
    want = brute.base_scores(some, 7, 2)
    flat = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    same(flat, [(*w[:5], round(w[5], 6)) for w in want])
    train = [t for d, t in some if brute.remainder(d, 7) != 2]
    texts = dict(some[:12] + [r for r in brute.ODD if r[0]])
    for row in got:
        if row.doc_id in texts:
            assert row.score == pytest.approx(brute.trie_score(train, texts[row.doc_id], ppm.ORDER), rel=1e-9)
    assert ppm.scores(spark.createDataFrame([], TEXT)).count() == 0


def test_lookup_finds_keys_that_share_slots():
    draw = np.random.default_rng(4)
    keys = np.unique(np.r_[draw.integers(-(1 << 62), 1 << 62, 50_000), np.arange(-3000, 3000) << 40])
    draw.shuffle(keys)
    asked = draw.integers(0, len(keys), 200_000)
    look = ppm._Lookup(keys, keys * 0.5)
    assert (look(keys[asked]) == keys[asked] * 0.5).all()
    # Keys beyond the first table were searched by bisection, which took a fifth of the scoring time.
    assert look.rest is not None and len(look.rest.keys) < len(keys) / 2
    assert len(ppm._Lookup(np.empty(0, np.int64), np.empty(0))(np.empty(0, np.int64))) == 0


def test_language_model_without_training_texts(spark):
    held = next(k for k in range(100) if brute.remainder(k, 7) == 2)
    (row,) = ppm.scores(spark.createDataFrame([(held, "Ab")], TEXT)).collect()
    assert (row.train_tokens, row.n_tokens, row.n_known, row.base_score) == (0, 2, 0, 0.0)
    assert row.score == pytest.approx(-3 * np.log10(256))


def branches(line):
    """(branch, token) lists of a line by the rule of the template tree, on tokens, not digests."""
    tokens = line.split()
    n = len(tokens)
    p = min(n, 16)
    pieces = [tuple(tokens[n * k // p : n * (k + 1) // p]) for k in range(p)]
    digit = lambda piece: any(48 <= c <= 57 for t in piece for c in t)
    shown = [None if digit(x) else x for x in pieces]
    least = -(-3 * p // 4)
    if n < 5 or p - shown.count(None) < least:
        return []
    runs = min(4, p - least + 1)
    cut = [1 + (p - 1) * k // runs for k in range(runs + 1)]
    lead = None if digit(tokens[:1]) else tokens[0]
    return [(n, lead, k, tuple(shown[cut[k] : cut[k + 1]]), shown) for k in range(runs)]


def agree(a, b):
    return 4 * sum(x == y and x is not None for x, y in zip(a, b)) >= 3 * len(a)


def plain_line_dedup(rows):
    lines = []
    for at, (doc, text) in enumerate(rows):
        raw = (text or "").encode()
        value = xxhash.xxh64_intdigest(raw, 42)
        signed = value - (1 << 64) if value >> 63 else value
        lines += [(brute.LAST if doc is None else doc, signed, k, at, line) for k, line in enumerate(raw.split(b"\n"))]
    first, templates, gone = {}, {}, set()
    for doc, _, number, at, line in sorted(lines):
        if line.split() and first.setdefault(tuple(line.split()), doc) < doc:
            gone.add((at, number))
        for *branch, shown in branches(line):
            here = templates.setdefault(tuple(branch), [])
            owners = [owner for owner, template in here if agree(template, shown)]
            if not owners:
                here.append((doc, shown))
            elif min(owners) < doc:
                gone.add((at, number))
    out = []
    for at, (doc, text) in enumerate(rows):
        parts = (text or "").split("\n")
        kept = [line for k, line in enumerate(parts) if (at, k) not in gone]
        out.append((doc, text if len(kept) == len(parts) else "\n".join(kept), len(parts) if text else 0, len(parts) - len(kept)))
    return out


def test_line_dedup(spark, rows):
    extra = [
        (5, "Order 17 was sent to the town of Lind on Monday\nshort line\nan own line of some length here 1"),
        (6, "Order 18 was sent to the town of Lind on Monday\nshort line\nan own line of some length here 1"),
        (7, "Order 19 was sent to the town of Berg on Monday\n\nshort line"),
        (8, "Parcel 17 was sent to the town of Lind on Monday"),
        (9, "a line that comes twice in one text only\na line that comes twice in one text only"),
    ]
    some = [r for r in rows if r[0] is None or r[0] > 9] + extra
    table = spark.createDataFrame(some, TEXT).withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit("x"))
    out = linededup.deduped(table)
    assert out.columns == ["doc_id", "text", "lines", "n_lines", "n_dropped"]
    # One task grows one tree; trees of several tasks are merged.
    same(linededup.deduped(table.coalesce(1)).drop("lines").collect(), plain_line_dedup(some))
    same(out.drop("lines").collect(), plain_line_dedup(some))
    by_id = {r.doc_id: r for r in out.collect() if r.doc_id in range(5, 10)}
    assert by_id[5].n_dropped == 0
    assert by_id[6].text == ""
    assert by_id[7].text == ""  # the blank line stays
    assert by_id[8].n_dropped == 0  # the leading tokens may not
    assert by_id[9].n_dropped == 0
    assert linededup.deduped(table.limit(0)).count() == 0


def test_rows_of_numbers_are_not_one_template(spark):
    texts = [
        (1, "1 2 3 4 5\n2024-01-01,7 10:00 0.5 a1 b2 c3 d4 e5\n1 2 3 4 these words here 5 6 7 8 9\nError 404 in module 7 of the main server"),
        (2, "6 7 8 9 10\n2024-01-02,8 11:00 0.7 a2 b3 c4 d5 e6\n9 8 7 6 these words here 5 4 3 2 1\nError 500 in module 9 of the main server"),
        (3, "1 2 3 4 5\n2024-01-01,7 10:00 0.5 a1 b2 c3 d4 e5"),
    ]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.deduped(spark.createDataFrame(texts, TEXT)).collect()}
    # A sentence with fields is a template; a row of values goes only where all its values recur.
    assert got == {1: (texts[0][1], 0), 2: (texts[1][1].rsplit("\n", 1)[0], 1), 3: ("", 2)}


def test_templates_generalise(spark):
    texts = [
        (1, "Order shipped to Anna from the warehouse in Bergen today\nPosted by Anna in News today\nAll rights reserved."),
        (2, "Posted at noon in News today\nOrder shipped to Omar from the warehouse in Malmo today\nAll rights reserved."),
        (3, "Posted at dawn in News today\nPosted by Omar in News today\nOrder shipped to Ida from a warehouse in Malmo at once"),
        (3, "All rights  reserved. \n \n"), (None, "Posted by Ida in News today\nPosted in News today"),
        (4, "Posted at dawn in News today\nPosted under a name in News today"), (5, None), (6, ""),
    ]
    table = spark.createDataFrame(texts, TEXT)
    got = [(r.doc_id, r.text) for r in linededup.deduped(table).collect()]
    same(got, [
        texts[0], (2, "Posted at noon in News today"), (3, "Order shipped to Ida from a warehouse in Malmo at once"),
        (3, " \n"), (None, "Posted in News today"), (4, "Posted under a name in News today"), texts[6], texts[7],
    ])
    chars = linededup.without_recurring(table.withColumn("n_chars", F.length("text")).withColumn("n_dropped", F.lit("x")))
    assert chars.columns == ["doc_id", "text", "n_chars", "n_dropped"]
    assert chars.filter("n_chars is distinct from length(text)").count() == 0
    assert linededup.without_recurring(table.limit(0)).count() == 0


def test_hot_branch_and_very_long_lines(spark):
    """A third of all lines in one branch, with two templates, over many tasks and batches."""
    draw = random.Random(3)
    name = lambda: "".join(draw.choices("abcdefgh", k=9))
    tokens = [name() for _ in range(120_000)]
    long = " ".join(tokens)
    texts = [(k, f"User {name()} has logged in from the gate\nUser {name()} {name()} {name()} {name()} from the gate\n{name()} {name()}") for k in range(3000)]
    texts += [(5000, long), (5001, " ".join(tokens[:50_000] + ["changed"] + tokens[50_001:])), (5002, long + " more")]
    table = spark.createDataFrame(texts, TEXT).repartition(12)
    got = {r.doc_id: r for r in linededup.deduped(table).collect()}
    assert got[0].n_dropped == 0
    for k in range(1, 3000):
        assert got[k].text == texts[k][1].split("\n", 1)[1]
    assert [got[k].text == "" for k in (5000, 5001, 5002)] == [False, True, False]


def test_licences(spark):
    known = licences.known_licences(spark)
    texts = [
        (1, "released UNDER the mit licence"), (2, "Some text.\n  Licensed under CC-BY-NC 4.0!\nAll rights reserved."),
        (3, "Copyright (c) 2020 Someone\n" + dict(licences.whole_texts())["0BSD"]), (4, "Licensed under CC BY-NC 4.0 or not"),
        (5, None), (6, ""), (None, "All rights reserved"), (1, "All rights reserved"), (7, "© 1999 A. Body"),
    ]
    table = spark.createDataFrame(texts, TEXT).withColumn("digest", F.lit(0)).withColumn("licence", F.lit(""))
    got = {r.doc_id: (r.whole_licence, r.licences, r.n_licences) for r in licences.scan(table, known).collect()}
    assert got == {
        1: ("MIT", "MIT,all-rights-reserved", 2), 2: (None, "CC-BY-NC-4.0,all-rights-reserved", 2),
        3: ("0BSD", "0BSD", 1), 4: (None, "", 0), 5: (None, "", 0), 6: (None, "", 0),
        None: ("all-rights-reserved", "all-rights-reserved", 1), 7: (None, "", 0),
    }
    assert licences.scan(table.limit(0), known).count() == 0


def test_whole_licence_texts(spark):
    import json
    import textwrap

    with open(licences.TEXTS) as lines:
        texts = {one["licence"]: one["text"] for one in map(json.loads, lines)}
    rows, want = [], {}
    for number, (name, text) in enumerate(sorted(texts.items())):
        body = text.strip().partition("\n\n")[2]
        wrapped = [p if "Copyright (" in p else textwrap.fill(" ".join(p.split()), 60) for p in text.replace("=", "").split("\n\n")]
        versions = [
            text, text.upper(), body, "Copyright (c) 1999-2020, A. N. Other and others. All rights reserved.\n\n" + body,
            "\n\n".join(wrapped), text.replace("\n", "\r\n"),
        ]
        for k, version in enumerate(versions):
            rows.append((100 * number + k, version))
            want[100 * number + k] = name
        rows.append((100 * number + 50, text + "\nAnd one condition more."))
        want[100 * number + 50] = None
    table = spark.createDataFrame(rows, TEXT)
    got = {r.doc_id: r.whole_licence for r in licences.scan(table, licences.known_licences(spark)).collect()}
    wrong = {doc: (got[doc], name) for doc, name in want.items() if got[doc] != name}
    assert not wrong, wrong


def test_licence_notices(spark):
    rows = [
        (1, "Some text.\nThis program is licensed under the GNU GPL v3.\nmore"), (2, "// SPDX-License-Identifier: MIT"),
        (3, "SPDX-License-Identifier: BSD-2-Clause"), (4, "LICENCED UNDER THE APACHE LICENCE 2.0"),
        (5, "This work is licensed under the Creative Commons Attribution 4.0 International License."),
        (6, "x " * 600_000 + "\nReleased under the MIT License."), (7, "Licensed under the Imaginary License."),
    ]
    table = spark.createDataFrame(rows, TEXT).withColumn("licence", F.lit("x")).withColumn("digest", F.lit("y"))
    got = {r.doc_id: r.licences for r in licences.scan(table, licences.known_licences(spark)).collect()}
    assert got == {1: "GPL-3.0", 2: "MIT", 3: "BSD-2-Clause", 4: "Apache-2.0", 5: "CC-BY-4.0", 6: "MIT", 7: ""}


def test_line_dedup_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from quarrylamp.llm import linededup

    given = []
    monkeypatch.setattr(linededup, "give_back", lambda: given.append(1))
    text = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one same line here now\nx", "one same line here now\ny"])], ["doc", "text"])
    sent = list(linededup._grow(iter([text])))
    # The second line is settled, and so are its branches: all that the first one sends, and two short lines.
    assert given == [1] and [r["line"] for b in sent for r in b.to_pylist() if r["tags"] is None] == [0]
    list(linededup._merge(iter([])))
    list(linededup._rebuild(iter([])))
    assert len(given) == 3


def test_near_dedup_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(simhash, "give_back", lambda: given.append(1))
    text = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two"])], ["doc_id", "text"])
    assert sum(b.num_rows for b in simhash._tidy(simhash._profiles)(iter([text]))) == 1
    assert given == [1]
