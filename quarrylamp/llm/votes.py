"""Quality rules as weak supervision: rules vote or abstain, their accuracies are estimated.

Every rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the counts
of vote patterns, of which there are at most 3 ** rules, estimates how often each rule votes
which way on good and on bad texts; the posterior probability of a good text takes the place of
all-must-pass filtering.  All work on rows is DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.llm.common import BLANKS, stored, whole_text

#: The characters counted as symbols and those that bound words.
SYMBOLS = "#*$%&|<>"
BLANK_CHARACTERS = " \t\n\x0b\f\r"


def _filled(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARACTERS)) != ""


def measured(documents: DataFrame) -> DataFrame:
    """Counts of every row's text: doc_id and the columns below, all long.

    n_words; word_chars (code points in words); n_symbols; n_lines (with a word); n_dup_lines
    (equal to an earlier line); n_repeat_words (words in 3-word windows found twice or more in
    the text); n_upper (capital letters); n_distinct (different words).  A null or blank text
    has zeros.  Windows are compared by a 64-bit hash within their text.
    """
    text = documents.select("doc_id", whole_text("text").alias("text"))
    trimmed = F.btrim("text", F.lit(BLANK_CHARACTERS))
    cut = text.select(
        "doc_id",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)).alias("words"),
        F.filter(F.split("text", "\n"), _filled).alias("lines"),
        F.length(F.regexp_replace("text", "[^" + SYMBOLS + "]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).alias("n_upper"),
    )
    count = F.size("words")
    windows = F.when(
        count >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    )
    hashed = cut.select(
        "doc_id", "n_symbols", "n_upper",
        count.alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only texts with a repeated window are sorted to find where.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn(
        "ordered",
        F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("windows")
    twice = F.filter(
        "ordered",
        lambda p, k: (p["h"] == F.when(k > 0, F.get("ordered", k - 1)["h"])).eqNullSafe(True)
        | (p["h"] == F.get("ordered", k + 1)["h"]).eqNullSafe(True),
    )
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda p: F.array(p["i"], p["i"] + 1, p["i"] + 2))))
    counts = [
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_distinct",
    ]
    return ordered.select(
        "doc_id",
        *(F.col(c).cast("long").alias(c) for c in counts),
        F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule's vote on a row of `measured`.

    A rule that knows one kind of junk votes bad where it sees it and abstains elsewhere: not
    seeing it says nothing about the other kinds.  `prose` and `balance` look at the whole and
    vote good too.  A text without words is bad by `length` alone.
    """
    words, chars = F.col("n_words"), F.col("word_chars")
    some, enough = words > 0, words >= 20
    length = chars / F.when(some, words)
    rich = F.col("n_distinct") * F.sqrt(words)
    return {
        "symbols": _vote(F.col("n_symbols") > 0.15 * words),
        "windows": _vote(enough & (F.col("n_repeat_words") > 0.3 * words)),
        "lines": _vote((F.col("n_lines") >= 4) & (F.col("n_dup_lines") > 0.4 * F.col("n_lines"))),
        "capitals": _vote(enough & (F.col("n_upper") > 0.4 * chars)),
        "variety": _vote(enough & (rich < 2.0 * words)),
        "word_length": _vote(some & ~length.between(2.0, 15.0)),
        "length": _vote(words < 10),
        "prose": _vote(
            some & (F.col("n_symbols") + F.col("n_upper") > 0.5 * chars),
            enough & (F.col("n_symbols") <= 0.02 * words) & (F.col("n_upper") <= 0.2 * chars)
            & (F.col("n_repeat_words") <= 0.3 * words),
        ),
        "balance": _vote(enough & ~length.between(2.5, 12.0), enough & length.between(3.0, 10.0) & (rich >= 4.0 * words)),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200, smooth: float = 0.5):
    """Fit the two-class model to counts of vote patterns.

    Returns (bias, weights): the log odds of a good text before any vote, and per rule the log
    odds that each vote adds.  Starts from "bad where more rules say bad than a lone doubt can
    outweigh" and repeats both steps until the log odds settle.  No pattern: all zero.
    """
    rules_ = len(next(iter(patterns), ()))
    if not patterns:
        return 0.0, []
    good = {p: 0.1 if -1 in p else 0.95 for p in patterns}
    before = None
    for _ in range(rounds):
        total = [smooth, smooth]
        votes = [[{v: smooth for v in (-1, 0, 1)} for _ in range(rules_)] for _ in range(2)]
        for pattern, n in patterns.items():
            for side, part in ((0, n * (1 - good[pattern])), (1, n * good[pattern])):
                total[side] += part
                for k, v in enumerate(pattern):
                    votes[side][k][v] += part
        bias = math.log(total[1] / total[0])
        weights = [
            {
                v: math.log(votes[1][k][v] / (total[1] + 2 * smooth)) - math.log(votes[0][k][v] / (total[0] + 2 * smooth))
                for v in (-1, 0, 1)
            }
            for k in range(rules_)
        ]
        for pattern in patterns:
            odds = bias + sum(weights[k][v] for k, v in enumerate(pattern))
            good[pattern] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
        now = [bias, *(w[v] for w in weights for v in (-1, 0, 1))]
        if before and max(abs(x - y) for x, y in zip(now, before)) < 1e-6:
            break
        before = now
    return bias, weights


def quality(documents: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """Posterior quality of every row of `documents` (doc_id, text; other columns are ignored).

    Returns the columns of `measured`, one vote_<rule> each, base_failed (under 50 words, or
    over half of the words in repeated windows), posterior and kept (not base_failed and
    posterior >= keep_at).  Null and blank texts have no words and fail.  Repeated rows stay
    repeated, ties cannot arise, and an empty table gives an empty one.
    """
    judged = rules()
    names = [f"vote_{name}" for name in judged]
    voted = stored(measured(documents).withColumns(dict(zip(names, judged.values()))))
    # At most 3 ** rules rows reach the driver.
    patterns = {
        tuple(row[n] for n in names): row["n"]
        for row in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()
    }
    bias, weights = estimate(patterns)
    odds = F.lit(bias)
    for name, weight in zip(names, weights):
        odds = odds + F.when(F.col(name) == 1, weight[1]).when(F.col(name) == -1, weight[-1]).otherwise(weight[0])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at))
    )
