"""English lexicon: stop words removed, the rest reduced by the published English stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The usual English stop words.
STOP_WORDS = frozenset(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
    she her hers herself it its itself they them their theirs themselves what which who whom
    this that these those am is are was were be been being have has had having do does did
    doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again
    further then once here there when where why how all any both each few more most other some
    such no nor not only own same so than too very s t can will just don should now
    """.split()
)

# Words with a stem of their own, and words that stay as they are.
IRREGULAR = dict(
    pair.split(":")
    for pair in (
        "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli "
        "early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas "
        "cosmos:cosmos bias:bias andes:andes"
    ).split()
)
FINAL = frozenset("inning outing canning herring earring proceed exceed succeed".split())

# Endings replaced when they lie in the first region, then in the second.
STEP_2 = """
    tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate
    ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive
    iviti:ive biliti:ble bli:ble fulli:ful lessli:less
"""
STEP_3 = """
    tional:tion ational:ate alize:al icate:ic iciti:ic ical:ic ful: ness:
"""
STEP_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize"

_VOWEL = "[aeiouy]"
_REGION = re.compile(f"{_VOWEL}[^aeiouy](.*)")
_SPECIAL_REGION = re.compile("(?:gener|commun|arsen)(.*)")
_SHORT_END = re.compile("(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$")
_DOUBLE = re.compile("(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$")


def _table(text: str) -> list[tuple[str, str]]:
    pairs = (rule.partition(":")[::2] for rule in text.split())
    return sorted(pairs, key=lambda rule: -len(rule[0]))


_RULES_2, _RULES_3 = _table(STEP_2), _table(STEP_3)
_ENDINGS_4 = sorted(STEP_4.split(), key=len, reverse=True)


def _after(pattern: re.Pattern, word: str, start: int = 0) -> int:
    found = pattern.search(word, start)
    return found.start(1) if found else len(word)


def _longest(word: str, endings) -> str | None:
    return next((e for e in endings if word.endswith(e)), None)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")):
        return word[:-1] if re.search(_VOWEL, word[:-2]) else word
    return word


def _past(word: str, region: int) -> str:
    ending = _longest(word, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if ending is None:
        return word
    base = word[: -len(ending)]
    if ending.startswith("eed"):
        return base + "ee" if len(base) >= region else word
    if not re.search(_VOWEL, base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if _DOUBLE.search(base):
        return base[:-1]
    return base + "e" if region >= len(base) and _SHORT_END.search(base) else base


def _replace(word: str, rules: list[tuple[str, str]], region: int) -> str | None:
    """The word with its longest listed ending replaced; None when no ending is listed."""
    for ending, new in rules:
        if word.endswith(ending):
            base = word[: -len(ending)]
            return base + new if len(base) >= region else word
    return None


def _derived(word: str, first: int, second: int) -> str:
    changed = _replace(word, _RULES_2, first)
    if changed is None:
        changed = word
        if word.endswith("logi") and len(word) - 3 >= first:
            changed = word[:-1]
        elif word.endswith("li") and len(word) - 2 >= first and word[-3:-2] in tuple("cdeghkmnrt"):
            changed = word[:-2]
    word = changed
    if word.endswith("ative"):
        word = word[:-5] if len(word) - 5 >= second else word
    else:
        word = _replace(word, _RULES_3, first) or word
    ending = _longest(word, _ENDINGS_4)
    if ending is not None:
        return word[: -len(ending)] if len(word) - len(ending) >= second else word
    if word.endswith(("sion", "tion")) and len(word) - 3 >= second:
        return word[:-3]
    return word


@lru_cache(maxsize=200_000)
def english_stem(word: str) -> str:
    """Stem of a lower-case word by the second version of the English suffix stripper."""
    if len(word) < 3:
        return word
    if word in IRREGULAR:
        return IRREGULAR[word]
    word = re.sub("(^|(?<=[aeiouy]))y", "Y", word)
    special = _SPECIAL_REGION.match(word)
    first = special.start(1) if special else _after(_REGION, word)
    second = _after(_REGION, word, first)
    word = _plural(word)
    if word in FINAL:
        return word
    word = _past(word, first)
    if word[-1] in "yY" and len(word) > 2 and word[-2] not in "aeiouy":
        word = word[:-1] + "i"
    word = _derived(word, first, second)
    if word.endswith("e"):
        place = len(word) - 1
        if place >= second or (place >= first and not _SHORT_END.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _lexemes(tokens: pd.Series) -> pd.Series:
    return tokens.map(
        lambda row: [None if w in STOP_WORDS else english_stem(w) for w in row]
    )


def english_lexicon(tokens: Column) -> Column:
    """Stems of an array of words, NULL for stop words.

    Works inside the row, with each worker remembering the stems of frequent words, so the
    vocabulary is never shuffled.
    """
    return _lexemes(tokens)
