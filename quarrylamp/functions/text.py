"""Text columns: whitespace, words, hashes, snippets and the score blend."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space, as members of a character class.
WHITESPACE = r"\s\p{Z}\x{85}"
WORD = r"[\p{L}\p{N}]+"


def strip_space(text: Column) -> Column:
    """Remove leading and trailing white space of any kind; a text without is only looked at at its ends."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(f"[{WHITESPACE}]"), F.regexp_replace(text, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", "")).otherwise(text)


def collapse_space(text: Column) -> Column:
    """Join the white-space separated fields of a text with single blanks."""
    return F.trim(F.regexp_replace(text, f"[{WHITESPACE}]+", " "))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(f"[^{WHITESPACE}]"), F.lit(True))


def space_tokens(text: Column) -> Column:
    """Array of white-space separated tokens."""
    return F.regexp_extract_all(text, F.lit(f"[^{WHITESPACE}]+"), F.lit(0))


def words(text: Column) -> Column:
    """Array of lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_hash(text: Column) -> Column:
    """Hex sha256 of the UTF-8 bytes."""
    return F.sha2(text, 256)


def snippet(*candidates: Column, length: int = 500) -> Column:
    """First non-null candidate, cut to `length` characters."""
    return F.substring(F.coalesce(*candidates, F.lit("")), 1, length)


def blend(
    vector_similarity: Column,
    chunk_rank: Column,
    document_rank: Column,
    vector_weight: float = 0.7,
    text_weight: float = 0.3,
) -> Column:
    """Weighted score: clamped vector part plus the better of the two text ranks."""
    zero = F.lit(0.0)
    vector_part = F.greatest(F.coalesce(vector_similarity, zero), zero)
    text_part = F.greatest(F.coalesce(chunk_rank, zero), F.coalesce(document_rank, zero))
    return (F.lit(vector_weight) * vector_part + F.lit(text_weight) * text_part).cast("double")
