"""Overlapping token windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.text import space_tokens, strip_space

MAX_TOKENS = 384
OVERLAP = 64
LEGACY_MODEL = "legacy"

Tokenizer = Callable[[Column], Column]


def join_windows(windows: Column) -> Column:
    return F.transform(windows, lambda tokens: F.array_join(tokens, " "))


def token_windows(
    text: Column,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    tokenize: Tokenizer | None = None,
    detokenize: Tokenizer | None = None,
) -> Column:
    """Array of window texts of a content; `[content]` when no window has any text.

    `tokenize` turns a text into an array of tokens and `detokenize` an array of token
    windows into an array of texts; both may be pandas UDFs.  The default tokens are
    white-space separated.
    """
    if not 0 <= overlap < max_tokens:
        raise ValueError("windows would not advance")
    step = max_tokens - overlap

    def cut(tokens: Column) -> Column:
        extra = F.ceil((F.size(tokens) - max_tokens) / F.lit(step)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(extra, F.lit(0))),
            lambda i: F.slice(tokens, i * step + 1, F.lit(max_tokens)),
        )

    # The one-element arrays bind a value once for several uses.
    windows = F.transform(F.array((tokenize or space_tokens)(text)), cut)[0]
    stripped = F.transform((detokenize or join_windows)(windows), strip_space)
    kept = F.array(F.filter(stripped, lambda window: window != ""))
    return F.transform(
        kept, lambda texts: F.when(F.size(texts) > 0, texts).otherwise(F.array(text))
    )[0]


def chunk(
    df: DataFrame,
    text_col: str,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    tokenize: Tokenizer | None = None,
    detokenize: Tokenizer | None = None,
) -> DataFrame:
    """One row per window: the other columns, `chunk_index` from 0 and `content`.

    Entirely row-local, so it needs no shuffle.
    """
    others = [c for c in df.columns if c != text_col]
    windows = token_windows(F.col(text_col), max_tokens, overlap, tokenize, detokenize)
    return df.select(*others, F.posexplode(windows).alias("chunk_index", "content"))


def rechunk(
    chunks: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap: int = OVERLAP,
    rechunk_legacy: bool = True,
    tokenize: Tokenizer | None = None,
    detokenize: Tokenizer | None = None,
) -> DataFrame:
    """`(document_id, chunk_index, content)` to encode again.

    A document stored as exactly one chunk of the legacy model is split anew; every other
    document keeps its chunk boundaries, renumbered from 0.
    """
    stored = F.array_sort(F.collect_list(F.struct("chunk_index", "content", "embedding_model")))
    documents = chunks.groupBy("document_id").agg(stored.alias("stored"))
    texts = F.transform("stored", lambda c: c["content"])
    if rechunk_legacy:
        first = F.col("stored")[0]
        legacy = (F.size("stored") == 1) & (first["embedding_model"] == LEGACY_MODEL)
        split = token_windows(first["content"], max_tokens, overlap, tokenize, detokenize)
        texts = F.when(legacy, split).otherwise(texts)
    return documents.select("document_id", F.posexplode(texts).alias("chunk_index", "content"))
