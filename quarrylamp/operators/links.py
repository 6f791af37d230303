"""Depth-limited traversal of a stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylamp.functions.urls import canonical_url, normalize_url, same_host, source_host
from quarrylamp.sources.tables import materialized


def start_pages(starts: DataFrame, column: str = "url") -> DataFrame:
    """Distinct usable start URLs; those that are not absolute HTTP(S) are dropped."""
    return (
        starts.filter(canonical_url(F.col(column)).isNotNull())
        .select(normalize_url(F.col(column)).alias("start_url"))
        .distinct()
    )


#: Starts that share one word of bits.
WORD = 64


def numbered_starts(starts: DataFrame) -> DataFrame:
    """`(start_url, start_no)`: starts of one host lie next to each other, so they share words."""
    host = source_host(F.col("start_url"))
    laid = (
        starts.select("start_url").withColumn("_host", host)
        .repartitionByRange("_host", "start_url").sortWithinPartitions("_host", "start_url")
    )
    # Stored, as the numbers depend on how the rows were dealt.
    return materialized(laid.select("start_url", F.monotonically_increasing_id().alias("start_no")))


def reachable_sets(links: DataFrame, numbered: DataFrame, max_depth: int = 2) -> DataFrame:
    """`(url, word, bits, depth)`: the starts that reach a URL first at a depth, as sets of bits.

    Bit b of word w stands for the start numbered 64 * w + b.  All starts walk together: a depth
    is one join with the links and one union of bits per URL, reduced before it moves, so a URL
    that a thousand starts reach costs some words and not a thousand rows.
    """
    # A link to another host can never be followed, whatever the start.
    edges = materialized(
        links.filter(same_host(F.col("src_url"), F.col("dst_url")))
        .select(F.col("src_url").alias("url"), "dst_url")
        .distinct()
    )
    key = ["url", "word"]
    word = F.floor(F.col("start_no") / WORD).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(start_no, {WORD}) as int))")
    first = numbered.select(F.col("start_url").alias("url"), word.alias("word"), bit.alias("bits"))
    frontier = materialized(first.groupBy(*key).agg(F.bit_or("bits").alias("bits")))
    depths = [frontier.withColumn("depth", F.lit(1))]
    for depth in range(2, max(max_depth, 1) + 1):
        found = frontier.join(edges, "url").groupBy(F.col("dst_url").alias("url"), "word").agg(F.bit_or("bits").alias("bits"))
        seen = depths[0]
        for other in depths[1:]:
            seen = seen.unionByName(other)
        seen = seen.groupBy(*key).agg(F.bit_or("bits").alias("seen"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("long"))))
        frontier = materialized(
            found.join(seen, key, "left").select(*key, fresh.alias("bits")).filter("bits != 0")
        )
        depths.append(frontier.withColumn("depth", F.lit(depth)))
    every = depths[0]
    for other in depths[1:]:
        every = every.unionByName(other)
    return every


def reachable(links: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """`(start_url, url, depth)` of every URL reached from each start within `max_depth`.

    `links(src_url, dst_url)`, `starts(start_url)`.  The start itself has depth 1; only links
    to the start's host are followed and each URL is visited once.  Edges and each new depth are
    written to the shared folder, so that no depth is worked out twice.
    """
    numbered = numbered_starts(starts)
    sets = reachable_sets(links, numbered, max_depth)
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.getbit("bits", b) == 1))
    single = sets.select("url", "depth", "word", bit.alias("bit")).select(
        "url", "depth", (F.col("word") * WORD + F.col("bit")).alias("start_no")
    )
    return single.join(numbered, "start_no").select("start_url", "url", "depth")
