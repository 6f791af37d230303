"""Random landing rows and sampled query ids."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.operators.sizing import lookup_join

LANDING_COLUMNS = ["id", "url", "title", "description"]
KEY_BUCKETS = 4_096


def with_url(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("url").isNotNull() & (F.col("url") != ""))


def random_documents(
    documents: DataFrame, n: int, pivot: float | None = None, seed: int | None = None
) -> DataFrame:
    """The n rows whose stored key follows a pivot, wrapping round past the largest key."""
    if pivot is None:
        pivot = random.Random(seed).random()
    wrapped = F.col("random_key") < F.lit(pivot)
    return (
        with_url(documents)
        .orderBy(wrapped, "random_key", "id")
        .limit(max(n, 1))
        .select(*LANDING_COLUMNS)
    )


def random_documents_batch(
    documents: DataFrame, requests: DataFrame, bounded: bool | None = None
) -> DataFrame:
    """`(query_id, rank, id, url, title, description)` for many requests at once.

    `requests(query_id, n, pivot)`.  Rows and pivots are laid on one circle in key order:
    keys are split into even buckets, counted per bucket and numbered inside together with
    the pivots.  A request then asks for the n places after its pivot by equality, so no
    request is compared with every row.
    """
    spread = F.floor(F.col("random_key") * KEY_BUCKETS).cast("int")
    rows = with_url(documents).select("id", "random_key", spread.alias("bucket"))
    # At most one row per bucket comes back.
    sizes = dict(rows.groupBy("bucket").count().collect())
    earlier = [0]
    for bucket in range(KEY_BUCKETS):
        earlier.append(earlier[-1] + sizes.get(bucket, 0))
    total = earlier[-1]

    asked = requests.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.greatest(F.col("n"), F.lit(1)).alias("n"),
        F.col("pivot").alias("random_key"),
        F.floor(F.col("pivot") * KEY_BUCKETS).cast("int").alias("bucket"),
    )
    # A pivot sorts before the rows of the same key.
    in_order = (
        Window.partitionBy("bucket")
        .orderBy("random_key", F.col("id").isNotNull(), "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = rows.unionByName(asked, allowMissingColumns=True).withColumn(
        "place",
        F.element_at(F.lit(earlier), F.col("bucket") + 1)
        + F.coalesce(F.count("id").over(in_order), F.lit(0)),
    )
    steps = F.sequence(F.lit(0), F.least(F.col("n"), F.lit(total)) - 1)
    wanted = (
        placed.filter("id is null")
        .filter(F.lit(total) > 0)
        .select("query_id", "place", F.explode(steps).alias("step"))
        .select(
            "query_id",
            (F.col("step") + 1).cast("int").alias("rank"),
            ((F.col("place") + F.col("step")) % F.lit(max(total, 1))).alias("place"),
        )
    )
    places = placed.filter("id is not null").select("place", "id")
    picked = places.join(wanted, "place").drop("place")
    shown = with_url(documents).select(*LANDING_COLUMNS)
    return lookup_join(shown, picked, ["id"], bounded=bounded).select(
        "query_id", "rank", *LANDING_COLUMNS
    )


def next_ids(vectors: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each candidate the smallest stored id not below it: `(candidate, id)`.

    A forward as-of join: candidates and ids are merged into one ordering per id range, and
    ranges without a later id take the first id of the next range.
    """
    ids = vectors.select(F.col("id").cast("long").alias("id"))
    wanted = candidates.select(F.col("candidate").cast("long").alias("candidate")).distinct()
    width = 1 << 16
    first_of = ids.groupBy(F.floor(F.col("id") / width).alias("range")).agg(
        F.min("id").alias("first_id")
    )
    in_range = wanted.withColumn("range", F.floor(F.col("candidate") / width))
    merged = (
        ids.join(
            in_range.select("range").distinct(),
            F.floor(F.col("id") / width) == F.col("range"),
            "left_semi",
        )
        .select(F.floor(F.col("id") / width).alias("range"), F.col("id").alias("at"),
                F.col("id").alias("id"), F.lit(None).cast("long").alias("candidate"))
        .unionByName(
            in_range.select("range", F.col("candidate").alias("at"),
                            F.lit(None).cast("long").alias("id"), "candidate")
        )
    )
    # At equal places the stored id counts for the candidate, hence the range frame.  Windows run
    # from the largest place down: a frame that only grows is kept up row by row, while one that
    # shrinks is worked out anew for every row.
    ahead = (
        Window.partitionBy("range")
        .orderBy(F.col("at").desc())
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = merged.withColumn("next_id", F.min("id").over(ahead)).filter("candidate is not null")
    # Past the last id of its range a candidate takes the first id of the next range that has one.
    # Ranges are looked up the same way: within a block of ranges, else in the next block.
    later = found.filter("next_id is null").select("candidate", "range")
    block = F.floor(F.col("range") / width).alias("block")
    ranges = first_of.select(block, "range", "first_id", F.lit(None).cast("long").alias("candidate"))
    waiting = later.select(block, "range", F.lit(None).cast("long").alias("first_id"), "candidate")
    in_block = (
        Window.partitionBy("block").orderBy(F.col("range").desc()).rangeBetween(Window.unboundedPreceding, -1)
    )
    looked = (
        ranges.unionByName(waiting).withColumn("next_id", F.min("first_id").over(in_block))
        .filter("candidate is not null")
    )
    # 2 ** 32 ids make a block: few rows, also for very large tables.
    blocks = ranges.unionByName(waiting).groupBy("block").agg(F.min("first_id").alias("block_first"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chained = blocks.select("block", F.min("block_first").over(after).alias("next_first"))
    following = looked.join(chained, "block", "left").select(
        "candidate", F.coalesce("next_id", "next_first").alias("next_id")
    ).filter("next_id is not null")
    return (
        found.filter("next_id is not null")
        .select("candidate", F.col("next_id").alias("id"))
        .unionByName(following.select("candidate", F.col("next_id").alias("id")))
    )


def sample_ids(vectors: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """`n` distinct stored ids, drawn by hashed positions between smallest and largest.

    Positions between stored ids move up to the next one; at most 20 n positions are tried.
    """
    low, high = vectors.agg(F.min("id"), F.max("id")).first()
    if low is None:
        raise ValueError("the vector table is empty")
    code = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id"))), 1, 12), 16, 10)
    attempts = vectors.sparkSession.range(n * 20).select(
        F.col("id").alias("attempt"),
        (F.lit(low) + code.cast("long") % F.lit(high - low + 1)).alias("candidate"),
    )
    reached = attempts.join(next_ids(vectors, attempts), "candidate")
    picked = reached.groupBy("id").agg(F.min("attempt").alias("attempt"))
    sampled = picked.orderBy("attempt").limit(n).select("id")
    found = sampled.count()
    if found < n:
        raise ValueError(f"{n - found} of {n} ids were not reached")
    return sampled
