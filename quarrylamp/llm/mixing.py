"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (by a hash of their id) into one stream of words, cut
into blocks of equal word count.  Slot i of the schedule sits at the van der Corput point of i;
the cumulative target weights say which source the point belongs to.  The n-th slot of a source
takes its n-th block, beginning again when the stream is used up.  All of it is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.llm.common import BLANKS, stored

#: Bits of a van der Corput point; a double holds them exactly.
POINT_BITS = 48


def word_count(text: Column) -> Column:
    """Number of words of a text column (null: 0)."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed.isNull() | (trimmed == ""), 0).otherwise(
        F.size(F.split(trimmed, BLANKS))
    ).cast("long")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """Number rows from 0 in a global order, without a one-task window over the rows.

    Rows are dealt out by range and numbered within their partition; partitions are then
    offset by the counts before them, a table of one row a partition.
    """
    held = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (
        held.withColumn("_part", part)
        .join(F.broadcast(counts), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1))
        .drop("_at", "_part", "_before")
    )


def running_sum(df: DataFrame, place: str, value: str, name: str, span: int = 4096) -> DataFrame:
    """Add the sum of `value` up to and including each row in the order of `place` (0, 1, ...)."""
    cut = df.withColumn("_span", F.floor(F.col(place) / span))
    sums = cut.groupBy("_span").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(
        Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.select("_span", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.sum(value).over(Window.partitionBy("_span").orderBy(place))
    return (
        cut.withColumn("_inner", inner).join(sums, "_span")
        .withColumn(name, F.col("_inner") + F.col("_before"))
        .drop("_span", "_inner", "_before")
    )


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3) -> DataFrame:
    """Add `weight` and `target` to a table of (source, source_size): shares of the total.

    Weights repeat over the sources in code point order, null last.  A target stops at `cap`
    times its source's size; the excess is shared out anew by weight among the rest until none
    is above.  Each round is one small aggregate.
    """
    numbered = ranked(sources, [F.col("source").asc_nulls_last()], "place")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighed = numbered.withColumns(
        {
            "weight": F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int")),
            "most": F.col("source_size") * float(cap),
        }
    )
    total, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level = float(total) / float(weight) if weight else 0.0
    while True:
        full = F.col("most") <= F.col("weight") * level
        filled, left = weighed.agg(
            F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not left:
            break
        raised = (float(total) - float(filled or 0)) / float(left)
        if raised <= level:
            break
        level = raised
    return weighed.select(
        "source", "source_size", "weight", F.least("most", F.col("weight") * level).alias("target")
    )


def van_der_corput(index: Column, bits: int = POINT_BITS) -> Column:
    """Point of a non-negative whole number in [0, 1): its binary digits mirrored at the point."""
    mirrored = F.rpad(F.reverse(F.bin(index)), bits, "0")
    return F.conv(mirrored, 2, 10).cast("double") / float(1 << bits)


def schedule(sized: DataFrame, cells: int = 1 << 12, span: int = 1 << 16) -> DataFrame:
    """Slots (slot, turn, and the columns of `sized`) for a table (source, slots, ...).

    `slots` is a source's expected number of slots.  Slot i goes to the source whose stretch of
    the cumulative shares holds point i; turn is the slot's rank within its source, from 0.
    """
    kept = sized.columns
    numbered = ranked(sized.filter("slots > 0"), [F.col("source").asc_nulls_last()], "place")
    summed = stored(running_sum(numbered, "place", "slots", "upto"))
    total, rows = summed.agg(F.max("upto"), F.count("*")).first()
    total = float(total or 0)
    count = round(total)
    low = (F.col("upto") - F.col("slots")) / (total or 1.0)
    high = F.when(F.col("place") == rows - 1, 2.0).otherwise(F.col("upto") / (total or 1.0))
    # Points meet stretches by cell of the unit interval; a stretch over many cells is repeated.
    cell = lambda x: F.least(F.floor(x * cells), F.lit(cells - 1))
    stretches = summed.select(*kept, low.alias("low"), high.alias("high")).withColumn(
        "cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high"))))
    )
    slots = sized.sparkSession.range(count).select(
        F.col("id").alias("slot"), van_der_corput(F.col("id")).alias("point")
    ).withColumn("cell", F.floor(F.col("point") * cells))
    placed = slots.join(stretches, "cell").filter("low <= point and point < high")
    placed = placed.select("slot", *kept, F.floor(F.col("slot") / span).alias("_span"))
    # Ranks in two steps: spans of slot numbers, then slots within a span.
    counts = placed.groupBy("source", "_span").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy("source").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    )
    counts = counts.select(
        F.col("source").alias("_source"), F.col("_span").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before")
    )
    inner = F.row_number().over(Window.partitionBy("source", "_span").orderBy("slot")) - 1
    return (
        placed.withColumn("_inner", inner)
        .join(counts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_span") == F.col("_at")))
        .select("slot", (F.col("_inner") + F.col("_before")).cast("long").alias("turn"), *kept)
    )


def streams(documents: DataFrame, sources: DataFrame, pieces: int) -> DataFrame:
    """Add `start`, `_piece`, `_row` and the source's columns to (source, doc_id, size).

    `start` is the number of words before a row in its source's stream, whose order is a hash
    of the doc_id.  The running sum is taken within ranges of the hash and over these ranges, so
    that one source's rows never meet in one task; the order does not depend on `pieces`.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    prefix = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    dealt = documents.withColumns({"_digest": digest, "_piece": F.floor(prefix * pieces / float(1 << 32))})
    sums = dealt.groupBy("source", "_piece").agg(F.sum("size").alias("_words"))
    before = F.sum("_words").over(
        Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    )
    sums = sums.select("source", F.col("_piece").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = sources.withColumnRenamed("source", "_source")
    sums = sums.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    sums = sums.withColumnRenamed("source", "_source")
    order = Window.partitionBy("source", "_piece").orderBy("_digest", "doc_id", "size")
    within = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        dealt.withColumns({"_within": F.coalesce(within, F.lit(0)), "_row": F.row_number().over(order)})
        .join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_at")))
        .withColumn("start", (F.col("_within") + F.col("_before")).cast("long"))
        .drop("_digest", "_within", "_source", "_at", "_before")
    )


def mix(
    documents: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    cap: int = 3,
    block: int = 1024,
    least_blocks: int = 1024,
) -> DataFrame:
    """How many words of every row the mix takes.

    `documents` has doc_id, text and source.  Returns (doc_id, source, size, source_size,
    target, taken).  Size is the number of words (null text: 0); taken counts repeats and is at
    most cap * size.  Blocks hold `block` words, or fewer in sources that would have under
    `least_blocks` of them, so that small sources meet their targets as closely.  A null source
    is a source of its own.  Repeated rows are taken as often as they stand there; rows without
    words have taken 0.  An empty table gives an empty one.  Reruns agree, as the stream order
    depends on doc_ids only.
    """
    sized = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / least_blocks)))
    aims = stored(
        targets(sources, weights, cap).drop("weight").withColumn("block", length.cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    )
    slots = schedule(aims.select("source", "blocks", (F.col("target") / F.col("block")).alias("slots")))
    # How often each block comes up; turns beyond `cap` rounds have nothing left to take.
    times = (
        slots.filter(F.col("turn") < F.col("blocks") * cap)
        .groupBy(F.col("source").alias("_source"), (F.col("turn") % F.col("blocks")).alias("_no"))
        .agg(F.count("*").alias("_times"))
    )
    laid = streams(sized, aims, pieces=max(256, sized.count() >> 16))
    first = F.floor(F.col("start") / F.col("block"))
    last = F.greatest(first, F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))
    end = F.least(F.col("start") + F.col("size"), (F.col("_block") + 1) * F.col("block"))
    words = end - F.greatest(F.col("start"), F.col("_block") * F.col("block"))
    keys = ["source", "_piece", "_row"]
    plain = ["doc_id", "size", "source_size", "target"]
    return (
        laid.withColumn("_block", F.explode(F.sequence(first, last)))
        .select(*keys, *plain, "_block", F.greatest(words, F.lit(0)).alias("_words"))
        .join(times, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_no")), "left")
        .groupBy(*keys)
        .agg(
            *(F.first(c).alias(c) for c in plain),
            F.sum(F.col("_words") * F.coalesce("_times", F.lit(0))).cast("long").alias("taken"),
        )
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def mixed(documents: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Repeat every row of `documents` as often as the mix takes it, to the nearest whole number.

    A document that the end of a source's last round cuts through counts as taken when at least
    half of it is.  All columns stay; rows without words are left out.
    """
    copies = (
        mix(documents, weights, cap).filter("size > 0").groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_copies"))
        .filter("_copies > 0")
    )
    rows = documents.filter(F.btrim("text", F.lit(" \t\n\x0b\f\r")) != "").select(
        "doc_id", F.struct(*documents.columns).alias("row")
    )
    return (
        rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_doc")))
        .withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .select("row.*")
    )
