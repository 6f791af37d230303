"""Exact interpolated percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.operators.sizing import lookup_join

ACCURACY = 10_000
CELLS = 1_024


def percentiles(
    df: DataFrame, keys: list[str], value: str, fractions: list[float]
) -> DataFrame:
    """`(keys..., fraction, percentile)` with linear interpolation between neighbours.

    One way for groups of every size: a mergeable sketch brackets each percentile, the bracket is
    cut into cells that are counted, and only the cells that hold the two neighbours are put in
    order.  A neighbour that the counts do not place inside raises an error.  Without `keys` an
    empty table gives 0.0.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        found = percentiles(whole, ["_all"], value, fractions).drop("_all")
        asked = df.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double")
        return asked.join(found, "fraction", "left").select(
            "fraction", F.coalesce("percentile", F.lit(0.0)).alias("percentile")
        )
    step = 4.0 / ACCURACY
    edges = [max(f - step, 0.0) for f in fractions] + [min(f + step, 1.0) for f in fractions]
    values = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("value")
    )
    asked = [
        F.struct(
            F.lit(float(f)).alias("fraction"),
            F.col("edges")[i].alias("low"), F.col("edges")[len(fractions) + i].alias("high"),
        )
        for i, f in enumerate(fractions)
    ]
    brackets = (
        values.groupBy(*keys)
        .agg(F.percentile_approx("value", edges, ACCURACY).alias("edges"), F.count("*").alias("n"))
        .select(*keys, "n", F.explode(F.array(*asked)).alias("b"))
        .select(*keys, "n", "b.*")
    )
    counted = values.groupBy(*keys, "value").agg(F.count("*").alias("times"))
    # Cell -1 lies below the bracket, cell CELLS + 1 above it.
    place = (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CELLS
    cell = (
        F.when(F.col("value") < F.col("low"), -1)
        .when(F.col("value") > F.col("high"), CELLS + 1)
        .when(F.col("high") == F.col("low"), 0)
        .otherwise(F.floor(place)).cast("int")
    )
    paired = lookup_join(counted, brackets, keys).withColumn("cell", cell)
    cells = paired.groupBy(*keys, "fraction", "n", "cell").agg(
        F.sum("times").alias("held"), F.min("value").alias("least"), F.max("value").alias("most")
    )
    upto = F.sum("held").over(
        Window.partitionBy(*keys, "fraction").orderBy("cell")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    position = (F.col("n") - 1) * F.col("fraction")
    wanted = (
        cells.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("held"))
        .withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))))
        .filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("upto")))
    )
    outside = F.raise_error(F.lit("a percentile lies outside its bracket")).cast("double")
    edge = (
        F.when(F.col("rank") == F.col("before"), F.col("least"))
        .when(F.col("rank") == F.col("upto") - 1, F.col("most"))
        .when(F.col("least") == F.col("most"), F.col("least"))
    )
    settled = wanted.withColumn("found", edge).withColumn(
        "found", F.when(F.col("found").isNull() & ~F.col("cell").between(0, CELLS), outside).otherwise(F.col("found"))
    )
    inside = settled.filter("found is null").select(
        *keys, "fraction", "cell", "rank", "before"
    )
    in_cell = Window.partitionBy(*keys, "fraction", "rank").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ordered = (
        lookup_join(paired.select(*keys, "fraction", "cell", "value", "times"), inside, [*keys, "fraction", "cell"])
        .withColumn("reached", F.col("before") + F.sum("times").over(in_cell))
        .filter(F.col("reached") > F.col("rank"))
        .groupBy(*keys, "fraction", "rank").agg(F.min("value").alias("found"))
    )
    ranks = settled.filter("found is not null").select(*keys, "fraction", "rank", "found")
    both = ranks.unionByName(ordered).groupBy(*keys, "fraction").agg(
        F.min("found").alias("lower"), F.max("found").alias("upper")
    )
    sizes = brackets.select(*keys, "fraction", (position - F.floor(position)).alias("weight"))
    return both.join(sizes, [*keys, "fraction"]).select(
        *keys, "fraction",
        (F.col("lower") * (1 - F.col("weight")) + F.col("upper") * F.col("weight")).alias("percentile"),
    )
