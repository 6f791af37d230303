"""Relevance of ranked results against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.operators.topk import top_k

KS = (5, 10)


def _gain(grade) -> F.Column:
    return F.pow(F.lit(2.0), grade) - 1


def _discounted(grade, rank) -> F.Column:
    return _gain(grade) / F.log2(rank + 1)


def _ideal(labels: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Number of relevant URLs and best possible discounted gain per query and k."""
    order = [F.col("grade").desc(), F.col("url")]
    best = top_k(labels, ["query_id"], order, max([*ks, 1]), rank_column="place")
    ideal = best.groupBy("query_id").agg(
        *[
            F.sum(
                F.when(F.col("place") <= k, _discounted(F.col("grade"), F.col("place")))
            ).alias(f"ideal_{k}")
            for k in ks
        ]
    )
    relevant = labels.groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sort_array(F.collect_list("url")).alias("relevant_urls")
    )
    return relevant.join(ideal, "query_id")


def evaluate(cases: DataFrame, results: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row per case: returned and relevant URLs and every metric.

    `cases(query_id, query, url, grade)` has a row per relevant URL, `results(query_id, rank,
    url)` is a ranked list.  A case without results counts 0 everywhere.  Columns: mrr, ap,
    and precision_k, recall_k, ndcg_k per k.
    """
    labels = cases.select("query_id", "url", F.col("grade").cast("double").alias("grade"))
    judged = results.select("query_id", "rank", "url").join(labels, ["query_id", "url"], "left")
    running = (
        Window.partitionBy("query_id")
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = F.col("grade").isNotNull()
    marked = judged.withColumn("hits", F.sum(hit.cast("int")).over(running))
    sums = [
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
        F.sum(F.when(hit, F.col("hits") / F.col("rank"))).alias("precisions"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda r: r["url"]
        ).alias("returned_urls"),
    ]
    for k in ks:
        near = hit & (F.col("rank") <= k)
        sums.append(F.sum(near.cast("int")).alias(f"hits_{k}"))
        sums.append(
            F.sum(F.when(near, _discounted(F.col("grade"), F.col("rank")))).alias(f"gain_{k}")
        )
    scored = marked.groupBy("query_id").agg(*sums)
    queries = cases.groupBy("query_id").agg(F.first("query").alias("query"))
    joined = (
        queries.join(_ideal(labels, ks), "query_id").join(scored, "query_id", "left")
    )

    def part(value, of) -> F.Column:
        return F.when(of > 0, F.coalesce(value, F.lit(0.0)) / of).otherwise(F.lit(0.0))

    metrics = [
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("mrr"),
        part(F.col("precisions"), F.col("relevant")).alias("ap"),
    ]
    for k in ks:
        hits = F.col(f"hits_{k}").cast("double")
        metrics += [
            part(hits, F.lit(k)).alias(f"precision_{k}"),
            part(hits, F.col("relevant")).alias(f"recall_{k}"),
            part(F.col(f"gain_{k}"), F.col(f"ideal_{k}")).alias(f"ndcg_{k}"),
        ]
    empty = F.array().cast("array<string>")
    return joined.select(
        "query_id", "query",
        F.coalesce("returned_urls", empty).alias("returned_urls"), "relevant_urls", *metrics,
    )


def summarize(per_case: DataFrame) -> DataFrame:
    """Number of cases and the mean of every metric over all of them."""
    plain = ("query_id", "query", "returned_urls", "relevant_urls")
    metrics = [c for c in per_case.columns if c not in plain]
    return per_case.agg(
        F.count("*").alias("cases"), *[F.avg(c).alias(f"mean_{c}") for c in metrics]
    )
