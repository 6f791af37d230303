"""Boolean match and cover-density rank over postings, for a whole batch of queries.

A query is an OR of groups; a group is an AND of literals; a literal is one lexeme or a
phrase and may be negated.  Queries are rows of a literals table:

    query_id, group_no, literal_no, lexemes array<struct<lexeme, offset>>, negated

Only postings of lexemes some query asks for are touched.  They are gathered by unit in one
shuffle, in which a list goes once however many queries ask for it; the queries, whose size was
checked, meet the lists of a unit in the task that holds them.  Only a batch of queries too
large to be sent to every task is joined first and gathered by (query_id, unit_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylamp.functions.text import words
from quarrylamp.operators.covers import PACKED, fold_batches, fold_units, pack_hits
from quarrylamp.operators.postings import Lexicon, lexeme_bucket, simple_lexicon
from quarrylamp.operators.sizing import checked_rows, lookup_join, settle
from quarrylamp.operators.topk import top_k

# Default weight of each class.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}

PAIR = ["query_id", "unit_id"]
LITERAL = ["query_id", "group_no", "literal_no"]

# A quoted phrase or a bare term, each with an optional minus sign.
_TERM = r'-?"[^"]*"?|[^\s"]+'


def query_literals(
    queries: DataFrame, query_col: str = "query", lexicon: Lexicon = simple_lexicon
) -> DataFrame:
    """Literals of web-style query texts: terms, "quoted phrases", `or`, `-negation`.

    Terms next to each other are ANDed, `or` starts the next group.  A term of several
    words is a phrase.  Stop words vanish but keep their place inside a phrase; a query
    left without any literal has no rows here and matches nothing.
    """
    terms = queries.select(
        "query_id",
        F.posexplode(
            F.regexp_extract_all(F.coalesce(F.col(query_col), F.lit("")), F.lit(_TERM), F.lit(0))
        ).alias("literal_no", "term"),
    )
    is_or = F.lower("term") == "or"
    in_query = Window.partitionBy("query_id").orderBy("literal_no")
    grouped = (
        terms.withColumn("group_no", F.sum(is_or.cast("int")).over(in_query).cast("int"))
        .filter(~is_or)
        .withColumn("found", lexicon(words(F.col("term"))))
    )
    placed = F.transform(
        "found", lambda lexeme, i: F.struct(lexeme.alias("lexeme"), i.alias("offset"))
    )
    real = F.filter(placed, lambda entry: entry["lexeme"].isNotNull())
    return (
        grouped.withColumn("lexemes", real)
        .filter(F.size("lexemes") > 0)
        .select(
            *LITERAL,
            F.transform(
                "lexemes",
                lambda entry: F.struct(
                    entry["lexeme"].alias("lexeme"),
                    (entry["offset"] - F.col("lexemes")[0]["offset"]).cast("int").alias("offset"),
                ),
            ).alias("lexemes"),
            F.col("term").startswith("-").alias("negated"),
        )
    )


def _hits(postings: DataFrame, wanted: DataFrame, bounded: bool) -> DataFrame:
    """Postings whose lexeme is among `wanted(lexeme, ...)`, with its other columns."""
    if bounded and "bucket" in postings.columns:
        # Postings laid out by bucket: only the asked ones are read, however many rows match.
        asked = [r[0] for r in wanted.select(lexeme_bucket(F.col("lexeme"))).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(asked))
    needed = postings.select("unit_id", "lexeme", "gaps", "weights")
    return lookup_join(needed, wanted, ["lexeme"], bounded=bounded)


def _by_unit(
    postings: DataFrame, literals: DataFrame, units: DataFrame | None, weights: dict[str, float],
    owners: DataFrame | None,
) -> DataFrame:
    """`(query_id, unit_id, text_rank)` of a batch of literals that passed the size check, with owners."""
    asked = [
        (r["query_id"], r["group_no"], r["literal_no"], [tuple(e) for e in r["lexemes"]], r["negated"])
        for r in literals.select(*LITERAL, "lexemes", "negated").collect()
    ]
    codes = {word: code for code, word in enumerate(sorted({w for _, _, _, lexemes, _ in asked for w, _ in lexemes}))}
    spark = postings.sparkSession
    numbered = spark.createDataFrame(list(codes.items()), "lexeme string, code int")
    found = _hits(postings, numbered, True).select("unit_id", "code", "gaps", "weights")
    kind = found.schema["unit_id"].dataType.simpleString()
    # Packed before they are gathered: lists of places as numbers take several times as much.
    packed = found.mapInArrow(pack_hits, f"unit_id {kind}, " + ", ".join(f"{c} binary" for c in PACKED))
    rows = packed.select("unit_id", F.struct(*PACKED).alias("hit"), F.lit(False).alias("listed"))
    if units is not None:
        # Units without any asked word answer the groups that only exclude.
        none = F.lit(None).cast(rows.schema["hit"].dataType).alias("hit")
        rows = rows.unionByName(units.select(F.col("unit_id").cast("long"), none, F.lit(True).alias("listed")))
    gathered = rows.groupBy("unit_id").agg(F.collect_list("hit").alias("hits"), F.max("listed").alias("listed"))
    schema, kept = "query_id long, unit_id long, text_rank double", []
    if owners is not None:
        # Owners meet the lists of a unit, of which there are far fewer than matches.
        gathered = gathered.join(owners, "unit_id")
        kept = [c for c in owners.columns if c != "unit_id"]
        schema += "".join(f", {c} {owners.schema[c].dataType.simpleString()}" for c in kept)
    return gathered.mapInArrow(fold_units(asked, codes, weights, kept), schema)


def _folded(
    postings: DataFrame, literals: DataFrame, weights: dict[str, float], bounded: bool
) -> DataFrame:
    """`(query_id, unit_id, text_rank, hit)` of every pair with a hit, after one shuffle.

    text_rank is NULL without a match; hit holds the groups of exclusions only that the unit
    does not pass.
    """
    hit = F.struct("lexeme", "gaps", "weights")
    wanted = literals.select("query_id", F.explode("lexemes.lexeme").alias("lexeme")).distinct()
    gathered = _hits(postings, wanted, bounded).groupBy(*PAIR).agg(F.collect_list(hit).alias("hits"))
    literal = F.struct("group_no", "literal_no", "lexemes", "negated")
    plans = literals.groupBy("query_id").agg(F.to_json(F.collect_list(literal)).alias("plan"))
    # The words that each group asks for: none for a group of exclusions, whose hits are wanted too.
    asked = F.when(~F.col("negated"), F.col("lexemes.lexeme"))
    groups = literals.groupBy("query_id", "group_no").agg(F.flatten(F.collect_list(asked)).alias("words"))
    plans = plans.join(groups.groupBy("query_id").agg(F.collect_list("words").alias("needs")), "query_id")
    # Pairs in which no group has all its words are dropped before anything is folded.
    whole = F.exists("needs", lambda words: F.size(F.array_except(words, F.col("hits.lexeme"))) == 0)
    return (
        lookup_join(gathered, plans, ["query_id"], bounded=bounded)
        .filter(whole)
        .select(*PAIR, "hits", "plan")
        .mapInArrow(
            fold_batches(weights),
            "query_id long, unit_id long, text_rank double, hit array<int>",
        )
    )


def _excluding(literals: DataFrame) -> DataFrame:
    """`(query_id, group_no)` of the groups that only exclude."""
    return (
        literals.groupBy("query_id", "group_no")
        .agg(F.bool_and("negated").alias("only"))
        .filter("only")
        .select("query_id", "group_no")
    )


def _negation_only(
    units: DataFrame, folded: DataFrame, literals: DataFrame, bounded: bool
) -> DataFrame | None:
    """Pairs matched by groups that only exclude: units holding no excluded literal.

    The excluding groups a unit does hit are gathered per unit, so a unit is expanded only
    into the queries it answers.  None when no group is of that kind.
    """
    asked = _excluding(literals)
    shares = -(-asked.count() // 1_000)
    if not shares:
        return None
    group = F.struct("query_id", "group_no")
    share = F.pmod(F.xxhash64("query_id", "group_no"), F.lit(shares)).cast("int").alias("share")
    lists = asked.groupBy(share).agg(F.collect_list(group).alias("asked"))
    hit = (
        folded.select("unit_id", "query_id", F.explode("hit").alias("group_no"))
        .groupBy("unit_id", share)
        .agg(F.collect_set(group).alias("hit"))
    )
    every = units.select(
        "unit_id", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share")
    )
    answered = F.when(F.col("hit").isNull(), F.col("asked")).otherwise(
        F.array_except("asked", "hit")
    )
    return (
        lookup_join(every, lists, ["share"], bounded=bounded)
        .join(hit, ["unit_id", "share"], "left")
        .select("unit_id", F.explode(answered).alias("g"))
        .select("g.query_id", "unit_id")
        .distinct()
    )


def match_and_rank(
    postings: DataFrame,
    literals: DataFrame,
    units: DataFrame | None = None,
    weights: dict[str, float] | None = None,
    bounded: bool | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """`(query_id, unit_id, text_rank)` of every unit that matches a query.

    With `owners(unit_id, ...)` the result is joined with them, before the matches of a unit are made
    where that is possible.

    The rank sums, over the minimal covers (shortest stretches that satisfy the query),
    the mean weight of the query words inside divided by one plus the number of other words
    inside; the sum r is reported as r / (r + 1).  Units matched only through an excluding
    group rank 0; pass `units(unit_id)` to have those found.
    """
    literals = literals.withColumn("query_id", F.col("query_id").cast("long"))
    if bounded is None:
        literals, rows = settle(literals)
        bounded = rows is not None
    if bounded and checked_rows(literals) is not None:
        if units is not None and not _excluding(literals).head(1):
            units = None
        return _by_unit(postings, literals, units, weights or WEIGHTS, owners)
    if owners is not None:
        return match_and_rank(postings, literals, units, weights, False).join(owners, "unit_id")
    folded = _folded(postings, literals, weights or WEIGHTS, bounded)
    ranked = folded.filter("text_rank is not null").select(*PAIR, "text_rank")
    if units is None:
        return ranked
    excluded = _negation_only(units, folded, literals, bounded)
    if excluded is None:
        return ranked
    return (
        ranked.unionByName(excluded.withColumn("text_rank", F.lit(0.0)))
        .groupBy(*PAIR)
        .agg(F.max("text_rank").alias("text_rank"))
    )


def match(
    postings: DataFrame, literals: DataFrame, units: DataFrame | None = None, **options
) -> DataFrame:
    """`(query_id, unit_id)` pairs that satisfy the query; see `match_and_rank`."""
    return match_and_rank(postings, literals, units, **options).select(*PAIR)


def rank_cover(postings: DataFrame, literals: DataFrame, **options) -> DataFrame:
    """Cover-density ranks of the units matched by at least one positive group."""
    return match_and_rank(postings, literals, None, **options)


def top_text(ranks: DataFrame, k: int | str, bound: int | None = None) -> DataFrame:
    """The k best-ranked units per query, smaller unit id on ties."""
    order: list[Column] = [F.col("text_rank").desc(), F.col("unit_id")]
    return top_k(ranks, ["query_id"], order, k, spread_by=["unit_id"], bound=bound)
