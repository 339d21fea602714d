"""Weighted relevance, top lists and summaries of results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.plans.ranking import BIG_GROUP, null_safe_join, running_sums, value_blocks

# The weights of confidence, recency, popularity, semantic similarity and exact match.
WEIGHTS = {
    "balanced": {"confidence": 0.3, "recency": 0.2, "popularity": 0.2, "semantic_similarity": 0.2, "exact_match": 0.1},
    "recent_first": {"confidence": 0.2, "recency": 0.5, "popularity": 0.1, "semantic_similarity": 0.1, "exact_match": 0.1},
    "confidence_first": {"confidence": 0.5, "recency": 0.1, "popularity": 0.1, "semantic_similarity": 0.2, "exact_match": 0.1},
    "popular_first": {"confidence": 0.2, "recency": 0.1, "popularity": 0.5, "semantic_similarity": 0.1, "exact_match": 0.1},
    "semantic_first": {"confidence": 0.1, "recency": 0.1, "popularity": 0.1, "semantic_similarity": 0.6, "exact_match": 0.1},
}


def score(weights: Mapping[str, float]) -> Column:
    """The weighted sum of the factors, each of which counts 0 where it is null or NaN."""
    clean = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    out = F.lit(0.0)
    for factor, weight in weights.items():
        out = out + clean(factor) * F.lit(float(weight))
    return out


def overlap(text: Column, query: str) -> Column:
    """The share of the query's words, repeated ones each, that are words of the text; words are split at spaces."""
    asked = [w for w in query.split(" ") if w]
    if not asked:
        return F.lit(0.0)
    found = F.size(F.filter(F.array(*map(F.lit, asked)), lambda w: F.array_contains(F.split(text, " "), w)))
    return F.coalesce(F.when(text.isNotNull(), found), F.lit(0)) / F.lit(float(len(asked)))


def factors(confidence: Column, created: Column, accesses: Column, text: Column, query: str, now: Column) -> dict[str, Column]:
    """The relevance factors of a result at the moment ``now``: recency fades over 30 days, popularity is full at 100 accesses."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    hours = (micros(now) - micros(created)) / F.lit(3.6e9)
    return {
        "confidence": confidence,
        "recency": F.greatest(F.lit(0.0), 1 - hours / 720),
        "popularity": F.least(F.lit(1.0), accesses / F.lit(100.0)),
        "semantic_similarity": overlap(text, query),
        "exact_match": F.when(F.contains(text, F.lit(query)), 1.0).otherwise(0.0),
    }


def ranked(results: DataFrame, by: Sequence[str], tie: Sequence[str], column: str = "score", big: int = BIG_GROUP) -> DataFrame:
    """``results``, cut or cheap to read, with ``rank``, from 0 in the order of falling score, ties in the order of ``tie``.

    Groups of more than ``big`` results are ranked in blocks of scores. NaN comes first, as the greatest score, and null last.
    """
    score = F.col(column).cast("double")
    down = F.when(score.isNull(), float("inf")).when(F.isnan(score), float("-inf")).otherwise(-score)
    blocked, split = value_blocks(results.withColumns({"_x": down, "_one": F.lit(1)}), by, "_x", big)
    placed = running_sums(blocked, by, [F.desc_nulls_last(column), *tie], {"_one": "_place"}, split)
    return placed.select(*[c for c in results.columns if c != "rank"], (F.col("_place") - 1).cast("int").alias("rank"))


def top_k(results: DataFrame, k: int, tie: Sequence[str], column: str = "score") -> DataFrame:
    """The ``k`` best of all: each task sorts out its own ``k`` first."""
    return results.orderBy(F.desc_nulls_last(column), *tie).limit(k)


def top_k_per(results: DataFrame, by: Sequence[str], k: int, tie: Sequence[str], column: str = "score") -> DataFrame:
    """The ``k`` best of each group; the rank limit works before the shuffle too."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(column), *tie))
    return results.withColumn("_place", place).where(F.col("_place") <= k).withColumn("rank", F.col("_place") - 1).drop("_place")


def summary_cutoff(results: DataFrame, by: Sequence[str], order: Sequence[str], text: str, limit: int = 4000, overhead: int = 10) -> DataFrame:
    """The first results of each group whose texts, each with an overhead, fit into ``limit`` characters; all if they fit as they are.

    As each result takes the overhead at least, no more than ``limit`` over ``overhead`` of a group can fit; the rank limit keeps these before
    the shuffle. Groups that fit as they are have at most ``limit`` results with text, and are told by a sum.
    """
    size = F.coalesce(F.length(text), F.lit(0))
    small = results.groupBy(*by).agg(F.sum(size).alias("_whole")).where(F.col("_whole") <= limit).select(*by, F.lit(True).alias("_fits"))
    joined = null_safe_join(results, small, by, "left")
    sized = joined.where("_fits is null")
    if overhead > 0:
        sized = sized.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= limit // overhead + 1)
    used = F.sum(size + overhead).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    fitting = sized.withColumn("_used", used).where(F.col("_used") <= limit).select(*results.columns)
    return joined.where("_fits").select(*results.columns).unionByName(fitting)
