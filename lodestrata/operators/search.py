"""Inverted topic index: postings, boolean search, term statistics. Postings have ``term`` and the columns of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lodestrata.operators.predicates import TopicQuery
from lodestrata.plans.bounded import broadcast_if_bounded

ENTITY = ("ns", "id")


def terms_of(text: F.Column) -> F.Column:
    """The lower-case words of a text: runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def postings(entities: DataFrame, text: str, entity: Sequence[str] = ENTITY) -> DataFrame:
    """``term``, the entity and ``frequency`` of each word of each entity; counted map-side first."""
    return entities.select(*entity, F.explode(terms_of(F.col(text))).alias("term")).groupBy("term", *entity).agg(F.count("*").alias("frequency"))


def search_all(index: DataFrame, terms: Sequence[str], entity: Sequence[str] = ENTITY) -> DataFrame:
    """Entities with all terms: the entity and ``score``, the sum of the terms' frequencies."""
    wanted = sorted(set(terms))
    hits = index.where(F.col("term").isin(wanted)).groupBy(*entity).agg(F.sum("frequency").alias("score"), F.countDistinct("term").alias("n"))
    return hits.where(F.col("n") == len(wanted)).drop("n")


def search_any(index: DataFrame, terms: Sequence[str], entity: Sequence[str] = ENTITY) -> DataFrame:
    """Entities with any of the terms, scored the same way."""
    return index.where(F.col("term").isin(sorted(set(terms)))).groupBy(*entity).agg(F.sum("frequency").alias("score"))


def search(index: DataFrame, query: TopicQuery, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Entities with all required terms, one of the optional ones if any, and no excluded one; one pass over the terms' postings.

    Terms are single words here; a phrase counts as its words. The score sums the frequencies of all wanted terms.
    """
    split = lambda ts: [w for t in ts for w in t.split()]
    need, some, never = split(query.required), split(query.optional), split(query.excluded)
    wanted = sorted({*need, *some})
    has = lambda ts: F.count_if(F.col("term").isin(ts))
    hits = index.where(F.col("term").isin([*wanted, *never])).groupBy(*entity).agg(
        F.sum(F.when(F.col("term").isin(wanted), F.col("frequency"))).alias("score"), has(sorted(set(need))).alias("needed"), has(some).alias("some"), has(never).alias("never")
    )
    kept = hits.where((F.col("never") == 0) & (F.col("needed") == len(set(need))) & (F.lit(not some) | (F.col("some") > 0)))
    return kept.where("score is not null").select(*entity, "score")


def search_terms(index: DataFrame, terms: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    """Entities by a table of terms (``term``), joined to the postings; broadcast only if the table is small."""
    return index.join(broadcast_if_bounded(terms.select("term").distinct()), "term").groupBy(*entity).agg(F.sum("frequency").alias("score"), F.count("*").alias("matched"))


def term_stats(index: DataFrame, documents: int) -> DataFrame:
    """``term, df, tf, idf`` with idf = ln(documents / df)."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("frequency").alias("tf")).withColumn("idf", F.log(F.lit(float(documents)) / F.col("df")))


def tf_idf(index: DataFrame, documents: int, entity: Sequence[str] = ENTITY) -> DataFrame:
    """``term``, the entity and ``weight``, frequency times idf. The statistics join by term; skewed terms are split at run time."""
    return index.join(term_stats(index, documents).select("term", "idf"), "term").select("term", *entity, (F.col("frequency") * F.col("idf")).alias("weight"))


def prefix_terms(index: DataFrame, prefix: str) -> DataFrame:
    """The distinct terms with a prefix."""
    return index.where(F.startswith("term", F.lit(prefix))).select("term").distinct()


def topic_ancestors(paths: DataFrame, path: str = "path") -> DataFrame:
    """Each dotted path with each of its ancestors and itself: ``path, ancestor, level``."""
    parts = F.split(F.col(path), r"\.")
    return paths.select(path, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("level")).withColumn("ancestor", F.array_join(F.slice(parts, 1, F.col("level")), "."))


# --- merging result sets -----------------------------------------------------------------------------------------------------------


def merge_union(a: DataFrame, b: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return a.select(*entity).union(b.select(*entity)).distinct()


def merge_intersection(a: DataFrame, b: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return a.select(*entity).intersect(b.select(*entity))


def merge_difference(a: DataFrame, b: DataFrame, entity: Sequence[str] = ENTITY) -> DataFrame:
    return a.select(*entity).subtract(b.select(*entity))


def merge_weighted(parts: Sequence[tuple[DataFrame, float]], entity: Sequence[str] = ENTITY) -> DataFrame:
    """The weighted sum of the scores of several result sets; an entity missing from one scores 0 there."""
    out = None
    for df, weight in parts:
        one = df.select(*entity, (F.col("score") * F.lit(float(weight))).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*entity).agg(F.sum("score").alias("score"))
