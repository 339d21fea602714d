"""Derived tables: a registry of them, and when they must be rebuilt.

A registry has ``name, kind, source_txn, built_at, entries, bytes, version``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def rebuild_reason(current_txn: Column, now: Column, cooldown_hours: float, max_new_txns: int, max_age_hours: float, min_new_txns: int) -> Column:
    """Why a table is to be rebuilt: ``txns``, ``age``, or null; in this order: none within the cooldown, too many new transactions, too old
    with enough new ones."""
    behind, age = current_txn - F.col("source_txn"), _hours(now, F.col("built_at"))
    return F.when(age < cooldown_hours, None).when(behind >= max_new_txns, "txns").when((age >= max_age_hours) & (behind >= min_new_txns), "age")


def health(registry: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """``registry`` with ``age_hours`` and ``status``, healthy or stale."""
    aged = registry.withColumn("age_hours", _hours(now, F.col("built_at")))
    return aged.withColumn("status", F.when(F.col("age_hours") >= max_age_hours, "stale").otherwise("healthy"))


def totals(registry: DataFrame) -> DataFrame:
    """``kind, tables, entries, bytes`` of each kind."""
    return registry.groupBy("kind").agg(F.count("*").alias("tables"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def invalidated(registry: DataFrame, patterns: DataFrame, commits: DataFrame) -> DataFrame:
    """The tables that commits touch: ``name``.

    ``patterns`` has ``name``, ``prefix`` (of keys) and ``op`` (null for any); ``commits`` has ``txn_id, key_prefix, op``, where a key's prefix up to and with its
    first colon is what patterns name. Only commits after a table's own transaction count. An equi-join by prefix.
    """
    newest = commits.groupBy("key_prefix", "op").agg(F.max("txn_id").alias("txn_id"))
    hit = patterns.join(newest.withColumnRenamed("op", "their_op"), patterns["prefix"] == newest["key_prefix"]).where(F.col("op").isNull() | (F.col("op") == F.col("their_op")))
    return registry.join(hit.groupBy("name").agg(F.max("txn_id").alias("touched")), "name").where(F.col("touched") > F.col("source_txn")).select("name").distinct()


# Limits of latency in milliseconds with what they do to a score, and the hit rate beyond which a cache gains.
FAST, SLOW, HITS = (10, 1.1), (100, 0.9), (0.8, 0.1)


def best_source(scores: dict[str, Column], latency_ms: dict[str, float], hit_rate: dict[str, float]) -> Column:
    """The name of the source with the greatest score, of equal ones the first by name.

    A source that answers within 10 ms counts a tenth more, one over 100 ms a tenth less; one whose cache hits exceed 0.8 gains 0.1.
    """
    entries = []
    for name in sorted(scores):
        latency = latency_ms.get(name, 50)
        factor = FAST[1] if latency <= FAST[0] else SLOW[1] if latency > SLOW[0] else 1.0
        entries.append(F.struct((scores[name] * factor + (HITS[1] if hit_rate.get(name, 0) > HITS[0] else 0.0)).alias("score"), F.lit(name).alias("name")))
    top = F.aggregate(F.array(*entries), entries[0], lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    return top["name"]


def compatible(reader: Sequence[int], writer: Sequence[int]) -> bool:
    """Whether a reader of one version can read another's output: the same major, no newer minor."""
    return reader[0] == writer[0] and reader[1] >= writer[1]


def migration_path(steps: Sequence[tuple[str, str]], start: str, goal: str) -> list[tuple[str, str]] | None:
    """The fewest steps from one version to another; None if they don't connect."""
    frontier, seen = [(start, [])], {start}
    while frontier:
        at, path = frontier.pop(0)
        if at == goal:
            return path
        for a, b in steps:
            if a == at and b not in seen:
                seen.add(b)
                frontier.append((b, [*path, (a, b)]))
    return None
