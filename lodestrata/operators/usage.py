"""Usage of entities and queries: heat, profiles, predictions, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.plans.ranking import BIG_GROUP, place_of, running_sums, value_blocks


def _hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def hot_entities(accesses: DataFrame, entity: str, least: int, now: Column) -> DataFrame:
    """``entity, accesses, heat`` of entities with at least so many accesses: 0.7 for number (full at 100), 0.3 for recency (a day)."""
    per = accesses.groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("accesses"), F.max("ts").alias("last_ts")).where(F.col("accesses") >= least)
    heat = F.least(F.lit(1.0), F.col("accesses") / 100) * 0.7 + F.greatest(F.lit(0.0), 1 - _hours(now, F.col("last_ts")) / 24) * 0.3
    return per.select("entity", "accesses", heat.alias("heat"))


def cold_entities(accesses: DataFrame, entity: str, hours: float, now: Column) -> DataFrame:
    """``entity, age_hours, cold`` of entities not accessed for so long; full at 30 days."""
    per = accesses.groupBy(F.col(entity).alias("entity")).agg(F.max("ts").alias("last_ts")).withColumn("age_hours", _hours(now, F.col("last_ts")))
    return per.where(F.col("age_hours") >= hours).select("entity", "age_hours", F.least(F.lit(1.0), F.col("age_hours") / 720).alias("cold"))


def query_profile(log: DataFrame, pattern: str, latency: str, scanned: str | None = None, returned: str | None = None) -> DataFrame:
    """``pattern, n, total, min, max, avg`` of each query pattern, with rows scanned and returned and their ratio."""
    more = [] if scanned is None else [F.sum(scanned).alias("scanned"), F.sum(returned).alias("returned"), F.try_divide(F.sum(scanned), F.sum(returned)).alias("scan_ratio")]
    return log.groupBy(F.col(pattern).alias("pattern")).agg(F.count(latency).alias("n"), F.sum(latency).alias("total"), F.min(latency).alias("min"), F.max(latency).alias("max"), F.avg(latency).alias("avg"), *more)


def slow_queries(profile: DataFrame, threshold: float) -> DataFrame:
    """Patterns whose mean latency reaches the threshold, with ``severity``, 5 times the ratio, 10 at most."""
    return profile.where(F.col("avg") >= threshold).withColumn("severity", F.least(F.lit(10.0), F.col("avg") / threshold * 5))


def latency_regressions(log: DataFrame, pattern: str, latency: str, order: Sequence[str], ratio: float, least: int) -> DataFrame:
    """Patterns whose last latency is more than ``ratio`` times the greatest before it, given at least so many before."""
    last = F.struct(*order)
    per = log.groupBy(F.col(pattern).alias("pattern")).agg(F.max_by(latency, last).alias("current"), F.max(last).alias("at"), F.count("*").alias("n"))
    before = log.join(per.select(F.col("pattern").alias(pattern), "at"), pattern).where(F.struct(*order) < F.col("at")).groupBy(F.col(pattern).alias("pattern")).agg(F.max(latency).alias("worst"))
    return per.join(before, "pattern").where((F.col("n") - 1 >= least) & (F.col("current") > F.col("worst") * ratio)).select("pattern", "current", "worst", (F.col("current") / F.col("worst")).alias("ratio"))


def predictions(accesses: DataFrame, pattern: str, start: Column, end: Column, least: float) -> DataFrame:
    """``pattern, n, confidence``: each pattern's share of the most frequent one's accesses in the period, if it reaches ``least``."""
    per = accesses.where((F.col("ts") >= start) & (F.col("ts") <= end)).groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"))
    top = per.agg(F.max("n").alias("top"))
    return per.withColumn("confidence", F.col("n") / top.scalar()).where(F.col("confidence") >= least)


def predictions_by_hour(accesses: DataFrame, pattern: str, k: int) -> DataFrame:
    """The ``k`` most frequent patterns of each hour of the day: ``hour, pattern, n, share``."""
    per = accesses.where("ts is not null").groupBy(F.hour("ts").alias("hour"), F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"))
    rows = per.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("hour")))
    return rows.withColumn("r", F.row_number().over(W.partitionBy("hour").orderBy(F.desc("n"), "pattern"))).where(F.col("r") <= k).drop("r")


def running_average(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, big: int = BIG_GROUP) -> DataFrame:
    """``rows``, cut or cheap to read, with ``running``, the mean of the values so far; the first of ``order`` is a time or number, by which long
    series are taken in blocks."""
    counted = rows.withColumns({"_x": place_of(rows, order[0]), "_v": F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "_n": F.col(value).isNotNull().cast("long")})
    blocked, split = value_blocks(counted, by, "_x", big)
    summed = running_sums(blocked, by, order, {"_v": "_sum", "_n": "_count"}, split)
    return summed.withColumn("running", F.try_divide("_sum", "_count")).select(*rows.columns, "running")


def compared_arms(trials: DataFrame, arm: str, metric: str, least: int, smaller_wins: bool = True) -> DataFrame:
    """``arm, n, mean, winner`` of each arm of an experiment; there is a winner only if every arm has enough trials."""
    per = trials.groupBy(F.col(arm).alias("arm")).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"))
    everything = W.partitionBy()  # one row per arm
    best = (F.min if smaller_wins else F.max)("mean").over(everything)
    return per.withColumn("winner", (F.col("mean") == best) & (F.min("n").over(everything) >= least))


def heartbeat_lag(sent: DataFrame, applied: DataFrame, by: str) -> DataFrame:
    """``by, lag``: by how much each replica's applied position is behind the last one sent; never less than 0."""
    top = sent.agg(F.max("position").alias("top"))
    per = applied.groupBy(by).agg(F.max("position").alias("position"))
    return per.select(by, F.greatest(F.lit(0), top.scalar() - F.col("position")).alias("lag"))


# --- what usage suggests -------------------------------------------------------------------------------------------------------------

# How recent use counts (up to so many hours), the accesses of full confidence, the bands of confidence, the hit rate and the accesses
# that ask for action, and accuracies with their labels.
RECENCY, RECENCY_REST = ((1, 1.0), (24, 0.8)), 0.5
FULL_CONFIDENCE = 10
BANDS = ((0.8, "high"), (0.5, "medium"))
LOW_HIT_RATE, FREQUENT = 0.5, 1_000
ACCURACY_LABELS = ((0.9, "high"), (0.7, "medium"))


def _label(value: Column, limits: Sequence[tuple[float, str]], rest: str = "low") -> Column:
    out = F.lit(rest)
    for limit, name in reversed(limits):
        out = F.when(value >= limit, name).otherwise(out)
    return out


def accuracy_level(accuracy: Column) -> Column:
    """The label of an accuracy, compared in single precision, as accuracies are stored."""
    return _label(accuracy.cast("float"), [(F.lit(limit).cast("float"), name) for limit, name in ACCURACY_LABELS])


def pattern_confidence(accesses: DataFrame, pattern: str, now: Column) -> DataFrame:
    """``pattern, n, confidence, band`` of each pattern: its accesses over FULL_CONFIDENCE, less if the last one is long ago, 1 at most."""
    per = accesses.where(F.col(pattern).isNotNull()).groupBy(F.col(pattern).alias("pattern")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))
    recency = F.lit(RECENCY_REST)
    for hours, factor in reversed(RECENCY):
        recency = F.when(_hours(now, F.col("last_ts")) < hours, factor).otherwise(recency)
    confidence = F.least(F.lit(1.0), F.col("n") / FULL_CONFIDENCE * recency)
    return per.select("pattern", "n", confidence.alias("confidence")).withColumn("band", _label(F.col("confidence"), BANDS))


def insights(confidences: DataFrame) -> DataFrame:
    """``patterns, high, medium, low, mean_confidence`` over :func:`pattern_confidence`."""
    of = lambda band: F.count_if(F.col("band") == band).alias(band)
    return confidences.agg(F.count("*").alias("patterns"), of("high"), of("medium"), of("low"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def suggestions(accesses: DataFrame, pattern: str, hit: Column, k: int = 5) -> DataFrame:
    """``target, kind, priority, n``: ``increase_cache`` (of target ``cache``) if too few accesses are hits, ``build`` for those of the ``k`` most
    frequent patterns that exceed FREQUENT accesses."""
    rate = accesses.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).where(F.col("hits") < LOW_HIT_RATE * F.col("n"))
    top = accesses.where(F.col(pattern).isNotNull()).groupBy(F.col(pattern).cast("string").alias("target")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "target").limit(k)
    cache = rate.select(F.lit("cache").alias("target"), F.lit("increase_cache").alias("kind"), F.lit(2).alias("priority"), "n")
    return cache.unionByName(top.where(F.col("n") > FREQUENT).select("target", F.lit("build").alias("kind"), F.lit(3).alias("priority"), "n"))


def build_queue(asked: DataFrame, running: DataFrame, at_once: int) -> DataFrame:
    """``target, priority, place, starts``: what is asked for (``target, priority, seq``), each target once, the most urgent first.

    Of a target's requests the first by ``seq`` holds. Targets that are ``running`` are left out, and what starts now is limited by what
    ``at_once`` leaves beside them. The queue is as long as there are targets to build, a small table.
    """
    once = asked.groupBy("target").agg(F.min(F.struct("seq", "priority")).alias("x")).select("target", "x.priority", "x.seq").join(running, "target", "left_anti")
    placed = once.withColumn("place", F.row_number().over(W.orderBy(F.desc("priority"), "seq", "target")))
    free = running.agg(F.count("*").alias("n")).select(F.lit(at_once) - F.col("n"))
    return placed.select("target", "priority", "place", (F.col("place") <= free.scalar()).alias("starts"))
