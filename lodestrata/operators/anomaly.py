"""Outliers, trends, seasons and regressions of series of ``value`` per group ``by``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestrata.operators.series import numbered, ranked_places
from lodestrata.plans.lineage import cut
from lodestrata.plans.ranking import null_safe_join


def zscore_outliers(points: DataFrame, by: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """The points further than ``threshold`` population deviations from their group's mean, with ``mean, sd, z``.

    Groups of fewer than 3 points or without spread have none. Statistics are aggregated, then joined: points aren't gathered.
    """
    stats = points.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("value").alias("n")).where("n >= 3 and sd > 0")
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    return points.join(stats, list(by)).withColumn("z", z).where(F.abs("z") > threshold).drop("n")


def iqr_outliers(points: DataFrame, by: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """The points outside the quartile fences, with ``q1, q3``; quartiles are the elements n/4 and 3n/4 of the sorted values.

    Groups of fewer than 4 points, or with equal quartiles, have none.
    """
    quartile = lambda k: F.floor(F.col("n") * k / 4)
    fences = ranked_places(points, by, {"q1": quartile(1), "q3": quartile(3)}).where("n >= 4 and q3 > q1")
    reach = (F.col("q3") - F.col("q1")) * multiplier
    return points.join(fences, list(by)).where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).drop("n")


def baseline(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """``mean, sd, median, p95, p99, min, max, n`` of each group; the median is element n/2, percentiles element floor((n-1)p) of the sorted values.
    """
    places = ranked_places(points, by, {"median": F.floor(F.col("n") / 2), "p95": F.floor((F.col("n") - 1) * 0.95), "p99": F.floor((F.col("n") - 1) * 0.99)}).drop("n")
    moments = points.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n"))
    return moments.where("n > 0").join(places, list(by))


def ksigma_anomalies(points: DataFrame, base: DataFrame, by: Sequence[str], k: float = 3.0) -> DataFrame:
    """The points beyond ``k`` deviations of their baseline: ``kind, severity, score``.

    Severity is critical beyond twice the threshold, high beyond 1.5 times, else medium; the score is the deviation over twice the
    threshold, 1 at most.
    """
    limit = F.col("sd") * k
    off = F.abs(F.col("value") - F.col("mean"))
    severity = F.when(off > 2 * limit, "critical").when(off > 1.5 * limit, "high").otherwise("medium")
    rows = points.join(base.select(*by, "mean", "sd").where("sd > 0"), list(by)).where(off > limit)
    return rows.withColumn("kind", F.when(F.col("value") > F.col("mean"), "spike").otherwise("drop")).withColumn("severity", severity).withColumn("score", F.least(F.lit(1.0), off / (2 * limit)))


#: Points of a series that one window sums, and the greatest logarithm of a weight within it.
RUN, REACH = 4096, 140.0


def decayed_sums(rows: DataFrame, by: Sequence[str], index: str, x: str, ratio: float, out: str, most: int) -> DataFrame:
    """``rows`` with ``out``: s(i) = x(i) + ratio * s(i - 1), from s(0) = 0; ``index`` counts from 1, without gaps, to ``most`` at most.

    Within a block of neighbours it is a running sum of x over growing weights, or of the few terms that don't vanish where the
    ratio is small; the ends of the blocks follow the same rule with a power of the ratio, and are summed in blocks in turn. So long
    series are nobody's single window.
    """
    if ratio <= 0:
        return rows.withColumn(out, F.col(x).cast("double"))
    fall = -math.log(ratio)
    size = RUN if fall > REACH / 2 else max(2, min(RUN, int(REACH / fall)))
    blocked = rows.withColumn("_b", F.floor((F.col(index) - 1) / size).cast("long")).withColumn("_k", (F.col(index) - 1) % size + 1)
    inside = W.partitionBy(*by, "_b").orderBy("_k")
    if fall > REACH / 2:
        terms = [F.lit(ratio**j) * F.coalesce(F.lag(x, j).over(inside), F.lit(0.0)) for j in range(int(745 / fall) + 1)]
        blocked = blocked.withColumn("_in", reduce(add, terms))
    else:
        power = lambda sign: F.exp(F.lit(-sign * fall) * F.col("_k"))
        blocked = blocked.withColumn("_in", power(1) * F.sum(F.col(x) * power(-1)).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    if most <= size:
        return blocked.withColumn(out, F.col("_in")).drop("_b", "_k", "_in")
    blocked = cut(blocked)
    ends = blocked.groupBy(*by, "_b").agg(F.max_by("_in", "_k").alias("_x")).select(*by, (F.col("_b") + 1).alias("_n"), "_x")
    # The end of the block before, which is the n-th, is what block n begins with.
    ends = decayed_sums(ends, by, "_n", "_x", ratio**size, "_end", -(-most // size)).select(*by, F.col("_n").alias("_b"), F.col("_end").alias("_before"))
    carried = F.exp(F.lit(-fall) * F.col("_k")) * F.coalesce("_before", F.lit(0.0))
    return null_safe_join(blocked, ends, [*by, "_b"], "left").withColumn(out, F.col("_in") + carried).drop("_b", "_k", "_in", "_before")


def ema_anomalies(points: DataFrame, by: Sequence[str], order: Sequence[str], alpha: float = 0.2, least: int = 10, sigma: float = 2.5) -> DataFrame:
    """The points further than ``sigma`` exponential deviations from the exponential average: ``ema, deviation``.

    The average begins at the first value and runs over the first ``least`` points; a full pass from there gives the deviation, which
    so knows the whole series; a second pass from the first value compares. Series of fewer points have none. Both passes are one,
    as they differ by how they begin only; what is at the end of a pass is a weighted sum.
    """
    keep = 1 - alpha
    power = lambda n: F.pow(F.lit(float(keep)), n)
    rows = cut(numbered(points.where("value is not null"), by, order))
    head = F.sum(F.when(F.col("i") <= least, alpha * power(F.lit(least) - F.col("i")) * F.col("value")))
    long = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min_by("value", "i").alias("_first"), head.alias("_head")).where(F.col("_n") >= least)
    long = cut(long.withColumn("_begun", F.col("_head") + F.lit(keep**least) * F.col("_first")))
    most = long.agg(F.max("_n")).first()[0] or 0
    weighted = null_safe_join(rows, long, list(by)).withColumn("_x", F.lit(alpha) * F.col("value").cast("double"))
    passed = cut(decayed_sums(weighted, by, "i", "_x", keep, "_s", most))
    off = F.col("value") - (F.col("_s") + power(F.col("i")) * F.col("_begun"))
    spread = passed.groupBy(*by).agg(F.sqrt(F.sum(alpha * power(F.col("_n") - F.col("i")) * off * off)).alias("_sd"))
    two = null_safe_join(passed, spread, list(by)).withColumn("ema", F.col("_s") + power(F.col("i")) * F.col("_first")).withColumn("deviation", F.col("value") - F.col("ema"))
    return two.where(F.abs("deviation") > sigma * F.col("_sd")).select(*points.columns, "ema", "deviation")


def trend(points: DataFrame, by: Sequence[str], order: Sequence[str], slope_limit: float = 0.1) -> DataFrame:
    """The straight line over the points in order: ``slope, strength, trend_type``.

    The strength is the root of R squared; below 0.3 the series is variable if its deviation exceeds half its mean, else stable.
    Fewer than 2 points are stable with strength 0.
    """
    rows = numbered(points.where("value is not null"), by, order).withColumn("x", F.col("i") - 1)
    fit = rows.groupBy(*by).agg(F.regr_slope("value", "x").alias("slope"), F.regr_r2("value", "x").alias("r2"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"), F.max_by("value", "i").alias("last_value"))
    strength = F.sqrt(F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("sd") > 0, F.col("r2")), F.lit(0.0))))
    kind = (
        F.when((F.col("n") < 2), "stable")
        .when(F.col("strength") < 0.3, F.when(F.try_divide(F.col("sd"), F.abs("mean")) > 0.5, "variable").otherwise("stable"))
        .when(F.col("slope") > slope_limit, "increasing")
        .when(F.col("slope") < -slope_limit, "decreasing")
        .otherwise("stable")
    )
    return fit.withColumn("slope", F.coalesce("slope", F.lit(0.0))).withColumn("strength", strength).withColumn("trend_type", kind).select(*by, "slope", "strength", "trend_type", "last_value", "n")


def forecast(points: DataFrame, by: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """The next ``count`` values by the series' line: ``step`` (from 1) and ``predicted``."""
    return trend(points, by, order).select(*by, F.explode(F.sequence(F.lit(1), F.lit(count))).alias("step"), "last_value", "slope").select(*by, "step", (F.col("last_value") + F.col("step") * F.col("slope")).alias("predicted"))


def seasonality(points: DataFrame, by: Sequence[str], order: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """How alike points are to those ``lag`` places later: ``lag, score, pairs`` of each candidate.

    Of a pair the likeness is 1 minus its difference over its greater value, 0 if that isn't positive; the score is their mean.
    """
    rows = numbered(points.where("value is not null"), by, order).select(*by, "i", "value")
    shifted = rows.select(*by, F.explode(F.array(*[F.lit(n) for n in lags])).alias("lag"), "i", F.col("value").alias("later")).withColumn("i", F.col("i") - F.col("lag"))
    pairs = rows.join(shifted, [*by, "i"])
    top = F.greatest("value", "later")
    like = F.when(top > 0, 1 - F.abs(F.col("value") - F.col("later")) / top).otherwise(0.0)
    return pairs.groupBy(*by, "lag").agg(F.avg(like).alias("score"), F.count("*").alias("pairs"))


#: Ratios of the latest sample to the baseline beyond which it is a regression.
REGRESSIONS = {"throughput": ("below", 0.95), "avg_latency": ("above", 1.1), "p99": ("above", 1.15), "error_rate": ("above", 1.5)}


def regressions(samples: DataFrame, baselines: DataFrame, by: Sequence[str], min_samples: int = 1) -> DataFrame:
    """The metrics whose latest sample is worse than the baseline: ``metric, ratio``, for keys of enough samples.

    ``samples`` has ``by, ts`` and the metrics, ``baselines`` has ``by`` and the metrics as ``base_<metric>``.
    """
    last = samples.groupBy(*by).agg(F.count("*").alias("n"), *[F.max_by(m, F.struct("ts", m)).alias(m) for m in REGRESSIONS]).where(F.col("n") >= min_samples)
    joined = last.join(baselines, list(by))
    cases = []
    for metric, (side, limit) in REGRESSIONS.items():
        ratio = F.try_divide(F.col(metric), F.col(f"base_{metric}"))
        worse = ratio < limit if side == "below" else ratio > limit
        cases.append(F.when(worse, F.struct(F.lit(metric).alias("metric"), ratio.alias("ratio"))))
    return joined.withColumn("x", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull()))).select(*by, "x.metric", "x.ratio")


def recent_trend(samples: DataFrame, base: DataFrame, by: Sequence[str], value: str, k: int = 5) -> DataFrame:
    """The mean of the last ``k`` samples against the baseline: ``recent, change``."""
    newest = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("ts"), F.desc(value)))
    recent = samples.withColumn("_n", newest).where(F.col("_n") <= k).groupBy(*by).agg(F.avg(value).alias("recent"))
    return recent.join(base, list(by)).withColumn("change", F.try_divide(F.col("recent") - F.col("base"), F.col("base")))


# Samples that a trend needs, and the share of the baseline whose loss is urgent.
TREND_SAMPLES, URGENT_LOSS = 5, 0.2


def restorations(samples: DataFrame, base: DataFrame, by: Sequence[str], value: str, k: int = 5, tolerance: float = 0.05) -> DataFrame:
    """What has fallen below its baseline and should be restored: ``by, current, target, loss_percent, priority``.

    The current level is the mean of the last ``k`` samples; keys of fewer than TREND_SAMPLES samples aren't judged.
    """
    many = samples.groupBy(*by).count().where(F.col("count") >= TREND_SAMPLES).select(*by)
    now = recent_trend(samples.join(many, list(by), "left_semi"), base, by, value, k).where(F.col("change") < -tolerance)
    priority = F.when(F.col("change") < -URGENT_LOSS, "high").otherwise("medium")
    return now.select(*by, F.col("recent").alias("current"), F.col("base").alias("target"), (-F.col("change") * 100).alias("loss_percent"), priority.alias("priority"))
