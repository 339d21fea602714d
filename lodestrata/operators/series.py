"""Time series: buckets, rollups, histograms. Points have ``ts`` (TIMESTAMP or TIMESTAMP_NTZ, UTC) and ``value``; buckets are aligned to the epoch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.plans.lineage import cut
from lodestrata.plans.ranking import BIG_GROUP, null_safe_join, running_sums, value_blocks

SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "1d": 86_400, "1w": 604_800}


def seconds(ts: Column) -> Column:
    """Whole seconds since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("long")


def bucket_key(ts_ms: Column, size: str) -> Column:
    """The number of the bucket since the epoch of a time in milliseconds."""
    return F.floor(ts_ms / F.lit(SECONDS[size] * 1000)).cast("long")


def bucket_start(ts: Column, size_s: int, origin_s: int = 0) -> Column:
    """The second in which the bucket of a time begins; buckets count from ``origin_s``."""
    return (F.floor((seconds(ts) - origin_s) / F.lit(size_s)) * size_s + origin_s).cast("long")


def ranked_places(points: DataFrame, by: Sequence[str], places: dict[str, Column]) -> DataFrame:
    """Elements of each group's sorted values: ``by`` and one column per place, an index from 0 that may use the count ``n``.

    Values are counted before they are ranked, and groups of very many different values, as without ``by``, are ranked in blocks, so
    that no task holds a list of them.
    """
    counted = points.where("value is not null").select(*by, F.lit(0).alias("_all"), "value").groupBy(*by, "_all", "value").agg(F.count("*").alias("m"))
    keys = [*by, "_all"]
    blocked, split = value_blocks(cut(counted), keys, "value")
    ranked = running_sums(blocked, keys, ["value"], {"m": "upto"}, split)
    ranked = null_safe_join(ranked, blocked.groupBy(*keys).agg(F.sum("m").alias("n")), keys)
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *[F.min(F.when(F.col("upto") > index, F.col("value"))).alias(name) for name, index in places.items()])


def floor_percentiles(points: DataFrame, by: Sequence[str], percents: dict[str, float]) -> DataFrame:
    """The elements at index floor((n-1)*p/100) of each group's sorted values."""
    return ranked_places(points, by, {name: F.floor((F.col("n") - 1) * F.lit(float(p)) / 100) for name, p in percents.items()})


def exact_percentiles(points: DataFrame, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """Percentiles of each group's values, between neighbours by a straight line, as ``percentile`` has them, but without a map of a group's values."""
    index = {name: (F.col("n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    ends = ranked_places(points, by, {f"{name}_{side}": f(i) for name, i in index.items() for side, f in (("a", F.floor), ("b", F.ceil))})
    value = lambda name, i: F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (i - F.floor(i))
    return ends.select(*by, *[value(name, i).alias(name) for name, i in index.items()])


_FUNCTIONS = {
    "sum": lambda v: F.sum(v),
    "avg": lambda v: F.avg(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "count": lambda v: F.count(v),
    "p50": lambda v: F.percentile(v, 0.5),
    "p95": lambda v: F.percentile(v, 0.95),
    "p99": lambda v: F.percentile(v, 0.99),
    "p999": lambda v: F.percentile(v, 0.999),
    # Sketches, for groups whose values are too many to count exactly.
    "approx_p95": lambda v: F.percentile_approx(v, 0.95, 10_000),
    "approx_p99": lambda v: F.percentile_approx(v, 0.99, 10_000),
}


def bucket_aggregate(points: DataFrame, size: str | int, functions: Sequence[str], by: Sequence[str] = (), origin_s: int = 0) -> DataFrame:
    """``bucket`` (its first second), the columns ``by`` and one column per function of ``value``."""
    size_s = SECONDS[size] if isinstance(size, str) else size
    return points.where("ts is not null").groupBy(*by, bucket_start(F.col("ts"), size_s, origin_s).alias("bucket")).agg(*[_FUNCTIONS[f](F.col("value")).alias(f) for f in functions])


def downsample(points: DataFrame, source: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """``avg, min, max, count`` of coarser buckets, from those of finer ones, which are all that is shuffled a second time."""
    if SECONDS[target] <= SECONDS[source]:
        raise ValueError("the target bucket must be larger than the source bucket")
    fine = bucket_aggregate(points, source, ["sum", "min", "max", "count"], by)
    coarse = (F.floor(F.col("bucket") / SECONDS[target]) * SECONDS[target]).cast("long")
    return fine.groupBy(*by, coarse.alias("bucket")).agg((F.sum("sum") / F.sum("count")).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("count").alias("count"))


# --- rollups --------------------------------------------------------------------------------------------------------------------


def build_rollups(points: DataFrame, size_s: int, by: Sequence[str]) -> DataFrame:
    """Materialised windows [start, end): ``by, window_start, window_end, sum, min, max, count, p95, p99, needs_invalidation``.

    Percentiles are exact at every size: where a window holds more than BIG_GROUP points, they are ranked in blocks.
    """
    grouped = bucket_aggregate(points, size_s, ["sum", "min", "max", "count"], by)
    if (grouped.agg(F.max("count")).first()[0] or 0) <= BIG_GROUP:
        grouped = bucket_aggregate(points, size_s, ["sum", "min", "max", "count", "p95", "p99"], by)
    else:
        keys = [*by, "bucket"]
        timed = points.where("ts is not null").withColumn("bucket", bucket_start(F.col("ts"), size_s))
        grouped = null_safe_join(grouped, exact_percentiles(timed, keys, {"p95": 0.95, "p99": 0.99}), keys, "left")
    return grouped.select(*by, F.col("bucket").alias("window_start"), (F.col("bucket") + size_s).alias("window_end"), "sum", "min", "max", "count", "p95", "p99", F.lit(False).alias("needs_invalidation"))


def overlapping_rollups(rollups: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """The valid rollups that overlap [start, end)."""
    return rollups.where(~F.col("needs_invalidation") & (F.col("window_end") > start_s) & (F.col("window_start") < end_s))


def invalidate_rollups(rollups: DataFrame, late: DataFrame, size_s: int, by: Sequence[str]) -> DataFrame:
    """``rollups`` with those marked whose window holds a late point."""
    hit = late.select(*by, bucket_start(F.col("ts"), size_s).alias("window_start")).distinct().withColumn("hit", F.lit(True))
    return rollups.join(hit, [*by, "window_start"], "left").withColumn("needs_invalidation", F.col("needs_invalidation") | F.coalesce("hit", F.lit(False))).select(*rollups.columns)


def interval_join(points: DataFrame, windows: DataFrame, by: Sequence[str], size_s: int) -> DataFrame:
    """Each point with the windows of fixed size that hold it: an equi-join on the window's start instead of a range join."""
    return points.withColumn("window_start", bucket_start(F.col("ts"), size_s)).join(windows, [*by, "window_start"])


# --- histograms -------------------------------------------------------------------------------------------------------------------


def dense_histogram(points: DataFrame, size_s: int, by: Sequence[str]) -> DataFrame:
    """Counts of every bucket between a group's first and last, empty ones as 0: ``by, bucket, count``."""
    counts = bucket_aggregate(points, size_s, ["count"], by)
    spans = counts.groupBy(*by).agg(F.explode(F.sequence(F.min("bucket"), F.max("bucket"), F.lit(size_s).cast("long"))).alias("bucket"))
    return spans.join(counts, [*by, "bucket"], "left").select(*by, "bucket", F.coalesce("count", F.lit(0)).alias("count"))


def hour_of_day(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the 24 hours of the day, 0 to 23."""
    return _cells(points, by, F.hour("ts").alias("hour"), "hour", 24)


def day_of_week(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the 7 days of the week, 0 is Sunday."""
    return _cells(points, by, (F.dayofweek("ts") - 1).alias("dow"), "dow", 7)


def _cells(points: DataFrame, by: Sequence[str], cell: Column, name: str, n: int) -> DataFrame:
    counts = points.where("ts is not null").groupBy(*by, cell).agg(F.count("*").alias("count"))
    groups = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    all_of = groups.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return all_of.join(counts, [*by, name], "left").select(*by, name, F.coalesce("count", F.lit(0)).alias("count"))


def activity_heatmap(points: DataFrame) -> DataFrame:
    """The 168 cells of hour and day of week: ``hour, dow, count, intensity``, the count over the greatest count."""
    counts = points.where("ts is not null").groupBy(F.hour("ts").alias("hour"), (F.dayofweek("ts") - 1).alias("dow")).agg(F.count("*").alias("count"))
    cells = counts.sparkSession.range(168).select((F.col("id") % 24).cast("int").alias("hour"), F.floor(F.col("id") / 24).cast("int").alias("dow"))
    dense = cells.join(counts, ["hour", "dow"], "left").select("hour", "dow", F.coalesce("count", F.lit(0)).alias("count"))
    return dense.withColumn("intensity", F.coalesce(F.try_divide(F.col("count").cast("double"), F.max("count").over(W.partitionBy())), F.lit(0.0)))  # 168 rows


def value_histogram(points: DataFrame, bins: int | None = None) -> DataFrame:
    """Equal-width bins of ``value``: ``bin, low, high, count, percentage``; by default max(10, floor(sqrt n)) bins.

    The greatest value belongs to the last bin; of equal values one bin holds all.
    """
    stats = points.where("value is not null").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
    wanted = F.greatest(F.lit(10), F.floor(F.sqrt("n"))).cast("int") if bins is None else F.lit(bins)
    bounds = stats.select("lo", "hi", "n", F.when(F.col("lo") == F.col("hi"), 1).otherwise(wanted).alias("bins"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    rows = points.where("value is not null").select("value", bounds.select(F.struct("*")).scalar().alias("b")).select("value", "b.*")
    bin_of = F.when(F.col("lo") == F.col("hi"), 0).otherwise(F.least(F.col("bins") - 1, F.floor((F.col("value") - F.col("lo")) / width))).cast("int")
    counts = rows.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("count"))
    all_of = bounds.where("n > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return all_of.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"), (F.coalesce("count", F.lit(0)) * 100.0 / F.col("n")).alias("percentage"))


# --- retention ---------------------------------------------------------------------------------------------------------------------

#: Age in days below which a level holds, and the level's interval in seconds; older data are weekly.
LEVELS = ((7, "raw", 0), (30, "1m", 60), (90, "5m", 300), (365, "1h", 3600), (730, "1d", 86_400))


def retention_level(age_s: Column) -> Column:
    """The resolution in which data of an age are kept."""
    out = F.lit("1w")
    for days, name, _ in reversed(LEVELS):
        out = F.when(age_s < days * 86_400, name).otherwise(out)
    return out


def downsample_by_age(points: DataFrame, now: Column, by: Sequence[str] = ()) -> DataFrame:
    """Points thinned by their age: ``by, level, bucket, avg, min, max, count``; raw points keep their second."""
    age = seconds(now) - seconds(F.col("ts"))
    size = F.lit(604_800)
    for days, _, s in reversed(LEVELS):
        size = F.when(age < days * 86_400, max(s, 1)).otherwise(size)
    bucket = (F.floor(seconds(F.col("ts")) / size) * size).cast("long")
    rows = points.where("ts is not null and value is not null").select(*by, retention_level(age).alias("level"), bucket.alias("bucket"), "value")
    return rows.groupBy(*by, "level", "bucket").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("count"))


def retention_counts(points: DataFrame, now: Column, raw_days: int = 7, archive_days: int = 730) -> DataFrame:
    """``kept, downsampled, archived`` points."""
    age = (seconds(now) - seconds(F.col("ts"))) / 86_400
    return points.agg(F.count_if(age < raw_days).alias("kept"), F.count_if((age >= raw_days) & (age < archive_days)).alias("downsampled"), F.count_if(age >= archive_days).alias("archived"))


def retention_report(points: DataFrame, now: Column, size: Column, raw_days: int = 7, archive_days: int = 730) -> DataFrame:
    """``points, points_after, reduction_percent, mb_saved``: what thinning by age and archiving save; ``size`` is the bytes of a point."""
    age = (seconds(now) - seconds(F.col("ts"))) / 86_400
    sized = points.where("ts is not null").select("*", size.alias("_size"), age.alias("_age"))
    whole = sized.agg(F.count("*").alias("points"), F.sum("_size").alias("bytes"))
    kept = sized.where(F.col("_age") < raw_days).agg(F.count("*").alias("raw"), F.coalesce(F.sum("_size"), F.lit(0)).alias("raw_bytes"))
    thin = downsample_by_age(sized.where((F.col("_age") >= raw_days) & (F.col("_age") < archive_days)), now).agg(F.count("*").alias("thin"))
    one = whole.join(F.broadcast(kept)).join(F.broadcast(thin))  # one row each
    after = F.col("raw") + F.col("thin")
    saved = F.col("bytes") - F.col("raw_bytes") - F.col("thin") * F.col("bytes") / F.col("points")
    return one.where("points > 0").select("points", after.alias("points_after"), ((1 - after / F.col("points")) * 100).alias("reduction_percent"), (saved / 1e6).alias("mb_saved"))


def numbered(points: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``points``, cut or cheap to read, with ``i``, from 1 in ``order`` within a group; long series are numbered in blocks of time."""
    rows = points.withColumn("_t", F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double")).withColumn("_one", F.lit(1).cast("long"))
    blocked, split = value_blocks(rows, by, "_t")
    return running_sums(blocked, by, order, {"_one": "i"}, split).drop("_t", "_one", "block")
