"""Windows over streams with watermarks. Each function also takes a batch DataFrame, with the same result on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

_STATS = lambda value: [F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")]


def _flat(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.select(*by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "total", "least", "most")


def tumbling(events: DataFrame, size: str, by: Sequence[str], value: str = "value", late: str = "1 hour") -> DataFrame:
    """``by, window_start, window_end, n, total, least, most`` of windows of fixed size; rows later than ``late`` are dropped by a stream."""
    return _flat(events.withWatermark("ts", late).groupBy(*by, F.window("ts", size).alias("window")).agg(*_STATS(value)), by)


def sliding(events: DataFrame, size: str, slide: str, by: Sequence[str], value: str = "value", late: str = "1 hour") -> DataFrame:
    """The same of windows that overlap."""
    return _flat(events.withWatermark("ts", late).groupBy(*by, F.window("ts", size, slide).alias("window")).agg(*_STATS(value)), by)


def sessions(events: DataFrame, gap: str, by: Sequence[str], value: str = "value", late: str = "1 hour") -> DataFrame:
    """The same of sessions that end after a ``gap`` without events."""
    return _flat(events.withWatermark("ts", late).groupBy(*by, F.session_window("ts", gap).alias("window")).agg(*_STATS(value)), by)


def last_values(events: DataFrame, by: Sequence[str], value: str = "value", tie: str = "event_id") -> DataFrame:
    """The last value of each key, as a gauge."""
    return events.groupBy(*by).agg(F.max(F.struct("ts", tie, value)).alias("x")).select(*by, F.col("x.ts").alias("ts"), F.col(f"x.{value}").alias(value))
