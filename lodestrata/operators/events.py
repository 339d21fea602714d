"""The event store: typed appends, filtered reads, retention; spans and metrics made of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of a payload at most.
MAX_PAYLOAD = 1 << 20
PRIVATE, TEAM, PUBLIC = 0, 1, 2


def event_filter(types: Sequence[str] | None = None, actor: int | None = None, session: int | None = None, start: Column | None = None, end: Column | None = None, min_visibility: int | None = None, target: tuple[str, str] | None = None) -> Column:
    """The filter of an event query, times closed; a target is looked up in the JSON payload. All of it but that reaches the scan."""
    tests = [
        None if types is None else F.col("event_type").isin(list(types)),
        None if actor is None else F.col("actor_id") == actor,
        None if session is None else F.col("session_id") == session,
        None if start is None else F.col("ts") >= start,
        None if end is None else F.col("ts") <= end,
        None if min_visibility is None else F.col("visibility") >= min_visibility,
        None if target is None else (F.get_json_object("payload", "$.target_type") == target[0]) & (F.get_json_object("payload", "$.target_id") == target[1]),
    ]
    out = F.lit(True)
    for test in tests:
        out = out if test is None else out & test
    return out


def query(events: DataFrame, where: Column, limit: int | None = None) -> DataFrame:
    """The matching events in the order of their ids; the limit comes last."""
    rows = events.where(where).orderBy("event_id")
    return rows if limit is None else rows.limit(limit)


def checked(events: DataFrame) -> DataFrame:
    """``events`` for appending; an event whose payload is too long fails the write."""
    size = F.octet_length("payload")
    return events.withColumn("payload", F.when(size <= MAX_PAYLOAD, F.col("payload")).when(size.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("payload too long: event "), F.col("event_id").cast("string")))))


def append(events: DataFrame, path: str) -> None:
    """Append events to the store at ``path``, partitioned by day."""
    checked(events).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def recorded(rows: DataFrame, event_type: str, payload: Sequence[str], event_id: str = "event_id", ts: str = "ts", actor: str = "actor_id", session: str | None = "session_id", visibility: int = TEAM) -> DataFrame:
    """Typed rows (sessions, operations, review notes, samples) as events; the columns ``payload`` become its JSON fields."""
    return rows.select(
        F.col(event_id).alias("event_id"), F.lit(event_type).alias("event_type"), F.col(ts).alias("ts"), F.col(actor).alias("actor_id"),
        (F.lit(None).cast("long") if session is None else F.col(session)).alias("session_id"), F.lit(visibility).alias("visibility"), F.to_json(F.struct(*payload)).alias("payload"),
    )


def typed(events: DataFrame, event_type: str, schema: str) -> DataFrame:
    """The events of one type with the fields of their payload as columns; broken payloads have nulls."""
    return events.where(F.col("event_type") == event_type).withColumn("p", F.from_json("payload", schema)).select(*[c for c in events.columns if c != "payload"], "p.*")


def compacted(events: DataFrame, cutoff: Column) -> DataFrame:
    """What retention keeps: events from ``cutoff`` on."""
    return events.where(F.col("ts") >= cutoff)


def session_spans(events: DataFrame) -> DataFrame:
    """``session_id, events, actors, first_ts, last_ts, seconds`` of each session."""
    per = events.where("session_id is not null").groupBy("session_id").agg(F.countDistinct("event_id").alias("events"), F.countDistinct("actor_id").alias("actors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return per.withColumn("seconds", F.floor((F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 1_000_000))


def counters(events: DataFrame, label: str, amount: Column | None = None) -> DataFrame:
    """``label, value``: a counter per label."""
    return events.groupBy(F.col(label).alias("label")).agg((F.count("*") if amount is None else F.sum(amount)).alias("value"))


def gauges(samples: DataFrame, label: str, value: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """``label, value``: the last value per label."""
    return samples.groupBy(F.col(label).alias("label")).agg(F.max_by(value, F.struct(ts, tie)).alias("value"))


def cumulative_histogram(samples: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``le, count`` of each bound and of +Inf: the values up to it, with ``sum`` and ``total``; one pass, whatever the number of bounds."""
    n = len(bounds)
    counts = [F.count_if(F.col(value) <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(bounds)]
    row = samples.groupBy(*by).agg(*counts, F.count(value).alias("total"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"))
    entries = [F.struct(F.lit(f"{float(bounds[i]):.1f}").alias("le"), F.col(f"b{i}").alias("count")) for i in range(n)] + [F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("count"))]
    return row.select(*by, F.explode(F.array(*entries)).alias("x"), "sum", "total").select(*by, "x.le", "x.count", "sum", "total")


def fixed_window_limit(requests: DataFrame, by: Sequence[str], limit: int, seconds: int = 60) -> DataFrame:
    """``requests`` with ``allowed``: the first ``limit`` of each key and window of fixed length, in order of time and id."""
    from pyspark.sql import Window as W

    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(seconds * 1_000_000))
    place = F.row_number().over(W.partitionBy(*by, slot).orderBy("ts", "event_id"))
    return requests.withColumn("allowed", place <= limit)
