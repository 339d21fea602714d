"""State changes, time series and anomalies, over ``events`` and ``entity_snapshots``.

An event is a change of the entity ``user:<user_id>`` in the attribute ``event_type``, and a point of the series of its type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import anomaly, series, temporal
from lodestrata.operators.snapshot_diff import neighbouring_changes
from lodestrata.plans import nl
from lodestrata.queries.registry import Registry
from lodestrata.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.query

#: The period and moments that the queries ask for.
START, END, AT = "2024-01-05 00:00:00", "2024-01-20 00:00:00", "2024-01-10 12:00:00"


def when(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


def changes_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"), "ts", F.lit("user").alias("entity_ns"), F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("key"), F.lit(None).cast("string").alias("old_value"), F.col("value").cast("string").alias("new_value")
    )


def points_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


_PERIOD = f"ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{END}'"
_ID = "CAST(user_id AS VARCHAR) AS entity_id"

# --- state changes --------------------------------------------------------------------------------------------------------------


@Q("temporal_as_of", f"SELECT {_ID}, arg_max(event_type, (ts, -event_id)) AS key, round(arg_max(value, (ts, -event_id)), 6) AS value FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id")
def temporal_as_of(spark: SparkSession, sf: str) -> DataFrame:
    found = temporal.as_of(changes_of(spark, sf), when(AT))
    return found.select("entity_id", "key", F.round(F.col("new_value").cast("double"), 6).alias("value"))


@Q("temporal_as_of_attribute", f"SELECT {_ID}, event_type AS key, round(arg_max(value, (ts, -event_id)), 6) AS value FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY user_id, event_type")
def temporal_as_of_attribute(spark: SparkSession, sf: str) -> DataFrame:
    found = temporal.as_of(changes_of(spark, sf), when(AT), (*temporal.ENTITY, "key"))
    return found.select("entity_id", "key", F.round(F.col("new_value").cast("double"), 6).alias("value"))


@Q(
    "temporal_multi_as_of",
    "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, e.seq FROM customer LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, -event_id)) AS seq FROM events WHERE ts <= TIMESTAMP '2024-01-02' GROUP BY 1) e ON e.user_id = c_custkey",
)
def temporal_multi_as_of(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "customer").select(F.lit("user").alias("entity_ns"), F.col("c_custkey").cast("string").alias("entity_id"))
    return temporal.multi_as_of(changes_of(spark, sf), asked, when("2024-01-02 00:00:00")).select("entity_id", "seq")


@Q("temporal_between", f"SELECT event_id AS seq, {_ID}, event_type AS key FROM events WHERE {_PERIOD}")
def temporal_between(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.between(changes_of(spark, sf), when(START), when(END)).select("seq", "entity_id", "key")


@Q("temporal_at_timestamp", "SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS entity_id FROM events WHERE ts = (SELECT max(ts) FROM events)")
def temporal_at_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    changes = changes_of(spark, sf)
    return temporal.at_timestamp(changes, F.lit(changes.agg(F.max("ts")).first()[0])).select("seq", "entity_id")


@Q("temporal_first_state", f"SELECT {_ID}, arg_min(event_id, (ts, event_id)) AS seq, min(ts) AS ts FROM events GROUP BY user_id")
def temporal_first_state(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.first_state(changes_of(spark, sf)).select("entity_id", "seq", "ts")


@Q("temporal_last_state", f"SELECT {_ID}, arg_max(event_id, (ts, -event_id)) AS seq, max(ts) AS ts FROM events GROUP BY user_id")
def temporal_last_state(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.last_state(changes_of(spark, sf)).select("entity_id", "seq", "ts")


@Q("temporal_change_frequency", f"SELECT {_ID}, count(*) AS changes, min(ts) AS first_ts, max(ts) AS last_ts, round(count(*) / 15.0, 6) AS per_day FROM events WHERE {_PERIOD} GROUP BY user_id")
def temporal_change_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.change_frequency(changes_of(spark, sf), when(START), when(END)).select("entity_id", "changes", "first_ts", "last_ts", F.round("per_day", 6).alias("per_day"))


@Q("temporal_count_distinct", f"SELECT {_ID}, event_type AS key, count(DISTINCT value) AS distinct_values FROM events WHERE {_PERIOD} GROUP BY user_id, event_type")
def temporal_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.count_distinct(changes_of(spark, sf), when(START), when(END)).select("entity_id", "key", "distinct_values")


@Q(
    "temporal_rate",
    f"""WITH s AS (SELECT user_id, event_type, (value - lag(value) OVER w) AS dv, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS dt FROM events WHERE {_PERIOD} WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
    SELECT {_ID}, event_type AS key, round(avg(dv / (dt / 1e6) * 3600), 5) AS avg_rate, round(max(dv / (dt / 1e6) * 3600), 5) AS max_rate, round(min(dv / (dt / 1e6) * 3600), 5) AS min_rate, count(*) AS steps FROM s WHERE dt > 0 GROUP BY user_id, event_type""",
)
def temporal_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = temporal.rates(changes_of(spark, sf), when(START), when(END), 3600)
    return r.select("entity_id", "key", *[F.round(c, 5).alias(c) for c in ("avg_rate", "max_rate", "min_rate")], "steps")


@Q(
    "temporal_thresholds",
    f"""SELECT event_id AS seq, 'above' AS kind, round((value - 150) / 150, 6) AS severity FROM events WHERE {_PERIOD} AND value > 150
    UNION ALL SELECT event_id, 'below', round((2.0 - value) / 2.0, 6) FROM events WHERE {_PERIOD} AND value < 2""",
)
def temporal_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.threshold_violations(changes_of(spark, sf), when(START), when(END), 150.0, 2.0).select("seq", "kind", F.round("severity", 6).alias("severity"))


@Q(
    "join_asof",
    "SELECT o_orderkey, e.event_id FROM orders ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) e ON o_custkey = e.user_id AND e.ts <= o_orderdate + INTERVAL 28 YEAR",
)
def join_asof(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + interval 28 years").alias("ts"))
    found = temporal.asof_join(orders, table(spark, sf, "events").select("user_id", "ts", "event_id"), ["user_id"], seq="event_id")
    return found.select("o_orderkey", "match.event_id")


_KEYS = ("entity_namespace", "entity_local_id")


@Q(
    "entity_snapshot_as_of",
    "SELECT entity_namespace, entity_local_id, arg_max(id, (ts, version, received_at, id)) AS id FROM entity_snapshots WHERE ts <= TIMESTAMP '2024-02-15' AND branch_id IS NULL GROUP BY 1, 2",
)
def entity_snapshot_as_of(spark: SparkSession, sf: str) -> DataFrame:
    main = table(spark, sf, "entity_snapshots").where("branch_id is null")
    return temporal.snapshot_as_of(main, when("2024-02-15 00:00:00"), _KEYS).select(*_KEYS, "id")


@Q(
    "entity_snapshot_chain",
    """WITH c AS (SELECT DISTINCT ON (id) * FROM entity_snapshots WHERE branch_id IS NULL ORDER BY id, received_at DESC, version DESC)
    SELECT id, row_number() OVER w AS chain_version, lag(id) OVER w AS chain_parent FROM c WINDOW w AS (PARTITION BY entity_namespace, entity_local_id ORDER BY version, received_at, id)""",
)
def entity_snapshot_chain(spark: SparkSession, sf: str) -> DataFrame:
    main = table(spark, sf, "entity_snapshots").where("branch_id is null")
    once = main.groupBy("id").agg(F.max_by(F.struct(*_KEYS, "version", "received_at"), F.struct("received_at", "version")).alias("x")).select("id", "x.*")
    return temporal.numbered_snapshots(once, _KEYS, ["version", "received_at", "id"], "id").select("id", F.col("chain_version").cast("long").alias("chain_version"), "chain_parent")


@Q("entity_snapshots_by_txn", "SELECT txn_id, count(DISTINCT id) AS snapshots FROM entity_snapshots GROUP BY 1")
def entity_snapshots_by_txn(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_snapshots").groupBy("txn_id").agg(F.countDistinct("id").alias("snapshots"))


@Q(
    "entity_field_delta",
    """WITH pairs AS (SELECT a.delivery_no, a.entity_namespace, a.entity_local_id, a.state_data AS older, b.state_data AS newer
      FROM (SELECT DISTINCT ON (delivery_no, entity_namespace, entity_local_id) * FROM snapshot_deliveries ORDER BY delivery_no, entity_namespace, entity_local_id, delivered_at DESC) a
      JOIN (SELECT DISTINCT ON (delivery_no, entity_namespace, entity_local_id) * FROM snapshot_deliveries ORDER BY delivery_no, entity_namespace, entity_local_id, delivered_at DESC) b
      USING (entity_namespace, entity_local_id) WHERE a.delivery_no = 1 AND b.delivery_no = 2),
    fa AS (SELECT entity_namespace, entity_local_id, t.fullkey, t.type || coalesce(CAST(t.atom AS VARCHAR), '') AS v FROM pairs, json_tree(older) t),
    fb AS (SELECT entity_namespace, entity_local_id, t.fullkey, t.type || coalesce(CAST(t.atom AS VARCHAR), '') AS v FROM pairs, json_tree(newer) t),
    d AS (SELECT coalesce(fa.entity_namespace, fb.entity_namespace) AS entity_namespace, coalesce(fa.entity_local_id, fb.entity_local_id) AS entity_local_id,
                 regexp_extract(coalesce(fa.fullkey, fb.fullkey), '^\\$\\."?([a-z_]+)', 1) AS field FROM fa FULL JOIN fb ON fa.entity_namespace = fb.entity_namespace AND fa.entity_local_id = fb.entity_local_id AND fa.fullkey = fb.fullkey
          WHERE fa.v IS DISTINCT FROM fb.v AND coalesce(fa.fullkey, fb.fullkey) != '$'),
    tops AS (SELECT d.entity_namespace, d.entity_local_id, d.field, bool_or(json_exists(p.older, '$.' || d.field)) AS had, bool_or(json_exists(p.newer, '$.' || d.field)) AS has
             FROM d JOIN pairs p USING (entity_namespace, entity_local_id) GROUP BY 1, 2, 3)
    SELECT entity_namespace, entity_local_id, field, CASE WHEN NOT coalesce(had, false) THEN 'added' WHEN NOT coalesce(has, false) THEN 'removed' ELSE 'modified' END AS change FROM tops""",
)
def entity_field_delta(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "snapshot_deliveries").groupBy(*_KEYS, "delivery_no").agg(F.max_by("state_data", "delivered_at").alias("state"))
    a, b = rows.where("delivery_no = 1").select(*_KEYS, F.col("state").alias("older")), rows.where("delivery_no = 2").select(*_KEYS, F.col("state").alias("newer"))
    return a.join(b, list(_KEYS)).select(*_KEYS, F.explode(temporal.field_delta(F.col("older"), F.col("newer"))).alias("d")).select(*_KEYS, "d.field", "d.change")


@Q(
    "entity_field_delta_all",
    """WITH n AS (SELECT delivery_no, lag(delivery_no) OVER (ORDER BY delivery_no) AS before FROM (SELECT DISTINCT delivery_no FROM snapshot_deliveries WHERE delivery_no IS NOT NULL)),
    r AS (SELECT DISTINCT ON (delivery_no, entity_namespace, entity_local_id) * FROM snapshot_deliveries ORDER BY delivery_no, entity_namespace, entity_local_id, delivered_at DESC),
    pairs AS MATERIALIZED (SELECT row_number() OVER () AS pair, b.delivery_no, b.entity_namespace, b.entity_local_id, a.state_data AS older, b.state_data AS newer
      FROM n JOIN r b ON b.delivery_no = n.delivery_no JOIN r a ON a.delivery_no = n.before AND a.entity_namespace IS NOT DISTINCT FROM b.entity_namespace AND a.entity_local_id IS NOT DISTINCT FROM b.entity_local_id),
    fa AS (SELECT pair, t.fullkey, t.type || coalesce(CAST(t.atom AS VARCHAR), '') AS v FROM pairs, json_tree(older) t),
    fb AS (SELECT pair, t.fullkey, t.type || coalesce(CAST(t.atom AS VARCHAR), '') AS v FROM pairs, json_tree(newer) t),
    d AS (SELECT DISTINCT coalesce(fa.pair, fb.pair) AS pair, regexp_extract(coalesce(fa.fullkey, fb.fullkey), '^\\$\\."?([a-z_]+)', 1) AS field
          FROM fa FULL JOIN fb ON fa.pair = fb.pair AND fa.fullkey = fb.fullkey WHERE fa.v IS DISTINCT FROM fb.v AND coalesce(fa.fullkey, fb.fullkey) != '$')
    SELECT delivery_no, entity_namespace, entity_local_id, field,
           CASE WHEN NOT coalesce(json_exists(older, '$.' || field), false) THEN 'added' WHEN NOT coalesce(json_exists(newer, '$.' || field), false) THEN 'removed' ELSE 'modified' END AS change FROM d JOIN pairs USING (pair)""",
)
def entity_field_delta_all(spark: SparkSession, sf: str) -> DataFrame:
    """Each delivery against the nearest earlier one that is present; records that stand in one of both only have no delta, p3_found names them."""
    changed = neighbouring_changes(table(spark, sf, "snapshot_deliveries"), keep_state=True).where("change_kind = 'changed'")
    return changed.select("delivery_no", *_KEYS, F.explode(temporal.field_delta(F.col("old_state"), F.col("new_state"))).alias("d")).select("delivery_no", *_KEYS, "d.field", "d.change")


# --- buckets ------------------------------------------------------------------------------------------------------------------------


def _bucket(s: int, origin: int = 0) -> str:
    return f"CAST(floor((epoch_us(ts) // 1000000 - {origin}) / {s}.0) * {s} + {origin} AS BIGINT)"


def _rounded(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return df.select(*keys, *[(F.round(c, 5) if c != "count" else F.col(c)).alias(c) for c in names])


_SQL = {"sum": "sum(value)", "avg": "avg(value)", "min": "min(value)", "max": "max(value)", "p50": "quantile_cont(value, 0.5)", "p95": "quantile_cont(value, 0.95)", "p99": "quantile_cont(value, 0.99)", "p999": "quantile_cont(value, 0.999)"}


def _columns(names: list[str]) -> str:
    return ", ".join("count(value) AS count" if n == "count" else f"round({_SQL[n]}, 5) AS {n}" for n in names)


_ALL = ["sum", "avg", "min", "max", "count", "p50", "p95", "p99", "p999"]
for _size, _s in series.SECONDS.items():
    _names = _ALL if _size in ("1h", "1d", "1w") else _ALL[:5]
    REGISTRY.add(
        f"series_bucket_agg_{_size}",
        lambda spark, sf, size=_size, names=_names: _rounded(series.bucket_aggregate(points_of(spark, sf), size, names, ["event_type"]), ["event_type", "bucket"], names),
        f"SELECT event_type, {_bucket(_s)} AS bucket, {_columns(_names)} FROM events GROUP BY 1, 2",
    )


@Q("series_dimension_filter", f"SELECT event_type, {_bucket(3600)} AS bucket, count(value) AS count FROM events WHERE event_type != 'error' AND contains(event_type, 'i') GROUP BY 1, 2 ORDER BY bucket, event_type LIMIT 50")
def series_dimension_filter(spark: SparkSession, sf: str) -> DataFrame:
    from lodestrata.operators.predicates import dimension

    points = points_of(spark, sf).withColumn("dims", F.create_map(F.lit("type"), "event_type"))
    kept = points.where(dimension("type", "not_equals", "error") & dimension("type", "contains", "i"))
    return series.bucket_aggregate(kept, "1h", ["count"], ["event_type"]).orderBy("bucket", "event_type").limit(50)


@Q("series_downsample_1m_1h", f"SELECT event_type, {_bucket(3600)} AS bucket, {_columns(['avg', 'min', 'max', 'count'])} FROM events GROUP BY 1, 2")
def series_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(series.downsample(points_of(spark, sf), "1m", "1h", ["event_type"]), ["event_type", "bucket"], ["avg", "min", "max", "count"])


_ORIGIN = 1704412800  # START
for _f in ("avg", "sum", "min", "max", "count", "p95", "p99"):
    REGISTRY.add(
        f"series_downsample_{'mean' if _f == 'avg' else _f}",
        lambda spark, sf, f=_f: _rounded(series.bucket_aggregate(temporal.between(points_of(spark, sf), when(START), when(END)), 7000, [f], ["user_id", "event_type"], _ORIGIN), ["user_id", "event_type", "bucket"], [f]),
        f"SELECT user_id, event_type, {_bucket(7000, _ORIGIN)} AS bucket, {_columns([_f])} FROM events WHERE {_PERIOD} GROUP BY 1, 2, 3",
    )


@Q(
    "series_percentile_floor",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(CASE WHEN i = floor((n - 1) * 50.0 / 100) THEN value END) AS p50, max(CASE WHEN i = floor((n - 1) * 95.0 / 100) THEN value END) AS p95, max(CASE WHEN i = floor((n - 1) * 99.0 / 100) THEN value END) AS p99 FROM r GROUP BY 1""",
)
def series_percentile_floor(spark: SparkSession, sf: str) -> DataFrame:
    return series.floor_percentiles(points_of(spark, sf), ["event_type"], {"p50": 50, "p95": 95, "p99": 99}).select("event_type", "p50", "p95", "p99")


def _rollups(spark: SparkSession, sf: str) -> DataFrame:
    return series.build_rollups(points_of(spark, sf), 3600, ["event_type"])


_ROLLUP_SQL = f"SELECT event_type, {_bucket(3600)} AS window_start, {_bucket(3600)} + 3600 AS window_end, {_columns(['sum', 'min', 'max', 'count', 'p95', 'p99'])} FROM events GROUP BY 1, 2, 3"
_RC = ["sum", "min", "max", "count", "p95", "p99"]


@Q("series_rollup_build", _ROLLUP_SQL)
def series_rollup_build(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_rollups(spark, sf), ["event_type", "window_start", "window_end"], _RC)


@Q("series_rollup_overlap", f"SELECT * FROM ({_ROLLUP_SQL}) WHERE window_end > 1704900000 AND window_start < 1705000000")
def series_rollup_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(series.overlapping_rollups(_rollups(spark, sf), 1704900000, 1705000000), ["event_type", "window_start", "window_end"], _RC)


@Q("series_rollup_invalidate", f"WITH r AS ({_ROLLUP_SQL}), l AS (SELECT DISTINCT event_type, {_bucket(3600)} AS window_start FROM events WHERE value > 190) SELECT r.event_type, r.window_start, l.window_start IS NOT NULL AS needs_invalidation FROM r LEFT JOIN l USING (event_type, window_start)")
def series_rollup_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    late = points_of(spark, sf).where("value > 190")
    return series.invalidate_rollups(_rollups(spark, sf), late, 3600, ["event_type"]).select("event_type", "window_start", "needs_invalidation")


@Q("join_interval_rollup", f"WITH r AS ({_ROLLUP_SQL}) SELECT e.event_id, r.window_start, r.count FROM events e JOIN r ON r.event_type = e.event_type AND epoch_us(e.ts) // 1000000 >= r.window_start AND epoch_us(e.ts) // 1000000 < r.window_end")
def join_interval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return series.interval_join(points_of(spark, sf), _rollups(spark, sf).select("event_type", "window_start", "count"), ["event_type"], 3600).select("event_id", "window_start", "count")


@Q(
    "series_histogram_dense",
    f"""WITH c AS (SELECT event_type, {_bucket(1800)} AS bucket, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, min(bucket) AS a, max(bucket) AS b FROM c GROUP BY 1),
    g AS (SELECT event_type, unnest(range(a, b + 1, 1800)) AS bucket FROM s) SELECT g.event_type, g.bucket, coalesce(c.n, 0) AS count FROM g LEFT JOIN c USING (event_type, bucket)""",
)
def series_histogram_dense(spark: SparkSession, sf: str) -> DataFrame:
    return series.dense_histogram(points_of(spark, sf), 1800, ["event_type"])


@Q("series_hour_of_day", "SELECT e.event_type, CAST(h.hour AS INTEGER) AS hour, count(x.event_id) AS count FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (SELECT unnest(range(24)) AS hour) h LEFT JOIN events x ON x.event_type = e.event_type AND hour(x.ts) = h.hour GROUP BY 1, 2")
def series_hour_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return series.hour_of_day(points_of(spark, sf), ["event_type"])


@Q("series_day_of_week", "SELECT CAST(d.dow AS INTEGER) AS dow, count(x.event_id) AS count FROM (SELECT unnest(range(7)) AS dow) d LEFT JOIN events x ON dayofweek(x.ts) = d.dow GROUP BY 1")
def series_day_of_week(spark: SparkSession, sf: str) -> DataFrame:
    return series.day_of_week(points_of(spark, sf))


@Q(
    "series_heatmap",
    """WITH c AS (SELECT CAST(h.hour AS INTEGER) AS hour, CAST(d.dow AS INTEGER) AS dow, count(x.event_id) AS n FROM (SELECT unnest(range(24)) AS hour) h CROSS JOIN (SELECT unnest(range(7)) AS dow) d
      LEFT JOIN events x ON hour(x.ts) = h.hour AND dayofweek(x.ts) = d.dow GROUP BY 1, 2) SELECT hour, dow, n AS count, round(n / max(n) OVER (), 6) AS intensity FROM c""",
)
def series_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return series.activity_heatmap(points_of(spark, sf)).withColumn("intensity", F.round("intensity", 6))


@Q(
    "series_value_histogram",
    """WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, CAST(greatest(10, floor(sqrt(count(value)))) AS INTEGER) AS bins FROM events),
    c AS (SELECT CAST(least(bins - 1, floor((value - lo) / ((hi - lo) / bins))) AS INTEGER) AS bin, count(*) AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1)
    SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * (hi - lo) / bins, 5) AS low, round(lo + (g.bin + 1) * (hi - lo) / bins, 5) AS high, coalesce(c.n, 0) AS count, round(coalesce(c.n, 0) * 100.0 / b.n, 5) AS percentage
    FROM b, (SELECT unnest(range((SELECT bins FROM b))) AS bin) g LEFT JOIN c ON c.bin = g.bin""",
)
def series_value_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(series.value_histogram(points_of(spark, sf)), ["bin"], ["low", "high", "count", "percentage"])


_NOW = "2024-06-01 00:00:00"
_LEVEL = "CASE WHEN age < 7 * 86400 THEN 'raw' WHEN age < 30 * 86400 THEN '1m' WHEN age < 90 * 86400 THEN '5m' WHEN age < 365 * 86400 THEN '1h' WHEN age < 730 * 86400 THEN '1d' ELSE '1w' END"


@Q("series_retention_level", f"SELECT {_LEVEL} AS level, count(*) AS points FROM (SELECT epoch_us(TIMESTAMP '{_NOW}') // 1000000 - epoch_us(ts) // 1000000 AS age FROM event_index WHERE ts IS NOT NULL) GROUP BY 1")
def series_retention_level(spark: SparkSession, sf: str) -> DataFrame:
    age = series.seconds(when(_NOW)) - series.seconds(F.col("ts"))
    return table(spark, sf, "event_index").where("ts is not null").groupBy(series.retention_level(age).alias("level")).agg(F.count("*").alias("points"))


@Q("series_downsample_by_age", f"SELECT event_type, '5m' AS level, {_bucket(300)} AS bucket, round(avg(value), 5) AS avg, count(*) AS count FROM events WHERE value IS NOT NULL GROUP BY 1, 3")
def series_downsample_by_age(spark: SparkSession, sf: str) -> DataFrame:
    thin = series.downsample_by_age(points_of(spark, sf), when("2024-03-05 00:00:00"), ["event_type"])
    return thin.select("event_type", "level", "bucket", F.round("avg", 5).alias("avg"), "count")


@Q("series_retention_counts", f"SELECT count(*) FILTER (d < 30) AS kept, count(*) FILTER (d >= 30 AND d < 100) AS downsampled, count(*) FILTER (d >= 100) AS archived FROM (SELECT (epoch_us(TIMESTAMP '{_NOW}') // 1000000 - epoch_us(ts) // 1000000) / 86400.0 AS d FROM event_index)")
def series_retention_counts(spark: SparkSession, sf: str) -> DataFrame:
    return series.retention_counts(table(spark, sf, "event_index"), when(_NOW), 30, 100)


@Q(
    "series_retention_report",
    f"""WITH d AS (SELECT ts, length(payload) AS size, (epoch_us(TIMESTAMP '{_NOW}') // 1000000 - epoch_us(ts) // 1000000) AS age FROM event_index WHERE ts IS NOT NULL AND payload IS NOT NULL),
    w AS (SELECT count(*) AS points, sum(size) AS bytes, count(*) FILTER (age / 86400.0 < 30) AS raw, coalesce(sum(size) FILTER (age / 86400.0 < 30), 0) AS raw_bytes FROM d),
    t AS (SELECT count(DISTINCT (CASE WHEN age < 90 * 86400 THEN 300 WHEN age < 365 * 86400 THEN 3600 ELSE 86400 END, epoch_us(ts) // 1000000 // CASE WHEN age < 90 * 86400 THEN 300 WHEN age < 365 * 86400 THEN 3600 ELSE 86400 END)) AS thin
          FROM d WHERE age / 86400.0 >= 30 AND age / 86400.0 < 100)
    SELECT points, raw + thin AS points_after, round((1 - (raw + thin) / points) * 100, 4) AS reduction_percent, round((bytes - raw_bytes - thin * bytes / points) / 1e6, 6) AS mb_saved FROM w, t""",
)
def series_retention_report(spark: SparkSession, sf: str) -> DataFrame:
    """What retention would save: points of 30 to 100 days are thinned by their age, older ones archived."""
    events = table(spark, sf, "event_index").where("payload is not null").withColumn("value", F.lit(1.0))
    report = series.retention_report(events, when(_NOW), F.length("payload"), 30, 100)
    return report.select("points", "points_after", F.round("reduction_percent", 4).alias("reduction_percent"), F.round("mb_saved", 6).alias("mb_saved"))


# --- anomalies ----------------------------------------------------------------------------------------------------------------------


@Q("anomaly_zscore", "WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd, count(value) AS n FROM events GROUP BY 1) SELECT event_id, round((value - m) / sd, 5) AS z FROM events JOIN s USING (event_type) WHERE n >= 3 AND sd > 0 AND abs((value - m) / sd) > 1.7")
def anomaly_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.zscore_outliers(points_of(spark, sf), ["event_type"], 1.7).select("event_id", F.round("z", 5).alias("z"))


_QUART = """q AS (SELECT event_type, max(CASE WHEN i = n // 4 THEN value END) AS q1, max(CASE WHEN i = n * 3 // 4 THEN value END) AS q3 FROM
      (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE n >= 4 GROUP BY 1)"""


@Q("anomaly_iqr", f"WITH {_QUART} SELECT event_id, q1, q3 FROM events JOIN q USING (event_type) WHERE q3 > q1 AND (value < q1 - 0.4 * (q3 - q1) OR value > q3 + 0.4 * (q3 - q1))")
def anomaly_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.iqr_outliers(points_of(spark, sf), ["event_type"], 0.4).select("event_id", "q1", "q3")


@Q(
    "series_baseline",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS sd, max(CASE WHEN i = n // 2 THEN value END) AS median, max(CASE WHEN i = floor((n - 1) * 0.95) THEN value END) AS p95,
           max(CASE WHEN i = floor((n - 1) * 0.99) THEN value END) AS p99, min(value) AS min, max(value) AS max, count(*) AS n FROM r GROUP BY 1""",
)
def series_baseline(spark: SparkSession, sf: str) -> DataFrame:
    b = anomaly.baseline(points_of(spark, sf), ["event_type"])
    return b.select("event_type", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"), "median", "p95", "p99", "min", "max", "n")


@Q(
    "anomaly_ksigma",
    """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1)
    SELECT event_id, CASE WHEN value > m THEN 'spike' ELSE 'drop' END AS kind, CASE WHEN abs(value - m) > 2 * sd THEN 'critical' WHEN abs(value - m) > 1.5 * sd THEN 'high' ELSE 'medium' END AS severity,
           round(least(1, abs(value - m) / (2 * sd)), 5) AS score FROM events JOIN s USING (event_type) WHERE sd > 0 AND abs(value - m) > sd""",
)
def anomaly_ksigma(spark: SparkSession, sf: str) -> DataFrame:
    points = points_of(spark, sf)
    return anomaly.ksigma_anomalies(points, anomaly.baseline(points, ["event_type"]), ["event_type"], 1.0).select("event_id", "kind", "severity", F.round("score", 5).alias("score"))


# Value by value along each series: the average from the first value, and the one that begins after ten, with its deviation.
_EMA = """WITH RECURSIVE r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
    two AS (SELECT event_id, event_type, value, i, 0.2::DOUBLE * value + 0.8::DOUBLE * value AS ema FROM r WHERE i = 1 AND n >= 10
            UNION ALL SELECT r.event_id, r.event_type, r.value, r.i, 0.2::DOUBLE * r.value + 0.8::DOUBLE * t.ema FROM two t JOIN r ON r.event_type = t.event_type AND r.i = t.i + 1),
    one AS (SELECT event_type, CAST(0 AS BIGINT) AS i, ema AS e, 0::DOUBLE AS v FROM two WHERE i = 10
            UNION ALL SELECT r.event_type, r.i, 0.2::DOUBLE * r.value + 0.8::DOUBLE * o.e, 0.2::DOUBLE * pow(r.value - (0.2::DOUBLE * r.value + 0.8::DOUBLE * o.e), 2) + 0.8::DOUBLE * o.v
            FROM one o JOIN r ON r.event_type = o.event_type AND r.i = o.i + 1),
    sd AS (SELECT event_type, sqrt(arg_max(v, i)) AS sd FROM one GROUP BY 1)
    SELECT event_id, event_type, round(ema, 5) AS ema, round(value - ema, 5) AS deviation FROM two JOIN sd USING (event_type) WHERE abs(value - ema) > {sigma} * sd"""


@Q("anomaly_ema", _EMA.format(sigma=1.5))
def anomaly_ema(spark: SparkSession, sf: str) -> DataFrame:
    found = anomaly.ema_anomalies(points_of(spark, sf), ["event_type"], ["ts", "event_id"], sigma=1.5)
    return found.select("event_id", "event_type", F.round("ema", 5).alias("ema"), F.round("deviation", 5).alias("deviation"))


_TREND = """t AS (SELECT event_type, regr_slope(value, i) AS slope, regr_r2(value, i) AS r2, avg(value) AS m, stddev_pop(value) AS sd, arg_max(value, i) AS last_value FROM
      (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events WHERE value IS NOT NULL) GROUP BY 1)"""


@Q("series_trend", f"WITH {_TREND} SELECT event_type, round(slope, 7) AS slope, round(sqrt(r2), 6) AS strength, CASE WHEN sqrt(r2) < 0.3 THEN CASE WHEN sd / abs(m) > 0.5 THEN 'variable' ELSE 'stable' END WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend_type FROM t")
def series_trend(spark: SparkSession, sf: str) -> DataFrame:
    t = anomaly.trend(points_of(spark, sf), ["event_type"], ["ts", "event_id"])
    return t.select("event_type", F.round("slope", 7).alias("slope"), F.round("strength", 6).alias("strength"), "trend_type")


@Q("series_forecast", f"WITH {_TREND} SELECT event_type, CAST(s.step AS INTEGER) AS step, round(last_value + s.step * slope, 5) AS predicted FROM t, (SELECT unnest(range(1, 6)) AS step) s")
def series_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.forecast(points_of(spark, sf), ["event_type"], ["ts", "event_id"], 5).withColumn("predicted", F.round("predicted", 5))


@Q(
    "series_seasonality",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL), l AS (SELECT unnest([60, 360, 720, 1440]) AS lag)
    SELECT a.event_type, CAST(l.lag AS INTEGER) AS lag, round(avg(CASE WHEN greatest(a.value, b.value) > 0 THEN 1 - abs(a.value - b.value) / greatest(a.value, b.value) ELSE 0 END), 6) AS score, count(*) AS pairs
    FROM r a, l JOIN r b ON b.event_type = a.event_type AND b.i = a.i + l.lag GROUP BY 1, 2""",
)
def series_seasonality(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.seasonality(points_of(spark, sf), ["event_type"], ["ts", "event_id"], [60, 360, 720, 1440]).withColumn("score", F.round("score", 6))


_SAMPLES = """s AS (SELECT event_type, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS throughput, avg(value) AS avg_latency, quantile_cont(value, 0.99) AS p99, stddev_pop(value) AS error_rate FROM events GROUP BY 1, 2),
    b AS (SELECT event_type, avg(throughput) AS base_throughput, avg(avg_latency) AS base_avg_latency, avg(p99) AS base_p99, avg(error_rate) AS base_error_rate FROM s GROUP BY 1)"""


def _samples(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Daily samples per type, and their means as baseline."""
    day = F.date_trunc("day", "ts").alias("ts")
    v = F.col("value")
    s = points_of(spark, sf).groupBy("event_type", day).agg(F.count("*").cast("double").alias("throughput"), F.avg(v).alias("avg_latency"), F.percentile(v, 0.99).alias("p99"), F.stddev_pop(v).alias("error_rate"))
    return s, s.groupBy("event_type").agg(*[F.avg(m).alias(f"base_{m}") for m in anomaly.REGRESSIONS])


@Q(
    "perf_regressions",
    f"""WITH {_SAMPLES}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM s) WHERE r = 1),
    x AS (SELECT event_type, 'throughput' AS metric, throughput / base_throughput AS ratio FROM l JOIN b USING (event_type) WHERE throughput / base_throughput < 0.95
      UNION ALL SELECT event_type, 'avg_latency', avg_latency / base_avg_latency FROM l JOIN b USING (event_type) WHERE avg_latency / base_avg_latency > 1.1
      UNION ALL SELECT event_type, 'p99', p99 / base_p99 FROM l JOIN b USING (event_type) WHERE p99 / base_p99 > 1.15
      UNION ALL SELECT event_type, 'error_rate', error_rate / base_error_rate FROM l JOIN b USING (event_type) WHERE error_rate / base_error_rate > 1.5) SELECT event_type, metric, round(ratio, 5) AS ratio FROM x""",
)
def perf_regressions(spark: SparkSession, sf: str) -> DataFrame:
    samples, base = _samples(spark, sf)
    return anomaly.regressions(samples, base, ["event_type"]).withColumn("ratio", F.round("ratio", 5))


@Q("perf_trend", f"WITH {_SAMPLES}, k AS (SELECT event_type, avg(avg_latency) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM s) WHERE r <= 5 GROUP BY 1) SELECT event_type, round(recent, 5) AS recent, round((recent - base_avg_latency) / base_avg_latency, 6) AS change FROM k JOIN b USING (event_type)")
def perf_trend(spark: SparkSession, sf: str) -> DataFrame:
    samples, base = _samples(spark, sf)
    t = anomaly.recent_trend(samples, base.select("event_type", F.col("base_avg_latency").alias("base")), ["event_type"], "avg_latency", 5)
    return t.select("event_type", F.round("recent", 5).alias("recent"), F.round("change", 6).alias("change"))


@Q("perf_restorations", f"WITH {_SAMPLES}, k AS (SELECT event_type, avg(avg_latency) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS r FROM s) WHERE r <= 5 GROUP BY 1), c AS (SELECT *, (recent - base_avg_latency) / base_avg_latency AS change FROM k JOIN b USING (event_type)) SELECT event_type, round(recent, 5) AS current, round(base_avg_latency, 5) AS target, round(-change * 100, 5) AS loss_percent, CASE WHEN change < -0.2 THEN 'high' ELSE 'medium' END AS priority FROM c WHERE change < -0.0001")
def perf_restorations(spark: SparkSession, sf: str) -> DataFrame:
    samples, base = _samples(spark, sf)
    lost = anomaly.restorations(samples, base.select("event_type", F.col("base_avg_latency").alias("base")), ["event_type"], "avg_latency", 5, 0.0001)
    return lost.select("event_type", *[F.round(c, 5).alias(c) for c in ("current", "target", "loss_percent")], "priority")


# --- questions ------------------------------------------------------------------------------------------------------------------------


@Q("ask_average_per_type", "SELECT event_type AS per, round(avg(value), 6) AS answer FROM events WHERE value > 10 AND event_type IS DISTINCT FROM 'signup' AND ts >= TIMESTAMP '2024-01-05' GROUP BY 1")
def ask_average_per_type(spark: SparkSession, sf: str) -> DataFrame:
    asked = nl.answer("average of value in events where value over 10 and event_type is not signup since 2024-01-05 per event_type", {"events": points_of(spark, sf)})
    return asked.withColumn("answer", F.round("answer", 6))


@Q("ask_users_per_day", "SELECT date_trunc('day', ts) AS per, count(DISTINCT user_id) AS answer FROM events WHERE event_type = 'click' GROUP BY 1")
def ask_users_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return nl.answer("distinct of user_id in events where event_type is click per day", {"events": points_of(spark, sf)}).withColumn("per", F.col("per").cast("timestamp_ntz"))


@Q("ask_busiest_users", "SELECT user_id AS per, count(*) AS answer FROM events GROUP BY 1 ORDER BY answer DESC, per LIMIT 5")
def ask_busiest_users(spark: SparkSession, sf: str) -> DataFrame:
    return nl.answer("Count in events per user_id top 5?", {"events": points_of(spark, sf)})
