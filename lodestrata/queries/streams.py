"""Streams run over what is available, and exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import events as ev
from lodestrata.plans.lineage import ensure_checkpoint_dir
from lodestrata.queries.kv import log_of
from lodestrata.queries.registry import Registry
from lodestrata.sources import export
from lodestrata.sources.tables import table
from lodestrata.streaming import run, stateful, windows

REGISTRY = Registry()
Q = REGISTRY.query

_STATS = "count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's times as TIMESTAMP (UTC), which watermarks need."""
    return run.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    """Times without zone, sums rounded."""
    times = [c for c, t in df.dtypes if t == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times}).withColumn("total", F.round("total", 4))


@Q("stream_tumbling", f"SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, {_STATS} FROM events GROUP BY 1, 2, 3")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(run.latest_per_key(windows.tumbling(_events(spark, sf), "1 hour", ["event_type"]), ["event_type", "window_start"]))


@Q("stream_sliding", f"SELECT event_type, s AS window_start, s + INTERVAL 2 HOUR AS window_end, {_STATS} FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) - d * INTERVAL 1 HOUR AS s FROM events, (SELECT unnest([0, 1]) AS d)) GROUP BY 1, 2, 3")
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(run.latest_per_key(windows.sliding(_events(spark, sf), "2 hours", "1 hour", ["event_type"]), ["event_type", "window_start"]))


@Q(
    "stream_session",
    f"""WITH m AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 4 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
    SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 4 HOUR AS window_end, {_STATS} FROM g GROUP BY user_id, s""",
)
def stream_session(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(run.latest_per_key(windows.sessions(_events(spark, sf), "4 hours", ["user_id"]), [], "complete"))


@Q("stream_last_value", "SELECT user_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_last_value(spark: SparkSession, sf: str) -> DataFrame:
    last = run.latest_per_key(windows.last_values(_events(spark, sf), ["user_id"]), ["user_id"])
    return last.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@Q("stream_late_data", "SELECT CAST(ts AS DATE) AS day, count(*) AS events FROM event_index WHERE ts IS NOT NULL AND received_at - ts > INTERVAL 1 HOUR GROUP BY 1")
def stream_late_data(spark: SparkSession, sf: str) -> DataFrame:
    """Events that arrived more than an hour after they happened, per day: those that a watermark of an hour may drop."""
    late = run.stream_table(spark, sf, "event_index").where("ts is not null and received_at - ts > interval 1 hour")
    return run.latest_per_key(late.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events")), ["day"])


@Q(
    "stream_rate_limit",
    """WITH RECURSIVE r AS (SELECT event_type AS key, event_id, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT key, event_id, i, sec AS last, TRUE AS allowed, 1::DOUBLE AS tokens FROM r WHERE i = 1
          UNION ALL SELECT r.key, r.event_id, r.i, r.sec, full_ >= 1, full_ - CASE WHEN full_ >= 1 THEN 1 ELSE 0 END
          FROM (SELECT x.*, least(2::DOUBLE, b.tokens + (x.sec - b.last) * (1::DOUBLE / 600::DOUBLE)) AS full_ FROM b JOIN r x ON x.key = b.key AND x.i = b.i + 1) r)
    SELECT key, event_id, allowed FROM b""",
)
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return run.appended(stateful.rate_limited(_events(spark, sf), "event_type", 1 / 600, 2.0)).select("key", "event_id", "allowed")


_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age FROM kv_commits WHERE key IS NOT NULL AND txn_id IS NOT NULL) WHERE age = 1 AND lower(trim(op)) = 'put'"


@Q("stream_commit_apply", f"SELECT hex(key) AS key_hex, txn_id, seq FROM ({_LATEST})")
def stream_commit_apply(spark: SparkSession, sf: str) -> DataFrame:
    commits = run.stream_table(spark, sf, "kv_commits").select("txn_id", "seq", "op", "key", "value")
    state = stateful.apply_commits(commits, f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}-log")
    return state.select(F.hex("key").alias("key_hex"), "txn_id", "seq")


# --- exports ---------------------------------------------------------------------------------------------------------------------------


@Q("export_stats", "SELECT count(*) AS entries, CAST(sum(octet_length(key)) AS BIGINT) AS key_bytes, CAST(sum(octet_length(value)) AS BIGINT) AS value_bytes FROM (SELECT DISTINCT ON (txn_id, seq) * FROM kv_commits ORDER BY txn_id, seq, feed_offset)")
def export_stats(spark: SparkSession, sf: str) -> DataFrame:
    return export.table_stats(log_of(spark, sf)).select("entries", "key_bytes", "value_bytes")


@Q("export_violations", "SELECT * FROM (SELECT 'null key' AS rule, count(*) AS rows FROM kv_commits WHERE key IS NULL UNION ALL SELECT 'unknown op', count(*) FROM kv_commits WHERE lower(trim(op)) NOT IN ('put', 'del', 'delete') OR op IS NULL UNION ALL SELECT 'no transaction', count(*) FROM kv_commits WHERE txn_id IS NULL OR seq IS NULL UNION ALL SELECT 'deleted with a value', count(*) FROM kv_commits WHERE lower(trim(op)) IN ('del', 'delete') AND value IS NOT NULL) WHERE rows > 0")
def export_violations(spark: SparkSession, sf: str) -> DataFrame:
    return export.violations(table(spark, sf, "kv_commits"))


@Q("export_openmetrics", "SELECT 'latency_bucket{le=\"50.0\"} ' || count(*) FILTER (value <= 50) AS line FROM events UNION ALL SELECT 'latency_bucket{le=\"100.0\"} ' || count(*) FILTER (value <= 100) FROM events UNION ALL SELECT 'latency_bucket{le=\"+Inf\"} ' || count(value) FROM events UNION ALL SELECT 'latency_count ' || count(value) FROM events UNION ALL SELECT '# TYPE latency histogram'")
def export_openmetrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = export.openmetrics("histogram", "latency", ev.cumulative_histogram(table(spark, sf, "events"), "value", [50, 100]))
    return lines.where("line not like 'latency_sum%'").select("line")


@Q("export_traces", "SELECT session_id AS trace_id, count(*) AS spans FROM (SELECT DISTINCT ON (event_id) * FROM event_index WHERE session_id IS NOT NULL ORDER BY event_id) GROUP BY 1")
def export_traces(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "event_index").where("session_id is not null").groupBy("event_id").agg(F.min(F.struct("session_id", "ts")).alias("x"))
    spans = once.select(F.col("event_id").alias("span_id"), F.col("x.session_id").alias("trace_id"), F.unix_micros(F.col("x.ts").cast("timestamp")).alias("start_ns"))
    return export.traces(spans).select("trace_id", F.json_array_length(F.get_json_object("json", "$.spans")).cast("long").alias("spans"))


_DAYS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS x, CAST(count(*) AS DOUBLE) AS y FROM events WHERE ts IS NOT NULL GROUP BY 1"


@Q("chart_points", f"SELECT l AS library, x, y FROM ({_DAYS}), (SELECT unnest(['chartjs', 'd3', 'echarts', 'plotly', 'vega']) AS l)")
def chart_points(spark: SparkSession, sf: str) -> DataFrame:
    """The points of the charts of events per day, read from each library's JSON."""
    days = table(spark, sf, "events").where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events"))
    read = {
        "chartjs": lambda c: zip(c["data"]["labels"], c["data"]["datasets"][0]["data"]),
        "d3": lambda c: ((p["x"], p["y"]) for p in c["values"]),
        "echarts": lambda c: zip(c["xAxis"]["data"], c["series"][0]["data"]),
        "plotly": lambda c: zip(c["data"][0]["x"], c["data"][0]["y"]),
        "vega": lambda c: ((p["x"], p["y"]) for p in c["data"]["values"]),
    }
    rows = [(library, x, y) for library, points in read.items() for x, y in points(json.loads(export.chart(days, "day", "events", library)))]
    return spark.createDataFrame(rows, "library string, x string, y double")


@Q("dashboard_cells", "SELECT 'types' AS panel, coalesce(event_type, '') AS name, CAST(count(*) AS VARCHAR) AS cell FROM events GROUP BY 2 UNION ALL SELECT 'regions', r_name, CAST(count(n_nationkey) AS VARCHAR) FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 2")
def dashboard_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells of a page of two tables, read from its JSON."""
    types = table(spark, sf, "events").groupBy("event_type").count()
    regions = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.count("n_nationkey").alias("nations"))
    page = json.loads(export.dashboard("tables", [("types", types), ("regions", regions)], "json"))
    return spark.createDataFrame([(p["name"], row[0] or "", row[1]) for p in page["panels"] for row in p["rows"]], "panel string, name string, cell string")
