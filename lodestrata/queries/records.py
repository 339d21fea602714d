"""Document versions, events, usage and texts.

An order is a version of the document ``cust/<customer modulo 40>/<customer>``; its lines are the hunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.functions import textscan
from lodestrata.operators import doc_history as dh, events as ev, temporal, usage
from lodestrata.queries.registry import Registry
from lodestrata.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.query

_SEV = {"1-URGENT": "critical", "2-HIGH": "major", "3-MEDIUM": "moderate", "4-NOT SPECIFIED": "minor", "5-LOW": "trivial"}
_INTENT = {"O": "bugfix", "P": "security", "F": "feature"}


def versions_of(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("start_line"), F.floor(F.col("l_tax") * 100).cast("int").alias("lines_removed"), F.col("l_quantity").cast("int").alias("lines_added")))).alias("diffs")
    )
    o = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    return o.select(
        F.concat(F.lit("cust/"), (F.col("o_custkey") % 40).cast("string"), F.lit("/"), F.col("o_custkey").cast("string")).alias("path"), F.col("o_orderkey").cast("string").alias("version_id"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 5 == 0, "side").otherwise("main").alias("branch"), F.concat(F.lit("author"), (F.col("o_orderkey") % 7).cast("string")).alias("author"), F.col("o_orderdate").alias("ts"),
        F.coalesce(dh.weight(F.col("o_orderstatus"), _INTENT), F.lit("other")).alias("intent"), F.coalesce(dh.weight(F.col("o_orderpriority"), _SEV), F.lit("minor")).alias("severity"), "diffs", F.array(F.concat(F.lit("ISSUE-"), (F.col("o_orderkey") % 11).cast("string"))).alias("linked_issues"),
    )


def _case(column: str, names: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


_LINES = "li AS (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS start_line, CAST(floor(l_tax * 100) AS INTEGER) AS lines_removed, CAST(trunc(l_quantity) AS INTEGER) AS lines_added FROM lineitem)"
_V = f"""{_LINES}, t AS (SELECT l_orderkey, sum(lines_added) AS added, sum(lines_removed) AS removed FROM li GROUP BY 1),
    v AS (SELECT 'cust/' || (o_custkey % 40) || '/' || o_custkey AS path, CAST(o_orderkey AS VARCHAR) AS version_id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'side' ELSE 'main' END AS branch, 'author' || (o_orderkey % 7) AS author,
      o_orderdate AS ts, {_case('o_orderstatus', _INTENT, 'other')} AS intent, {_case('o_orderpriority', _SEV, 'minor')} AS severity, 'ISSUE-' || (o_orderkey % 11) AS issue, CAST(coalesce(t.added, 0) AS BIGINT) AS added, CAST(coalesce(t.removed, 0) AS BIGINT) AS removed FROM orders LEFT JOIN t ON l_orderkey = o_orderkey)"""


def _weights(column: str, weights: dict[str, float]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " END"


@Q("doc_changelog", f"WITH {_V} SELECT path, version_id, added, removed FROM v WHERE author = 'author3' AND severity = 'critical' AND branch = 'main' AND issue = 'ISSUE-4' AND ts >= TIMESTAMP '1993-01-01'")
def doc_changelog(spark: SparkSession, sf: str) -> DataFrame:
    where = dh.matching(author="author3", severity="critical", branch="main", issue="ISSUE-4", start=F.lit("1993-01-01 00:00:00").cast("timestamp_ntz"))
    return dh.changelog(versions_of(spark, sf), where).select("path", "version_id", "added", "removed")


@Q("doc_stats", f"WITH {_V} SELECT count(*) AS versions, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(added) - sum(removed) AS BIGINT) AS net, count(DISTINCT author) AS authors, round(CAST(sum({_weights('severity', dh.IMPACT)}) AS DOUBLE), 4) AS impact, round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS per_day FROM v")
def doc_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dh.statistics(versions_of(spark, sf)).withColumn("impact", F.round("impact", 4)).withColumn("per_day", F.round("per_day", 6))


@Q("doc_by_author", f"WITH {_V} SELECT path, version_id FROM v WHERE author = 'author2'")
def doc_by_author(spark: SparkSession, sf: str) -> DataFrame:
    return versions_of(spark, sf).where(dh.matching(author="author2")).select("path", "version_id")


@Q("doc_by_intent", f"WITH {_V} SELECT intent, count(*) AS versions FROM v GROUP BY 1")
def doc_by_intent(spark: SparkSession, sf: str) -> DataFrame:
    return versions_of(spark, sf).groupBy("intent").agg(F.count("*").alias("versions"))


@Q("doc_by_severity", f"WITH {_V} SELECT version_id FROM v WHERE severity = 'critical'")
def doc_by_severity(spark: SparkSession, sf: str) -> DataFrame:
    return versions_of(spark, sf).where(dh.matching(severity="critical")).select("version_id")


@Q("doc_by_time", f"WITH {_V} SELECT version_id FROM v WHERE ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def doc_by_time(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return versions_of(spark, sf).where(dh.matching(start=t("1996-01-01 00:00:00"), end=t("1996-06-30 00:00:00"))).select("version_id")


@Q("doc_latest", f"WITH {_V} SELECT path, branch, arg_max(version_id, seq) AS version_id FROM v GROUP BY 1, 2")
def doc_latest(spark: SparkSession, sf: str) -> DataFrame:
    return dh.latest(versions_of(spark, sf))


def _busiest(versions: DataFrame) -> tuple[str, str, str]:
    """The path with most versions, and its second and fourth version."""
    path = versions.groupBy("path").count().orderBy(F.desc("count"), "path").first()["path"]
    ids = [r[0] for r in versions.where(F.col("path") == path).orderBy("seq").limit(4).select("version_id").collect()]
    return path, ids[1], ids[3]


_BUSY = "busy AS (SELECT path FROM v GROUP BY 1 ORDER BY count(*) DESC, path LIMIT 1), own AS (SELECT *, row_number() OVER (ORDER BY seq) AS r FROM v WHERE path = (SELECT path FROM busy))"


@Q("doc_between", f"WITH {_V}, {_BUSY} SELECT version_id FROM own WHERE r BETWEEN 2 AND 4")
def doc_between(spark: SparkSession, sf: str) -> DataFrame:
    v = versions_of(spark, sf)
    return dh.versions_between(v, *_busiest(v)).select("version_id")


@Q("doc_diff", f"WITH {_V}, {_BUSY} SELECT o.version_id, row_number() OVER (PARTITION BY o.version_id ORDER BY start_line, lines_removed, lines_added) - 1 AS hunk, start_line, lines_added FROM own o JOIN li ON l_orderkey = o.seq WHERE r BETWEEN 2 AND 4")
def doc_diff(spark: SparkSession, sf: str) -> DataFrame:
    v = versions_of(spark, sf)
    return dh.hunks(dh.versions_between(v, *_busiest(v))).select("version_id", F.col("hunk").cast("long").alias("hunk"), "start_line", "lines_added")


@Q("doc_blame", f"WITH {_V} SELECT path, arg_max(version_id, seq) AS version_id, arg_max(author, seq) AS author FROM v JOIN li ON l_orderkey = seq WHERE start_line <= 20 AND 20 < start_line + lines_added GROUP BY 1")
def doc_blame(spark: SparkSession, sf: str) -> DataFrame:
    return dh.blame(versions_of(spark, sf), 20)


_HOT = f"""h AS (SELECT path, count(*) AS changes, count(*) / greatest(1, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)) AS frequency, avg({_weights('severity', {s: i + 1.0 for i, s in enumerate(dh.SEVERITIES)})}) / 5 AS avg_severity,
    least(1, sum(added + removed) / count(*) / 1000) AS churn FROM v GROUP BY 1)"""


@Q("doc_hot_files", f"WITH {_V}, {_HOT} SELECT path, changes, round(CAST(least(1, frequency / 10) * 0.4 + avg_severity * 0.4 + least(1, churn * 10) * 0.2 AS DOUBLE), 6) AS risk FROM h ORDER BY least(1, frequency / 10) * 0.4 + avg_severity * 0.4 + least(1, churn * 10) * 0.2 DESC, path LIMIT 20")
def doc_hot_files(spark: SparkSession, sf: str) -> DataFrame:
    return dh.hot_files(versions_of(spark, sf)).orderBy(F.desc("risk"), "path").limit(20).select("path", "changes", F.round("risk", 6).alias("risk"))


_CHURN = "c AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS directory, count(*) AS changes, sum(added + removed) / count(*) / 1000 AS churn FROM v GROUP BY 1)"


@Q("doc_churn", f"WITH {_V}, {_CHURN} SELECT path, directory, changes, round(churn, 6) AS churn, CASE WHEN churn > 0.1 THEN 'high' WHEN churn > 0.01 THEN 'medium' ELSE 'low' END AS level FROM c")
def doc_churn(spark: SparkSession, sf: str) -> DataFrame:
    return dh.churn(versions_of(spark, sf)).select("path", "directory", "changes", F.round("churn", 6).alias("churn"), "level")


# Means are rounded to 12 decimals first, as the order of a sum decides its last bits, and these would decide halves.
@Q("doc_directory_churn", f"WITH {_V}, {_CHURN} SELECT directory, CAST(sum(changes) AS BIGINT) AS changes, round(round(avg(churn), 12), 6) AS churn, round(round(least(1, avg(churn) * 10), 12), 6) AS risk FROM c GROUP BY 1")
def doc_directory_churn(spark: SparkSession, sf: str) -> DataFrame:
    d = dh.directory_churn(dh.churn(versions_of(spark, sf)))
    twice = lambda c: F.round(F.round(c, 12), 6).alias(c)
    return d.select("directory", "changes", twice("churn"), twice("risk"))


_RISK = f"""r AS (SELECT a.path, a.version_id, a.severity, a.intent, a.added + a.removed AS lines, count(*) OVER (PARTITION BY a.path) AS n, (SELECT count(*) FROM v b WHERE b.path = a.path AND b.ts >= a.ts - INTERVAL 1 HOUR AND b.ts != a.ts) AS near FROM v a),
    scored AS (SELECT path, version_id, CAST({_weights('severity', dh.SEVERITY_RISK)} * 0.3 + CASE WHEN least(1, n / 100.0) > 0.1 THEN least(1, n / 100.0) * 0.2 ELSE 0 END + CASE WHEN least(1, lines / 1000.0) > 0.3 THEN least(1, lines / 1000.0) * 0.25 ELSE 0 END
      + CASE WHEN {_weights('intent', dh.INTENT_RISK)} > 0.5 THEN {_weights('intent', dh.INTENT_RISK)} * 0.15 ELSE 0 END + CASE WHEN near > 3 THEN least(1, near / 10.0) * 0.1 ELSE 0 END AS DOUBLE) AS score FROM r)"""


@Q(
    "doc_risk",
    f"WITH {_V}, {_RISK} SELECT path, version_id, round(score, 6) AS score FROM scored",
)
def doc_risk(spark: SparkSession, sf: str) -> DataFrame:
    return dh.change_risk(versions_of(spark, sf)).select("path", "version_id", F.round("score", 6).alias("score"))


@Q(
    "doc_risk_levels",
    f"""WITH {_V}, {_RISK}, l AS (SELECT CASE WHEN round(score, 12) < 0.3 THEN 'low' WHEN round(score, 12) < 0.6 THEN 'medium' WHEN round(score, 12) < 0.8 THEN 'high' ELSE 'critical' END AS level FROM scored)
    SELECT level, CASE level WHEN 'low' THEN 'green' WHEN 'medium' THEN 'yellow' WHEN 'high' THEN 'orange' ELSE 'red' END AS color, count(*) AS versions FROM l GROUP BY 1""",
)
def doc_risk_levels(spark: SparkSession, sf: str) -> DataFrame:
    level = dh.risk_level(F.round("score", 12)).alias("level")
    return dh.change_risk(versions_of(spark, sf)).select(level).groupBy("level", dh.risk_color(F.col("level")).alias("color")).agg(F.count("*").alias("versions"))


@Q("doc_impact", f"WITH {_V} SELECT path, 'high' AS risk, round(least(1, count(*) / 50), 6) AS confidence, CASE WHEN count(*) FILTER (severity = 'critical' AND intent = 'bugfix') > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END AS regression_probability FROM v GROUP BY 1")
def doc_impact(spark: SparkSession, sf: str) -> DataFrame:
    return dh.predicted_impact(versions_of(spark, sf), "critical", "bugfix").withColumn("confidence", F.round("confidence", 6))


# --- events ----------------------------------------------------------------------------------------------------------------------------


@Q("event_filter", "SELECT event_id, event_type, file_offset FROM event_index WHERE event_type IN ('review_note.release_lock', 'vcs_commit.merge_cartridge') AND visibility >= 1 AND ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-05-01'")
def event_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    where = ev.event_filter(["review_note.release_lock", "vcs_commit.merge_cartridge"], start=t("2024-01-20 00:00:00"), end=t("2024-05-01 00:00:00"), min_visibility=ev.TEAM)
    return ev.query(table(spark, sf, "event_index"), where).select("event_id", "event_type", "file_offset")


@Q("event_as_of", "SELECT event_type, count(*) AS events FROM event_index WHERE ts <= TIMESTAMP '2024-02-01' GROUP BY 1")
def event_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "event_index").where(ev.event_filter(end=F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("events"))


_SID = "SELECT session_id FROM event_index WHERE session_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, session_id LIMIT 1"


@Q("event_session", f"SELECT event_id, file_offset FROM event_index WHERE session_id = ({_SID})")
def event_session(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "event_index")
    sid = events.where("session_id is not null").groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()["session_id"]
    return ev.query(events, ev.event_filter(session=sid)).select("event_id", "file_offset")


@Q("event_actor", "SELECT event_id, file_offset FROM event_index WHERE actor_id = (SELECT max(actor_id) FROM event_index)")
def event_actor(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "event_index")
    return ev.query(events, ev.event_filter(actor=events.agg(F.max("actor_id")).first()[0])).select("event_id", "file_offset")


@Q("event_retention", "SELECT count(*) AS kept FROM event_index WHERE ts >= TIMESTAMP '2024-03-01'")
def event_retention(spark: SparkSession, sf: str) -> DataFrame:
    return ev.compacted(table(spark, sf, "event_index"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).agg(F.count("*").alias("kept"))


@Q("event_sessions", "SELECT session_id, count(DISTINCT event_id) AS events, count(DISTINCT actor_id) AS actors, min(ts) AS first_ts, max(ts) AS last_ts, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS seconds FROM event_index WHERE session_id IS NOT NULL GROUP BY 1")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.session_spans(table(spark, sf, "event_index"))


@Q("review_counts", "SELECT split_part(lower(trim(event_type)), '.', 1) AS label, count(*) AS value FROM event_index WHERE starts_with(lower(trim(event_type)), 'review') GROUP BY 1")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.lower(F.trim("event_type"))
    reviews = table(spark, sf, "event_index").where(F.startswith(kind, F.lit("review"))).withColumn("family", F.split_part(kind, F.lit("."), F.lit(1)))
    return ev.counters(reviews, "family")


@Q("session_metrics", "SELECT session_id, count(*) AS samples, round(avg(CAST(json_extract_string(payload, '$.ms') AS DOUBLE)), 5) AS avg_ms FROM event_index WHERE session_id IS NOT NULL AND starts_with(lower(trim(event_type)), 'perf_sample') GROUP BY 1")
def session_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "event_index").where(F.startswith(F.lower(F.trim("event_type")), F.lit("perf_sample")) & F.col("session_id").isNotNull())
    return rows.groupBy("session_id").agg(F.count("*").alias("samples"), F.round(F.avg(F.get_json_object("payload", "$.ms").cast("double")), 5).alias("avg_ms"))


@Q("metric_counters", "SELECT event_type AS label, round(sum(value), 4) AS value FROM events GROUP BY 1")
def metric_counters(spark: SparkSession, sf: str) -> DataFrame:
    return ev.counters(table(spark, sf, "events"), "event_type", F.col("value")).withColumn("value", F.round("value", 4))


@Q("metric_gauges", "SELECT user_id AS label, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def metric_gauges(spark: SparkSession, sf: str) -> DataFrame:
    return ev.gauges(table(spark, sf, "events"), "user_id", "value")


_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0, 150.0)


@Q("openmetrics_histogram", f"WITH b AS (SELECT unnest([{', '.join(map(str, _BOUNDS))}, NULL]) AS b), g AS (SELECT event_type, count(value) AS total, round(sum(value), 4) AS sum FROM events GROUP BY 1) SELECT g.event_type, coalesce(CAST(b.b AS VARCHAR), '+Inf') AS le, (SELECT count(*) FROM events e WHERE e.event_type = g.event_type AND (b.b IS NULL OR e.value <= b.b)) AS count, g.sum, g.total FROM g, b")
def openmetrics_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cumulative_histogram(table(spark, sf, "events"), "value", _BOUNDS, ["event_type"]).withColumn("sum", F.round("sum", 4))


@Q("rate_limited_windows", "SELECT event_id, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 3 AS allowed FROM events")
def rate_limited_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ev.fixed_window_limit(table(spark, sf, "events"), ["event_type"], 3, 3600).select("event_id", "allowed")


# --- usage -----------------------------------------------------------------------------------------------------------------------------

_NOW = "2024-01-31 00:00:00"


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp_ntz")


_AGE = f"(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(max(ts))) / 3.6e9"


@Q("hot_entities", f"SELECT user_id AS entity, count(*) AS accesses, round(least(1, count(*) / 100) * 0.7 + greatest(0, 1 - {_AGE} / 24) * 0.3, 6) AS heat FROM events GROUP BY 1 HAVING count(*) >= 60")
def hot_entities(spark: SparkSession, sf: str) -> DataFrame:
    return usage.hot_entities(table(spark, sf, "events"), "user_id", 60, _now()).withColumn("heat", F.round("heat", 6))


@Q("cold_entities", f"SELECT user_id AS entity, round({_AGE}, 5) AS age_hours, round(least(1, {_AGE} / 720), 6) AS cold FROM events GROUP BY 1 HAVING {_AGE} >= 30")
def cold_entities(spark: SparkSession, sf: str) -> DataFrame:
    c = usage.cold_entities(table(spark, sf, "events"), "user_id", 30, _now())
    return c.select("entity", F.round("age_hours", 5).alias("age_hours"), F.round("cold", 6).alias("cold"))


_PROFILE = "SELECT event_type AS pattern, count(value) AS n, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max, round(avg(value), 5) AS avg, CAST(sum(user_id) AS BIGINT) AS scanned, CAST(sum(event_id % 7) AS BIGINT) AS returned, round(sum(user_id) / sum(event_id % 7), 5) AS scan_ratio FROM events GROUP BY 1"


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return usage.query_profile(table(spark, sf, "events").withColumn("returned", F.col("event_id") % 7), "event_type", "value", "user_id", "returned")


@Q("query_profile", _PROFILE)
def query_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).withColumn("total", F.round("total", 4)).withColumn("avg", F.round("avg", 5)).withColumn("scan_ratio", F.round("scan_ratio", 5))


@Q("slow_queries", "SELECT event_type AS pattern, round(least(10, avg(value) / 50 * 5), 5) AS severity FROM events GROUP BY 1 HAVING avg(value) >= 50")
def slow_queries(spark: SparkSession, sf: str) -> DataFrame:
    return usage.slow_queries(_profile(spark, sf), 50.0).select("pattern", F.round("severity", 5).alias("severity"))


@Q("scan_ratio", "SELECT round(sum(user_id) / sum(event_id % 7), 5) AS scan_ratio FROM events")
def scan_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf).agg(F.round(F.try_divide(F.sum("scanned"), F.sum("returned")), 5).alias("scan_ratio"))


@Q("latency_regressions", "WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events), w AS (SELECT user_id AS pattern, max(value) FILTER (k = 1) AS current, max(value) FILTER (k > 1) AS worst, count(*) - 1 AS before FROM r GROUP BY 1) SELECT pattern, current, worst, round(current / worst, 6) AS ratio FROM w WHERE before >= 5 AND current > worst * 0.5")
def latency_regressions(spark: SparkSession, sf: str) -> DataFrame:
    return usage.latency_regressions(table(spark, sf, "events"), "user_id", "value", ["ts", "event_id"], 0.5, 5).withColumn("ratio", F.round("ratio", 6))


@Q("predict_patterns", "WITH p AS (SELECT user_id AS pattern, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1) SELECT pattern, n, round(n / (SELECT max(n) FROM p), 6) AS confidence FROM p WHERE n / (SELECT max(n) FROM p) >= 0.5")
def predict_patterns(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda s: F.lit(s).cast("timestamp_ntz")
    return usage.predictions(table(spark, sf, "events"), "user_id", t("2024-01-05 00:00:00"), t("2024-01-20 00:00:00"), 0.5).withColumn("confidence", F.round("confidence", 6))


@Q("predict_hour", "WITH p AS (SELECT CAST(hour(ts) AS INTEGER) AS hour, user_id AS pattern, count(*) AS n FROM events GROUP BY 1, 2) SELECT hour, pattern, n, round(share, 6) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY hour) AS share, row_number() OVER (PARTITION BY hour ORDER BY n DESC, pattern) AS r FROM p) WHERE r <= 3")
def predict_hour(spark: SparkSession, sf: str) -> DataFrame:
    return usage.predictions_by_hour(table(spark, sf, "events"), "user_id", 3).withColumn("share", F.round("share", 6))


@Q("running_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 9) AS running FROM events")
def running_average(spark: SparkSession, sf: str) -> DataFrame:
    return usage.running_average(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("running", 9).alias("running"))


@Q("ab_winner", "WITH a AS (SELECT event_id % 2 AS arm, count(value) AS n, avg(value) AS mean FROM events GROUP BY 1) SELECT arm, n, round(mean, 6) AS mean, mean = min(mean) OVER () AND min(n) OVER () >= 100 AS winner FROM a")
def ab_winner(spark: SparkSession, sf: str) -> DataFrame:
    return usage.compared_arms(table(spark, sf, "events").withColumn("arm", F.col("event_id") % 2), "arm", "value", 100).withColumn("mean", F.round("mean", 6))


@Q("replica_lag", "SELECT entity_namespace, greatest(0, (SELECT max(txn_id) FROM entity_snapshots) - max(txn_id)) AS lag FROM entity_snapshots GROUP BY 1")
def replica_lag(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entity_snapshots").withColumn("position", F.col("txn_id"))
    return usage.heartbeat_lag(rows, rows, "entity_namespace")


# --- texts -----------------------------------------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", "text")


def _likes(needles: tuple[str, ...], lower: bool = False) -> str:
    quote = lambda n: "'" + (n.lower() if lower else n).replace("'", "''") + "'"
    return "(" + " OR ".join(f"contains({'lower(text)' if lower else 'text'}, {quote(n)})" for n in needles) + ")"


_KINDS = (("sql_injection", textscan.SQL_INJECTION, True), ("xss", textscan.XSS, True), ("path_traversal", textscan.PATH_TRAVERSAL, False), ("command_injection", textscan.COMMANDS, False), ("sensitive_data", textscan.SENSITIVE, True))


@Q("scan_security", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE {_likes(n, low)}" for k, n, low in _KINDS))
def scan_security(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", F.explode(textscan.findings(F.col("text"))).alias("x")).select("doc_id", "x.kind")


_NEEDLES = ", ".join("({!r}, '{}', {})".format(kind, (n if cased else n.lower()).replace("'", "''"), str(cased).upper()) for kind, needles, cased in textscan.DICTIONARY for n in dict.fromkeys(x if cased else x.lower() for x in needles))


@Q(
    "scan_occurrences",
    f"""WITH w(kind, needle, cased) AS (VALUES {_NEEDLES}), t AS (SELECT doc_id, kind, needle, CASE WHEN cased THEN text ELSE lower(text) END AS text FROM documents, w WHERE text IS NOT NULL)
    SELECT doc_id, kind, needle, CAST((length(text) - length(replace(text, needle, ''))) / length(needle) AS BIGINT) AS n, strpos(text, needle) AS first FROM t WHERE contains(text, needle)""",
)
def scan_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return textscan.occurrences(_texts(spark, sf), "doc_id", "text").withColumnRenamed("key", "doc_id")


@Q("scan_secrets", f"SELECT doc_id, {_likes(textscan.CREDENTIALS)} AS credentials, {_likes(textscan.MALICIOUS)} AS malicious FROM documents WHERE text IS NOT NULL")
def scan_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", textscan.has_credentials(F.col("text")).alias("credentials"), textscan.has_malicious_code(F.col("text")).alias("malicious"))


@Q("sensitivity_level", f"SELECT doc_id, CASE WHEN {_likes(textscan.SENSITIVITY[0][1], True)} THEN 'restricted' WHEN {_likes(('confidential',), True)} THEN 'confidential' WHEN {_likes(('internal only',), True)} THEN 'internal' ELSE 'public' END AS level FROM documents WHERE text IS NOT NULL")
def sensitivity_level(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", textscan.sensitivity(F.col("text")).alias("level"))


@Q("sanitized_texts", f"SELECT doc_id, CASE WHEN {_likes(textscan.SENSITIVITY[0][1], True)} THEN 'restricted' WHEN {_likes(('confidential',), True)} THEN 'confidential' WHEN {_likes(('internal only',), True)} THEN 'internal' ELSE 'public' END AS level, NOT ({_likes(textscan.CREDENTIALS)} OR {_likes(textscan.MALICIOUS)}) AS safe, TRUE AS fits FROM documents WHERE text IS NOT NULL")
def sanitized_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What may leave of each text: its level, whether it is safe, and that no more than 500 characters of it go."""
    clean = _texts(spark, sf).select("doc_id", textscan.sanitized(F.col("text"), 500).alias("x"))
    return clean.select("doc_id", "x.level", "x.safe", (F.length("x.text") <= 500).alias("fits"))


@Q("pii_redact", r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS digest FROM documents WHERE text IS NOT NULL")
def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    """The first of the patterns, e-mail addresses."""
    pattern, name = textscan.PERSONAL[0]
    return _texts(spark, sf).select("doc_id", F.md5(F.regexp_replace("text", pattern, name)).alias("digest"))


@Q("pii_redact_all")
def pii_redact_all(spark: SparkSession, sf: str) -> DataFrame:
    """All patterns, and how many places were redacted. No SQL: DuckDB's word boundaries know only ASCII letters, Java's all letters."""
    clean = _texts(spark, sf).select("doc_id", textscan.redacted(F.col("text")).alias("x"))
    return clean.select("doc_id", F.md5("x.text").alias("digest"), F.col("x.count").cast("long").alias("redactions"))


# The tables' code names no imports, so each text is led by the lines that would import its source and its actor.
_IMPORTING = "'import \"' || coalesce(source, 'none') || '.src\"' || chr(10) || '  use actor' || chr(9) || ';' || chr(10) || 'from a' || coalesce(actor_id, 0) || ' x' || chr(10) || text"


@Q(
    "extract_imports",
    f"""WITH l AS (SELECT doc_id, regexp_replace(unnest(string_split({_IMPORTING}, chr(10))), '^[ \t\r]+|[ \t\r]+$', '', 'g') AS line FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, CASE WHEN regexp_matches(line, '["''<][^"''>]+["''>]') THEN regexp_extract(line, '["''<]([^"''>]+)["''>]', 1) ELSE regexp_extract(line, '^[^ \t\r\v\f]+[ \t\r\v\f]+([^ \t\r\v\f;]+)', 1) END AS path
          FROM l WHERE {" OR ".join(f"starts_with(line, '{k}')" for k in textscan.IMPORTS)})
    SELECT doc_id, path FROM p WHERE path <> ''""",
)
def extract_imports(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null")
    code = F.concat(F.lit('import "'), F.coalesce("source", F.lit("none")), F.lit('.src"\n  use actor\t;\nfrom a'), F.coalesce("actor_id", F.lit(0)).cast("string"), F.lit(" x\n"), F.col("text"))
    return docs.select("doc_id", F.explode(textscan.imports(code)).alias("path"))


@Q("extract_calls", f"SELECT doc_id, name FROM (SELECT doc_id, unnest(regexp_extract_all(text, '([^ \t\n=()]{{2,}})\\(', 1)) AS name FROM documents WHERE text IS NOT NULL) WHERE name NOT IN ({', '.join(repr(k) for k in textscan.KEYWORDS)})")
def extract_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", F.explode(textscan.calls(F.col("text"))).alias("name"))


@Q("token_estimate", "SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", textscan.estimated_tokens(F.col("text")).alias("tokens"))


_INTENTS = "CASE " + " ".join(f"WHEN {_likes(n, True)} THEN '{k}'" for k, n in textscan.INTENTS) + " ELSE 'other' END"


@Q("change_intent", f"SELECT doc_id, {_INTENTS} AS intent FROM documents WHERE text IS NOT NULL")
def change_intent(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", textscan.change_intent(F.col("text")).alias("intent"))


@Q("summary_strategy", "WITH t AS (SELECT doc_id, ceil(length(text) / 4) / 100.0 AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN r <= 1 THEN 'none' WHEN r < 4 THEN 'llm' WHEN r >= 10 THEN 'hierarchical' ELSE 'sliding_window' END AS strategy FROM t")
def summary_strategy(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", textscan.summary_strategy(textscan.estimated_tokens(F.col("text")), 100).alias("strategy"))


# --- what usage suggests -----------------------------------------------------------------------------------------------------------------

_CONFIDENCE = f"""c AS (SELECT user_id AS pattern, count(*) AS n, least(1, count(*) / 10.0 * CASE WHEN {_AGE} < 1 THEN 1.0 WHEN {_AGE} < 24 THEN 0.8 ELSE 0.5 END) AS confidence
    FROM events WHERE user_id IS NOT NULL GROUP BY 1), b AS (SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM c)"""


@Q("predict_confidence", f"WITH {_CONFIDENCE} SELECT pattern, n, round(confidence, 6) AS confidence, band FROM b")
def predict_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return usage.pattern_confidence(table(spark, sf, "events"), "user_id", _now()).withColumn("confidence", F.round("confidence", 6))


@Q("predict_insights", f"WITH {_CONFIDENCE} SELECT count(*) AS patterns, count(*) FILTER (band = 'high') AS high, count(*) FILTER (band = 'medium') AS medium, count(*) FILTER (band = 'low') AS low, round(avg(confidence), 6) AS mean_confidence FROM b")
def predict_insights(spark: SparkSession, sf: str) -> DataFrame:
    return usage.insights(usage.pattern_confidence(table(spark, sf, "events"), "user_id", _now())).withColumn("mean_confidence", F.round("mean_confidence", 6))


_SUGGESTED = """s AS (SELECT 'cache' AS target, 'increase_cache' AS kind, 2 AS priority, count(*) AS n FROM events HAVING count(*) FILTER (value < 40) < 0.5 * count(*)
    UNION ALL SELECT * FROM (SELECT event_type, 'build', 3, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, event_type LIMIT 5) WHERE n > 1000)"""


def _suggested(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses of less than 40 ms count as hits."""
    return usage.suggestions(table(spark, sf, "events"), "event_type", F.col("value") < 40)


@Q("usage_suggestions", f"WITH {_SUGGESTED} SELECT * FROM s")
def usage_suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return _suggested(spark, sf)


@Q(
    "build_queue",
    f"""WITH {_SUGGESTED}, q AS (SELECT target, priority, n AS seq FROM s UNION ALL SELECT event_type, 1, count(*) FROM events WHERE event_type IS NOT NULL GROUP BY 1),
    o AS (SELECT target, arg_min(priority, (seq, priority)) AS priority, min(seq) AS seq FROM q WHERE target != 'view' GROUP BY 1)
    SELECT target, priority, CAST(row_number() OVER (ORDER BY priority DESC, seq, target) AS INTEGER) AS place, row_number() OVER (ORDER BY priority DESC, seq, target) <= 2 AS starts FROM o""",
)
def build_queue(spark: SparkSession, sf: str) -> DataFrame:
    """What usage suggests, and each type once more with less urgency; views are being built, and three builds may run at once."""
    asked = _suggested(spark, sf).select("target", "priority", F.col("n").alias("seq"))
    again = table(spark, sf, "events").where("event_type is not null").groupBy(F.col("event_type").alias("target")).agg(F.lit(1).alias("priority"), F.count("*").alias("seq"))
    return usage.build_queue(asked.unionByName(again), spark.createDataFrame([("view",)], "target string"), 3)


@Q("accuracy_levels", "SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS level, count(*) AS results FROM relevance_factors WHERE confidence IS NOT NULL AND NOT isnan(confidence) GROUP BY 1")
def accuracy_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "relevance_factors").where("confidence is not null and not isnan(confidence)")
    return rows.groupBy(usage.accuracy_level(F.col("confidence")).alias("level")).agg(F.count("*").alias("results"))


@Q("retained_changes", "SELECT share, count(*) AS changes FROM (SELECT epoch_us(TIMESTAMP '2024-07-01') - epoch_us(ts) AS age FROM event_index WHERE ts IS NOT NULL), (SELECT unnest([0, 1]) AS share) WHERE age <= 90 * 86400000000 AND (age <= 30 * 86400000000 OR share = 1) GROUP BY 1")
def retained_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What retention keeps if none, and if all, of what is older than 30 days but not than 90 is sampled."""
    events = table(spark, sf, "event_index").where("ts is not null").withColumn("seq", F.col("event_id"))
    now = F.lit("2024-07-01 00:00:00").cast("timestamp_ntz")
    kept = [temporal.retained(events, now, sample=float(x)).select(F.lit(x).alias("share")) for x in (0, 1)]
    return kept[0].unionByName(kept[1]).groupBy("share").agg(F.count("*").alias("changes"))
