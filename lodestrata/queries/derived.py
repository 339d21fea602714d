"""Ids, line differences, traces and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestrata.functions import ids
from lodestrata.functions.linediff import line_diff, restores
from lodestrata.operators import derived
from lodestrata.operators.hierarchy import hierarchies, number_key, key_number
from lodestrata.queries.registry import Registry
from lodestrata.sources.export import version_readable
from lodestrata.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.query


@Q("entity_ids", "SELECT DISTINCT entity_namespace || ':' || entity_local_id AS entity, entity_namespace AS ns, entity_local_id AS local FROM snapshot_deliveries")
def entity_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = table(spark, sf, "snapshot_deliveries").select(ids.entity_id(F.col("entity_namespace"), F.col("entity_local_id")).alias("entity")).distinct()
    return made.select("entity", ids.parse_entity_id(F.col("entity")).alias("x")).select("entity", "x.ns", "x.local")


@Q("topic_parents", "SELECT type_name AS path, family AS parent FROM event_types")
def topic_parents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "event_types").select(F.col("type_name").alias("path"), ids.topic_parent(F.col("type_name")).alias("parent"))


# SQL knows by how many lines two texts differ, and that the hunks must turn one into the other. Lines end as Python's do.
_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _lines(text: str) -> str:
    return f"(len(regexp_extract_all(coalesce({text}, ''), '{_ENDS}')) + CASE WHEN coalesce({text}, '') = '' OR regexp_matches({text}, '({_ENDS})$') THEN 0 ELSE 1 END)"


@Q(
    "line_diff",
    f"""WITH p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY source ORDER BY created_at NULLS FIRST, doc_id) AS old FROM documents)
    SELECT doc_id, CAST({_lines("text")} - {_lines("old")} AS BIGINT) AS net_lines, TRUE AS restored FROM p""",
)
def line_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the one of its source that was made before it: the lines that the hunks add, and whether they turn one into the other."""
    order = W.partitionBy("source").orderBy("created_at", "doc_id")
    pairs = table(spark, sf, "documents").select("doc_id", "text", F.lag("text").over(order).alias("old"))
    hunks = pairs.withColumn("h", line_diff(F.col("old"), F.col("text")))
    net = F.aggregate("h", F.lit(0).cast("long"), lambda n, h: n + h["lines_added"] - h["lines_removed"])
    return hunks.select("doc_id", net.alias("net_lines"), restores(F.col("old"), F.col("h"), F.col("text")).alias("restored"))


@Q(
    "trace_tree",
    """WITH RECURSIVE s AS (SELECT session_id, parent_session_id, start_time_ms, end_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, parent_session_id DESC NULLS LAST, start_time_ms DESC NULLS LAST, end_time_ms DESC NULLS LAST) AS c FROM session_nodes WHERE session_id IS NOT NULL) WHERE c = 1),
    t AS (SELECT session_id, session_id AS trace_id, CAST(0 AS BIGINT) AS depth, end_time_ms - start_time_ms AS duration_ms FROM s WHERE parent_session_id IS NULL OR parent_session_id NOT IN (SELECT session_id FROM s)
          UNION ALL SELECT s.session_id, t.trace_id, t.depth + 1, s.end_time_ms - s.start_time_ms FROM t JOIN s ON s.parent_session_id = t.session_id) SELECT * FROM t""",
)
def trace_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions as spans of the trace that their root is."""
    newest = table(spark, sf, "session_nodes").where("session_id is not null").groupBy("session_id").agg(F.max(F.struct("received_at", "parent_session_id", "start_time_ms", "end_time_ms")).alias("x")).select("session_id", "x.*")
    tree = hierarchies(newest.select(number_key(F.col("session_id")).alias("id"), number_key(F.col("parent_session_id")).alias("parent")), paths=False).where("root is not null")
    spans = tree.select(key_number(F.col("id")).alias("session_id"), key_number(F.col("root")).alias("trace_id"), "depth")
    return spans.join(newest.select("session_id", (F.col("end_time_ms") - F.col("start_time_ms")).alias("duration_ms")), "session_id")


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    """One derived table per namespace and branch of the snapshots."""
    s = table(spark, sf, "entity_snapshots").groupBy(F.col("entity_namespace").alias("kind"), F.coalesce("branch_id", F.lit("main")).alias("name"))
    return s.agg(F.max("txn_id").alias("source_txn"), F.max("received_at").alias("built_at"), F.count("*").alias("entries"), F.sum(F.coalesce(F.length("state_data"), F.lit(0))).alias("bytes"))


_REGISTRY = "r AS (SELECT entity_namespace AS kind, coalesce(branch_id, 'main') AS name, max(txn_id) AS source_txn, max(received_at) AS built_at, count(*) AS entries, CAST(sum(coalesce(length(state_data), 0)) AS BIGINT) AS bytes FROM entity_snapshots GROUP BY 1, 2)"
_AGE = "(epoch_us(TIMESTAMP '2024-07-01') - epoch_us(built_at)) / 3.6e9"


@Q("derived_rebuilds", f"WITH {_REGISTRY}, m AS (SELECT max(txn_id) AS top FROM entity_snapshots) SELECT kind, name, CASE WHEN {_AGE} < 24 THEN NULL WHEN top - source_txn >= 500 THEN 'txns' WHEN {_AGE} >= 1500 AND top - source_txn >= 10 THEN 'age' END AS reason FROM r, m")
def derived_rebuilds(spark: SparkSession, sf: str) -> DataFrame:
    top = F.lit(table(spark, sf, "entity_snapshots").agg(F.max("txn_id")).first()[0])
    reason = derived.rebuild_reason(top, F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"), 24, 500, 1500, 10)
    return _registry(spark, sf).select("kind", "name", reason.alias("reason"))


@Q("derived_health", f"WITH {_REGISTRY} SELECT kind, name, round({_AGE}, 4) AS age_hours, CASE WHEN {_AGE} >= 2500 THEN 'stale' ELSE 'healthy' END AS status FROM r")
def derived_health(spark: SparkSession, sf: str) -> DataFrame:
    h = derived.health(_registry(spark, sf), F.lit("2024-07-01 00:00:00").cast("timestamp_ntz"), 2500)
    return h.select("kind", "name", F.round("age_hours", 4).alias("age_hours"), "status")


@Q("derived_totals", f"WITH {_REGISTRY} SELECT kind, count(*) AS tables, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1")
def derived_totals(spark: SparkSession, sf: str) -> DataFrame:
    return derived.totals(_registry(spark, sf))


@Q("version_compatibility", "SELECT r || '.' || s || '.0' AS reader, w || '.' || x || '.0' AS writer, r = w AND s >= x AS readable FROM (SELECT DISTINCT n_regionkey AS r FROM nation) a, (SELECT DISTINCT n_regionkey AS s FROM nation) b, (SELECT DISTINCT n_regionkey AS w FROM nation) c, (SELECT DISTINCT n_regionkey AS x FROM nation) d")
def version_compatibility(spark: SparkSession, sf: str) -> DataFrame:
    keys = F.sequence(F.lit(0), F.lit(4))
    grid = spark.range(1).select(F.explode(keys).alias("r")).select("r", F.explode(keys).alias("s")).select("r", "s", F.explode(keys).alias("w")).select("r", "s", "w", F.explode(keys).alias("x"))
    version = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("."), F.col(b).cast("string"), F.lit(".0"))
    return grid.select(version("r", "s").alias("reader"), version("w", "x").alias("writer")).withColumn("readable", version_readable(F.col("reader"), F.col("writer")))


@Q(
    "route_best_source",
    """SELECT CASE WHEN c >= a AND c >= b AND NOT (a >= c) THEN 'cache' WHEN a >= b THEN 'archive' ELSE 'base' END AS source, count(*) AS requests FROM
    (SELECT value / 200 * 1.1 AS a, 0.25 AS b, (1 - value / 200) * 0.9 + 0.1 AS c FROM events WHERE value IS NOT NULL) GROUP BY 1""",
)
def route_best_source(spark: SparkSession, sf: str) -> DataFrame:
    """Each request goes to the source that promises most: a fast archive, a plain table, or a slow cache that mostly hits."""
    v = F.col("value") / 200
    source = derived.best_source({"archive": v, "base": F.lit(0.25), "cache": 1 - v}, {"archive": 5, "cache": 150}, {"cache": 0.9})
    return table(spark, sf, "events").where("value is not null").groupBy(source.alias("source")).agg(F.count("*").alias("requests"))


@Q("derived_invalidated", "SELECT DISTINCT split_part(TRY_CAST(key AS VARCHAR), ':', 1) AS name FROM kv_commits WHERE txn_id > (SELECT max(txn_id) // 2 FROM kv_commits) AND lower(trim(op)) = 'put' AND regexp_matches(TRY_CAST(key AS VARCHAR), '^[a-z]+:')")
def derived_invalidated(spark: SparkSession, sf: str) -> DataFrame:
    """A table per kind of key, made at half of the log: those that later puts touch."""
    commits = table(spark, sf, "kv_commits").select("txn_id", F.regexp_extract(F.col("key").cast("string"), "^[a-z]+:", 0).alias("key_prefix"), F.lower(F.trim("op")).alias("op")).where("key_prefix <> ''")
    middle = (commits.agg(F.max("txn_id")).first()[0] or 0) // 2
    names = commits.select(F.rtrim("key_prefix", F.lit(":")).alias("name"), F.col("key_prefix").alias("prefix")).distinct()
    registry = names.select("name", F.lit(middle).alias("source_txn"))
    return derived.invalidated(registry, names.select("name", "prefix", F.lit("put").alias("op")), commits)
