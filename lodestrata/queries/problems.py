"""Queries p1 to p6, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lodestrata.functions.jsonstate import state_hash
from lodestrata.operators.change_feed import apply_feed
from lodestrata.operators.entity_features import entity_type_stats, feature_table, normal_type
from lodestrata.operators.hierarchy import descendants, hierarchies, key_number, number_key
from lodestrata.operators.merkle import append_snapshot, changed_versions, validity
from lodestrata.operators.outranking import INDIFFERENT, PREFERRED, net_flow
from lodestrata.operators.snapshot_diff import neighbouring_changes
from lodestrata.plans.lineage import cut
from lodestrata.queries.registry import Registry
from lodestrata.sources.tables import table

REGISTRY = Registry()

# --- 1: features per entity ---------------------------------------------------------------------------------------------

_EVENTS = """events1 AS (
  SELECT DISTINCT ON (event_id, actor_id, kind) event_id, actor_id, kind, ts, ms FROM (
    SELECT event_id, actor_id, lower(regexp_replace(event_type, '^\\s+|\\s+$', '', 'g')) AS kind, ts,
           TRY_CAST(json_extract_string(payload, '$.ms') AS DOUBLE) AS ms
    FROM event_index WHERE actor_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)
  ORDER BY event_id, actor_id, kind, ts DESC)"""


#: Columns of features that a row may have.
MAX_TYPES = 10_000


@REGISTRY.query(
    "p1_found",
    f"""WITH {_EVENTS}
    SELECT actor_id, kind AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events1 GROUP BY 1, 2""",
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    stats = entity_type_stats(table(spark, sf, "event_index"))
    return stats.select(F.col("entity").alias("actor_id"), F.col("kind").alias("event_type"), F.col("last_event_id").alias("event_id"))


@REGISTRY.query(
    "p1_features",
    f"""WITH {_EVENTS},
    stats AS (SELECT actor_id, kind, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(ms) AS total FROM events1 GROUP BY 1, 2),
    types AS (SELECT DISTINCT lower(trim(type_name)) AS kind FROM event_types WHERE type_name IS NOT NULL),
    per AS (SELECT actor_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_types, min(first_ts) AS first_ts, max(last_ts) AS last_ts,
                   CAST(coalesce(sum(n) FILTER (kind NOT IN (SELECT kind FROM types)), 0) AS BIGINT) AS other_events
            FROM stats GROUP BY 1)
    SELECT p.actor_id, any_value(p.n_events) AS n_events, any_value(p.n_types) AS n_types, any_value(p.first_ts) AS first_ts,
           any_value(p.last_ts) AS last_ts, any_value(p.other_events) AS other_events,
           string_agg(CAST(coalesce(s.n, 0) AS VARCHAR), ',' ORDER BY t.kind) AS counts,
           string_agg(coalesce(CAST(CAST(floor((epoch_us(TIMESTAMP '2025-01-01') - epoch_us(s.last_ts)) / 1000000) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY t.kind) AS recency_s,
           string_agg(CAST(CAST(coalesce(s.total, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY t.kind) AS totals
    FROM per p CROSS JOIN types t LEFT JOIN stats s ON s.actor_id = p.actor_id AND s.kind = t.kind GROUP BY 1""",
)
def p1_features(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "event_index")
    stats = entity_type_stats(events, value=F.get_json_object("payload", "$.ms").try_cast("double"))
    # The list of types is a fixed, small table; one that isn't is an error, not a shorter list.
    types = [r[0] for r in table(spark, sf, "event_types").select(normal_type(F.col("type_name"))).distinct().limit(MAX_TYPES + 1).collect()]
    if len(types) > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} event types")
    wide = feature_table(stats, types, F.lit("2025-01-01").cast("timestamp_ntz"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ",", "-").alias(c)
    return wide.select(F.col("entity").alias("actor_id"), "n_events", "n_types", "first_ts", "last_ts", "other_events", text("counts"), text("recency_s"), text("totals"))


# --- 2: history ---------------------------------------------------------------------------------------------------------

# A state's value in SQL: the sorted list of its leaves and containers, each with its path, type and atom.
_VALUES = """{name} AS (
  SELECT r.rid, list_sort(list(t.fullkey || chr(1) || CASE WHEN t.type IN ('UBIGINT', 'BIGINT') THEN 'INTEGER' ELSE t.type END || chr(1) || coalesce(CAST(t.atom AS VARCHAR), ''))) AS v
  FROM {rows} r, json_tree(r.state_data) t WHERE r.state_data IS NOT NULL GROUP BY r.rid)"""

_HISTORY = f"""held AS (
      SELECT row_number() OVER () AS rid, entity_namespace, entity_local_id, version, ts, state_data FROM (
        SELECT *, row_number() OVER (PARTITION BY entity_namespace, entity_local_id, version ORDER BY received_at DESC) AS copy
        FROM entity_snapshots WHERE branch_id IS NULL AND version IS NOT NULL) WHERE copy = 1),
    {_VALUES.format(name="vals", rows="held")},
    seen AS (SELECT h.*, v.v, row_number() OVER w AS i, lag(v.v) OVER w AS was, lag(h.state_data) OVER w AS was_text
             FROM held h LEFT JOIN vals v USING (rid) WINDOW w AS (PARTITION BY entity_namespace, entity_local_id ORDER BY version)),
    changes AS (SELECT * FROM seen WHERE i = 1 OR v IS DISTINCT FROM was)"""


@REGISTRY.query("p2_found", f"WITH {_HISTORY} SELECT entity_namespace, entity_local_id, version FROM changes")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return changed_versions(table(spark, sf, "entity_snapshots"), keep_state=False).select("entity_namespace", "entity_local_id", "version")


@REGISTRY.query(
    "p2_history",
    f"""WITH {_HISTORY},
    begun AS (SELECT *, max(ts) OVER (PARTITION BY entity_namespace, entity_local_id ORDER BY version) AS valid_from FROM changes)
    SELECT entity_namespace, entity_local_id, version, state_data, valid_from,
           lead(valid_from) OVER w AS valid_to, lead(version) OVER w IS NULL AS is_current
    FROM begun WINDOW w AS (PARTITION BY entity_namespace, entity_local_id ORDER BY version)""",
)
def p2_history(spark: SparkSession, sf: str) -> DataFrame:
    history = validity(changed_versions(table(spark, sf, "entity_snapshots")))
    return history.select("entity_namespace", "entity_local_id", "version", "state_data", "valid_from", "valid_to", "is_current")


# --- 3: changes between deliveries ----------------------------------------------------------------------------------------

_HELD = f"""held AS (
      SELECT row_number() OVER () AS rid, delivery_no, entity_namespace, entity_local_id, state_data FROM (
        SELECT *, row_number() OVER (PARTITION BY delivery_no, entity_namespace, entity_local_id ORDER BY delivered_at DESC) AS copy
        FROM snapshot_deliveries WHERE delivery_no IS NOT NULL) WHERE copy = 1),
    {_VALUES.format(name="vals", rows="held")}"""

_DELIVERIES = f"""{_HELD},
    numbers AS (SELECT delivery_no, lag(delivery_no) OVER (ORDER BY delivery_no) AS before FROM (SELECT DISTINCT delivery_no FROM held)),
    now AS (SELECT h.*, v.v, n.before FROM held h JOIN numbers n USING (delivery_no) LEFT JOIN vals v USING (rid)),
    pairs AS (
      SELECT coalesce(b.delivery_no, n.delivery_no) AS delivery_no, coalesce(b.entity_namespace, a.entity_namespace) AS entity_namespace,
             coalesce(b.entity_local_id, a.entity_local_id) AS entity_local_id,
             CASE WHEN a.rid IS NULL THEN 'added' WHEN b.rid IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change_kind
      FROM (SELECT * FROM now WHERE before IS NOT NULL) b
      FULL JOIN (SELECT x.*, m.delivery_no AS following FROM now x JOIN numbers m ON m.before = x.delivery_no) a
        ON a.following = b.delivery_no AND a.entity_namespace = b.entity_namespace AND a.entity_local_id = b.entity_local_id
      LEFT JOIN numbers n ON n.delivery_no = a.following)"""


@REGISTRY.query("p3_found", f"WITH {_DELIVERIES} SELECT delivery_no, entity_namespace, entity_local_id, change_kind FROM pairs WHERE change_kind IS NOT NULL")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbouring_changes(table(spark, sf, "snapshot_deliveries"))


@REGISTRY.query(
    "p3_summary",
    f"""WITH {_DELIVERIES} SELECT delivery_no, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
    count(*) FILTER (change_kind = 'changed') AS changed FROM pairs WHERE change_kind IS NOT NULL GROUP BY 1""",
)
def p3_summary(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("change_kind") == kind).alias(kind)
    return neighbouring_changes(table(spark, sf, "snapshot_deliveries")).groupBy("delivery_no").agg(of("added"), of("removed"), of("changed"))


_LIVES = f"""{_HELD},
    numbers AS (SELECT delivery_no, row_number() OVER (ORDER BY delivery_no) AS nth FROM (SELECT DISTINCT delivery_no FROM held)),
    seen AS (SELECT h.*, n.nth, v.v, lag(n.nth) OVER w AS before, lag(v.v) OVER w AS was FROM held h JOIN numbers n USING (delivery_no) LEFT JOIN vals v USING (rid)
             WINDOW w AS (PARTITION BY entity_namespace, entity_local_id ORDER BY n.nth)),
    lives AS (SELECT *, sum(CASE WHEN before = nth - 1 AND v IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER (PARTITION BY entity_namespace, entity_local_id ORDER BY nth) AS life FROM seen),
    spans AS (SELECT entity_namespace, entity_local_id, min(nth) AS first, max(nth) AS last FROM lives GROUP BY 1, 2, life)"""


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """``no, key, state, hash``: each delivery as a full snapshot."""
    rows = table(spark, sf, "snapshot_deliveries").where("delivery_no is not null").select(F.col("delivery_no").alias("no"), F.struct("entity_namespace", "entity_local_id").alias("key"), "delivered_at", "state_data")
    return rows.groupBy("no", "key").agg(F.max(F.struct("delivered_at", "state_data")).alias("x")).select("no", "key", F.col("x.state_data").alias("state"), state_hash(F.col("x.state_data")).alias("hash"))


@REGISTRY.query("p2_append_snapshot", f"WITH {_LIVES} SELECT entity_namespace, entity_local_id, a.delivery_no AS valid_from, b.delivery_no AS valid_to FROM spans s JOIN numbers a ON a.nth = s.first LEFT JOIN numbers b ON b.nth = s.last + 1")
def p2_append_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The history that full snapshots leave, appended delivery by delivery; a period ends with the delivery that brings another state or none."""
    snapshots = cut(_snapshots(spark, sf))
    numbers = sorted(r[0] for r in snapshots.select("no").distinct().collect())  # deliveries are few
    history = spark.createDataFrame([], snapshots.select("key", "state").schema).select("*", F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    previous = snapshots.where("false")
    for no in numbers:
        current = snapshots.where(F.col("no") == no)
        history = cut(append_snapshot(history, previous, current, F.timestamp_seconds(F.lit(no)), hashed="hash"))
        previous = current
    seconds = lambda c: F.unix_seconds(c).cast("int").alias(c)
    return history.select("key.entity_namespace", "key.entity_local_id", seconds("valid_from"), seconds("valid_to"))


# --- 4: change feed -------------------------------------------------------------------------------------------------------

_FEED = """changes AS (
      SELECT * FROM (SELECT *, lower(trim(op)) AS kind, row_number() OVER (PARTITION BY txn_id, seq ORDER BY feed_offset) AS copy
                     FROM kv_commits WHERE txn_id IS NOT NULL AND seq IS NOT NULL AND key IS NOT NULL AND lower(trim(op)) IN ('put', 'del', 'delete')) WHERE copy = 1),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age FROM changes) WHERE age = 1)"""


@REGISTRY.query("p4_found", f"WITH {_FEED} SELECT hex(key) AS key_hex, txn_id, seq FROM last WHERE kind = 'put'")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return apply_feed(table(spark, sf, "kv_commits")).select(F.hex("key").alias("key_hex"), "txn_id", "seq")


@REGISTRY.query("p4_state", f"WITH {_FEED} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM last WHERE kind = 'put'")
def p4_state(spark: SparkSession, sf: str) -> DataFrame:
    return apply_feed(table(spark, sf, "kv_commits")).select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "txn_id", "seq")


@REGISTRY.query("p4_merge", f"WITH {_FEED} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM last WHERE kind = 'put'")
def p4_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The later half of the transactions merged into the state that the earlier half leaves."""
    feed = table(spark, sf, "kv_commits")
    middle = (feed.agg(F.max("txn_id")).first()[0] or 0) // 2
    state = apply_feed(feed.where(F.col("txn_id") > middle), apply_feed(feed.where(F.col("txn_id") <= middle)))
    return state.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), "txn_id", "seq")


# --- 5: hierarchies -------------------------------------------------------------------------------------------------------


def _newest(rows: DataFrame, key: str, parent: str) -> DataFrame:
    """The parent in the row of each key that was received last, of equal ones the greatest."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("received_at", parent)).alias("row")).select(key, F.col(f"row.{parent}").alias(parent))


def forest(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    """The hierarchies of sessions and snapshots, solved as one forest; a kind's letter leads its ids."""
    sessions = _newest(table(spark, sf, "session_nodes"), "session_id", "parent_session_id")
    snapshots = _newest(table(spark, sf, "entity_snapshots"), "id", "parent_snapshot_id")
    number = lambda c: F.concat(F.lit("n"), number_key(F.col(c)))
    text = lambda c: F.concat(F.lit("s"), F.col(c))
    nodes = sessions.select(number("session_id").alias("id"), number("parent_session_id").alias("parent")).unionByName(
        snapshots.select(text("id").alias("id"), text("parent_snapshot_id").alias("parent"))
    )
    return hierarchies(nodes, paths)


def _plain(key) -> F.Column:
    """A node's id as it is in its table."""
    column = F.col(key) if isinstance(key, str) else key
    return F.when(F.startswith(column, F.lit("n")), key_number(F.substr(column, F.lit(2))).cast("string")).otherwise(F.substr(column, F.lit(2)))


_FOREST = """nodes AS (
      SELECT 'session' AS kind, CAST(session_id AS VARCHAR) AS id, lpad(CAST(session_id AS VARCHAR), 20, '0') AS sort, CAST(parent_session_id AS VARCHAR) AS parent
      FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, parent_session_id DESC NULLS LAST) AS c FROM session_nodes WHERE session_id IS NOT NULL) WHERE c = 1
      UNION ALL
      SELECT 'snapshot', id, id, parent_snapshot_id
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY received_at DESC, parent_snapshot_id DESC NULLS LAST) AS c FROM entity_snapshots WHERE id IS NOT NULL) WHERE c = 1),
    links AS (SELECT n.kind, n.id, p.id AS parent FROM nodes n LEFT JOIN nodes p ON p.kind = n.kind AND p.id = n.parent)"""
_DOWN = f"""WITH RECURSIVE {_FOREST},
    tree AS (SELECT kind, id, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM links WHERE parent IS NULL
             UNION ALL SELECT l.kind, l.id, t.root, t.depth + 1, t.path || ' > ' || l.id FROM tree t JOIN links l ON l.kind = t.kind AND l.parent = t.id)"""


@REGISTRY.query(
    "p5_found",
    f"""{_DOWN},
    lost AS (SELECT l.kind, l.id, l.parent, n.sort FROM links l JOIN nodes n USING (kind, id) WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.kind = l.kind AND t.id = l.id)),
    up AS (SELECT kind, id, parent AS goal FROM lost UNION SELECT u.kind, u.id, l.parent FROM up u JOIN lost l ON l.kind = u.kind AND l.id = u.goal),
    ring AS (SELECT kind, id FROM up WHERE id = goal),
    cycles AS (SELECT u.kind, u.id, arg_min(r.id, n.sort) AS cycle_id FROM up u JOIN ring r ON r.kind = u.kind AND r.id = u.goal JOIN nodes n ON n.kind = r.kind AND n.id = r.id GROUP BY 1, 2)
    SELECT kind AS node_kind, id AS node_id, cycle_id FROM cycles""",
)
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    lost = forest(spark, sf, paths=False).where("cycle_id is not null")
    return lost.select(_kind("id"), _plain("id").alias("node_id"), _plain("cycle_id").alias("cycle_id"))


def _kind(column: str) -> F.Column:
    return F.when(F.startswith(F.col(column), F.lit("n")), "session").otherwise("snapshot").alias("node_kind")


@REGISTRY.query(
    "p5_paths",
    f"""{_DOWN} SELECT l.kind AS node_kind, l.id AS node_id, t.root AS root_id, t.depth, t.path
    FROM links l LEFT JOIN tree t ON t.kind = l.kind AND t.id = l.id""",
)
def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    tree = forest(spark, sf, paths=True)
    path = F.array_join(F.transform("path", _plain), " > ")
    return tree.select(_kind("id"), _plain("id").alias("node_id"), _plain("root").alias("root_id"), "depth", path.alias("path"))


@REGISTRY.query(
    "p5_descendants",
    f"""WITH RECURSIVE {_FOREST},
    tree AS (SELECT kind, id FROM links WHERE parent IS NULL UNION ALL SELECT l.kind, l.id FROM tree t JOIN links l ON l.kind = t.kind AND l.parent = t.id),
    below AS (SELECT l.kind, l.parent AS ancestor, l.id AS descendant, CAST(1 AS BIGINT) AS distance FROM links l JOIN tree t ON t.kind = l.kind AND t.id = l.id WHERE l.parent IS NOT NULL
              UNION ALL SELECT b.kind, l.parent, b.descendant, b.distance + 1 FROM below b JOIN links l ON l.kind = b.kind AND l.id = b.ancestor WHERE l.parent IS NOT NULL)
    SELECT kind AS node_kind, ancestor AS ancestor_id, descendant AS descendant_id, distance FROM below""",
)
def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    below = descendants(forest(spark, sf, paths=True))
    return below.select(_kind("ancestor"), _plain("ancestor").alias("ancestor_id"), _plain("descendant").alias("descendant_id"), "distance")


# --- 6: one ranking -------------------------------------------------------------------------------------------------------

#: Equal weights: the factors' ranges and units say nothing of their worth.
FACTORS = {"confidence": 1.0, "recency": 1.0, "popularity": 1.0, "semantic_similarity": 1.0}


@REGISTRY.query(
    "p6_ranking",
    f"""WITH once AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_id ORDER BY computed_at DESC NULLS LAST, {", ".join(f"nullif({c}, 'NaN') DESC NULLS LAST" for c in FACTORS)}) AS c
                     FROM relevance_factors WHERE query_id IS NOT NULL AND result_id IS NOT NULL) WHERE c = 1),
    long AS ({" UNION ALL ".join(f"SELECT query_id, result_id, '{c}' AS f, CAST({c} AS DOUBLE) AS v FROM once WHERE {c} IS NOT NULL AND NOT isnan({c})" for c in FACTORS)}),
    pct AS (SELECT query_id, result_id, f, (rank() OVER w - 1 + 0.5 * count(*) OVER (PARTITION BY query_id, f, v)) / count(*) OVER (PARTITION BY query_id, f) AS x
            FROM long WINDOW w AS (PARTITION BY query_id, f ORDER BY v)),
    flows AS (SELECT a.query_id, a.result_id, a.f, sum(least(1, greatest(0, (a.x - b.x - {INDIFFERENT}) / {PREFERRED - INDIFFERENT})) - least(1, greatest(0, (b.x - a.x - {INDIFFERENT}) / {PREFERRED - INDIFFERENT}))) AS flow
              FROM pct a JOIN pct b ON a.query_id = b.query_id AND a.f = b.f GROUP BY 1, 2, 3),
    net AS (SELECT o.query_id, o.result_id, coalesce(sum(f.flow), 0) / 4 / greatest(1, any_value(n.n) - 1) AS net
            FROM once o JOIN (SELECT query_id, count(*) AS n FROM once GROUP BY 1) n USING (query_id) LEFT JOIN flows f USING (query_id, result_id) GROUP BY 1, 2)
    SELECT query_id, result_id, round(net, 9) + 0.0 AS net_flow, row_number() OVER (PARTITION BY query_id ORDER BY round(net, 12) DESC, result_id) AS position FROM net""",
)
def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranked = net_flow(table(spark, sf, "relevance_factors"), FACTORS)
    return ranked.select("query_id", "result_id", (F.round("net_flow", 9) + F.lit(0.0)).alias("net_flow"), "position")
