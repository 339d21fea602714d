"""Snapshots of the commit log, over ``kv_commits``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import timetravel as tt
from lodestrata.plans.lineage import ensure_checkpoint_dir
from lodestrata.queries.registry import Registry
from lodestrata.sources.commit_log import CommitLog
from lodestrata.sources.tables import table

REGISTRY = Registry()

def log_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each change once: equal (``txn_id``, ``seq``) are repeats of one delivery."""
    return table(spark, sf, "kv_commits").groupBy("txn_id", "seq").agg(F.min_by(F.struct("op", "key", "value"), "feed_offset").alias("x")).select("txn_id", "seq", "x.*")


_LOG = "log AS (SELECT txn_id, seq, lower(trim(op)) AS op, key, value FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, seq ORDER BY feed_offset) AS c FROM kv_commits) WHERE c = 1)"


def _as_of(name: str, n: int | None) -> str:
    limit = "" if n is None else f"AND txn_id <= {n}"
    return f"""{name} AS (SELECT key, value, txn_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age
      FROM log WHERE key IS NOT NULL AND txn_id IS NOT NULL {limit}) WHERE age = 1 AND op = 'put')"""


def _hexed(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.hex("key").alias("key_hex"), F.hex("value").alias("value_hex"), *more)


_ENDS = """ends AS (SELECT t.top, (SELECT coalesce(max(txn_id), 0) FROM log WHERE txn_id <= t.top // 4) AS early, (SELECT coalesce(max(txn_id), 0) FROM log WHERE txn_id <= t.top // 2) AS mid
      FROM (SELECT coalesce(max(txn_id), 0) AS top FROM log) t)"""


def _ends(spark: SparkSession, sf: str) -> tuple[int, int, int]:
    """The last transactions committed up to a quarter and half of the last one's number, and the last one."""
    commits = table(spark, sf, "kv_commits")  # repeats don't matter here
    top = tt.latest_snapshot(commits)
    upto = lambda n: tt.latest_snapshot(commits.where(F.col("txn_id") <= n))
    return upto(top // 4), upto(top // 2), top


def _as_of_end(name: str, end: str) -> str:
    return f"""{name} AS (SELECT key, value, txn_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age
      FROM log WHERE key IS NOT NULL AND txn_id <= (SELECT {end} FROM ends)) WHERE age = 1 AND op = 'put')"""


@REGISTRY.query("kv_snapshot_as_of", f"WITH {_LOG}, {_ENDS}, {_as_of_end('s', 'mid')} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM s")
def kv_snapshot_as_of(spark: SparkSession, sf: str) -> DataFrame:
    _, mid, _ = _ends(spark, sf)
    return _hexed(tt.as_of(log_of(spark, sf), mid), "txn_id", "seq")


@REGISTRY.query("kv_latest_state", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM s")
def kv_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return _hexed(tt.as_of(log_of(spark, sf)))


@REGISTRY.query("kv_point_get", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM s WHERE key = CAST('task:9' AS BLOB)")
def kv_point_get(spark: SparkSession, sf: str) -> DataFrame:
    return _hexed(tt.as_of(log_of(spark, sf).where(F.col("key") == F.lit(b"task:9"))))


@REGISTRY.query("kv_range_scan", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM s WHERE key >= CAST('claim:' AS BLOB) AND key < CAST('claimed:3' AS BLOB)")
def kv_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _hexed(tt.key_range(tt.as_of(log_of(spark, sf)), b"claim:", b"claimed:3"))


@REGISTRY.query("kv_prefix_scan", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM s WHERE starts_with(hex(key), hex('task:'))")
def kv_prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _hexed(tt.key_prefix(tt.as_of(log_of(spark, sf)), b"task:"))


@REGISTRY.query(
    "kv_snapshot_diff",
    f"""WITH {_LOG}, {_ENDS}, {_as_of_end('a', 'early')}, {_as_of_end('b', 'mid')}
    SELECT hex(coalesce(a.key, b.key)) AS key_hex, hex(a.value) AS old_hex, hex(b.value) AS new_hex,
           CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value""",
)
def kv_snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    early, mid, _ = _ends(spark, sf)
    diff = tt.changes_between(log_of(spark, sf), early, mid)
    return diff.select(F.hex("key").alias("key_hex"), F.hex("old_value").alias("old_hex"), F.hex("new_value").alias("new_hex"), "change_kind")


@REGISTRY.query("kv_replay_counts", f"WITH {_LOG} SELECT txn_id, count(*) FILTER (op = 'put') AS puts, count(*) FILTER (op IN ('del', 'delete')) AS deletes, count(DISTINCT key) AS keys FROM log WHERE txn_id IS NOT NULL GROUP BY 1")
def kv_replay_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tt.replay_counts(log_of(spark, sf))


@REGISTRY.query("kv_snapshots", f"WITH {_LOG} SELECT DISTINCT txn_id FROM log WHERE txn_id IS NOT NULL UNION SELECT 0")
def kv_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return tt.snapshots(log_of(spark, sf))


@REGISTRY.query("kv_retained_snapshots", f"WITH {_LOG}, s AS (SELECT DISTINCT txn_id FROM log WHERE txn_id IS NOT NULL UNION SELECT 0), m AS (SELECT max(txn_id) AS top FROM s) SELECT txn_id FROM s, m WHERE txn_id = 0 OR NOT (top - txn_id >= 50 AND txn_id < top - 100)")
def kv_retained_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return tt.retained_snapshots(log_of(spark, sf), 100, 50)


@REGISTRY.query(
    "kv_read_your_writes",
    f"""WITH {_LOG}, {_ENDS}, {_as_of_end('s', 'early')}, pending AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age FROM log WHERE txn_id > (SELECT early FROM ends) AND txn_id <= (SELECT mid FROM ends) AND key IS NOT NULL)
    SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM pending WHERE age = 1 AND op = 'put'
    UNION ALL SELECT hex(key), hex(value) FROM s WHERE key NOT IN (SELECT key FROM pending)""",
)
def kv_read_your_writes(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    early, mid, _ = _ends(spark, sf)
    # The later transactions stand for a writer's pending mutations; seq is an int, so the sum keeps its order.
    pending = log.where((F.col("txn_id") > early) & (F.col("txn_id") <= mid)).select((F.col("txn_id") * 2**31 + F.col("seq")).alias("seq"), "op", "key", "value")
    return _hexed(tt.overlay(tt.as_of(log, early, check=False), pending))


@REGISTRY.query("kv_compacted", f"WITH {_LOG}, {_ENDS}, {_as_of_end('s', 'mid')} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq, 'put' AS op FROM s UNION ALL SELECT hex(key), hex(value), txn_id, seq, op FROM log WHERE txn_id > (SELECT mid FROM ends)")
def kv_compacted(spark: SparkSession, sf: str) -> DataFrame:
    _, mid, _ = _ends(spark, sf)
    return _hexed(tt.compact(log_of(spark, sf), mid), "txn_id", "seq", F.lower(F.trim("op")).alias("op"))


@REGISTRY.query("kv_replica_lag", f"WITH {_LOG}, {_ENDS} SELECT DISTINCT txn_id FROM log WHERE txn_id > (SELECT mid FROM ends)")
def kv_replica_lag(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    _, mid, _ = _ends(spark, sf)
    return tt.unapplied(log, tt.snapshots(log.where(F.col("txn_id") <= mid)))


@REGISTRY.query(
    "kv_entities",
    f"""WITH {_LOG}, {_as_of('s', None)} SELECT split_part(k, ':', 1) AS entity_type, count(*) AS entities FROM (SELECT TRY_CAST(key AS VARCHAR) AS k, hex(key) AS h FROM s)
    WHERE regexp_matches(h, '^(6[1-9A-F]|7[0-9A])+3A([3][0-9])') AND regexp_matches(k, '^[a-z]+:[0-9]+(:[0-9]+)?$') GROUP BY 1""",
)
def kv_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities named by keys of the form ``type:id``."""
    text = F.col("key").cast("string")
    keys = tt.as_of(log_of(spark, sf)).where(text.rlike("^[a-z]+:[0-9]+(:[0-9]+)?$"))
    return keys.groupBy(F.split_part(text, F.lit(":"), F.lit(1)).alias("entity_type")).agg(F.count("*").alias("entities"))


# --- the second half of the log ----------------------------------------------------------------------------------------------------------


@REGISTRY.query("kv_snapshot_as_of_last", f"WITH {_LOG}, {_ENDS}, {_as_of_end('s', 'top')} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM s")
def kv_snapshot_as_of_last(spark: SparkSession, sf: str) -> DataFrame:
    _, _, top = _ends(spark, sf)
    return _hexed(tt.as_of(log_of(spark, sf), top), "txn_id", "seq")


@REGISTRY.query(
    "kv_snapshot_diff_half",
    f"""WITH {_LOG}, {_ENDS}, {_as_of_end('a', 'mid')}, {_as_of_end('b', 'top')}
    SELECT hex(coalesce(a.key, b.key)) AS key_hex, hex(a.value) AS old_hex, hex(b.value) AS new_hex,
           CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.value IS DISTINCT FROM b.value""",
)
def kv_snapshot_diff_half(spark: SparkSession, sf: str) -> DataFrame:
    _, mid, top = _ends(spark, sf)
    diff = tt.changes_between(log_of(spark, sf), mid, top)
    return diff.select(F.hex("key").alias("key_hex"), F.hex("old_value").alias("old_hex"), F.hex("new_value").alias("new_hex"), "change_kind")


@REGISTRY.query(
    "kv_read_your_writes_half",
    f"""WITH {_LOG}, {_ENDS}, {_as_of_end('s', 'mid')}, pending AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY txn_id DESC, seq DESC) AS age FROM log WHERE txn_id > (SELECT mid FROM ends) AND key IS NOT NULL)
    SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM pending WHERE age = 1 AND op = 'put'
    UNION ALL SELECT hex(key), hex(value) FROM s WHERE key NOT IN (SELECT key FROM pending)""",
)
def kv_read_your_writes_half(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    _, mid, _ = _ends(spark, sf)
    # The later half of the log stands for a writer's pending mutations; seq is an int, so the sum keeps its order.
    pending = log.where(F.col("txn_id") > mid).select((F.col("txn_id") * 2**31 + F.col("seq")).alias("seq"), "op", "key", "value")
    return _hexed(tt.overlay(tt.as_of(log, mid, check=False), pending))


# --- the write side --------------------------------------------------------------------------------------------------------------------


def _new_log(spark: SparkSession, sf: str) -> CommitLog:
    """A log of one's own that holds the whole table."""
    log = CommitLog(spark, f"{ensure_checkpoint_dir(spark)}/logs/{uuid.uuid4()}")
    log.append(log_of(spark, sf).where("txn_id is not null and seq is not null"))
    return log


_WRITTEN = f"""WITH {_LOG}, {_as_of('s', None)}, m AS (SELECT max(txn_id) AS top FROM log) SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM s WHERE seq IS NOT NULL AND key NOT IN (CAST('task:9' AS BLOB), CAST('task:1' AS BLOB))
    UNION ALL SELECT hex('task:9'), hex('new'), top + 1, 0 FROM m"""


@REGISTRY.query("kv_commit_roundtrip", _WRITTEN)
def kv_commit_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The state after a transaction that writes one key and deletes another, read back from the log's files."""
    log = _new_log(spark, sf)
    txn = log.begin()
    txn.put(b"task:9", b"new")
    txn.delete(b"task:1")
    txn.commit()
    return _hexed(log.read(), "txn_id", "seq")


@REGISTRY.query("kv_abort", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex FROM s WHERE seq IS NOT NULL")
def kv_abort(spark: SparkSession, sf: str) -> DataFrame:
    """An aborted transaction leaves no trace."""
    log = _new_log(spark, sf)
    txn = log.begin()
    txn.put(b"task:9", b"lost")
    txn.abort()
    return _hexed(log.read())


@REGISTRY.query("kv_truncate", f"WITH {_LOG}, {_as_of('s', None)} SELECT hex(key) AS key_hex, hex(value) AS value_hex, txn_id, seq FROM s WHERE seq IS NOT NULL")
def kv_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The last snapshot, read from a copy of the log that was truncated at half of it and laid out by key."""
    log = _new_log(spark, sf)
    _, mid, _ = _ends(spark, sf)
    return _hexed(log.truncate(mid, f"{log.path}-truncated").read(), "txn_id", "seq")


@REGISTRY.query("kv_checksums", f"WITH {_LOG}, m AS (SELECT txn_id, count(*) AS n FROM log WHERE txn_id IS NOT NULL GROUP BY 1) SELECT count(*) AS transactions, CAST(sum(n) AS BIGINT) AS mutations, TRUE AS same FROM m")
def kv_checksums(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the checksums of all transactions are those of a copy that was written and read again."""
    log = log_of(spark, sf).where("txn_id is not null")
    path = f"{ensure_checkpoint_dir(spark)}/logs/{uuid.uuid4()}"
    CommitLog(spark, path).append(log)
    theirs = tt.checksum(CommitLog(spark, path).frame()).withColumnRenamed("checksum", "theirs")
    sizes = log.groupBy("txn_id").agg(F.count("*").alias("n"))
    both = tt.checksum(log).join(theirs, "txn_id", "full_outer").join(sizes, "txn_id")
    return both.agg(F.count("*").alias("transactions"), F.sum("n").alias("mutations"), F.min(F.col("checksum").eqNullSafe(F.col("theirs"))).alias("same"))
