"""Snapshots of an append-only commit log.

A log has ``txn_id, seq, op, key, value``; ``op`` is ``put`` or ``del``. Within a transaction the later ``seq`` wins. Snapshot 0 is
the empty genesis. Keys are BINARY or STRING and sort by unsigned bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


class SnapshotNotFound(LookupError):
    """The transaction asked for was never committed."""


def snapshots(log: DataFrame) -> DataFrame:
    """The committed transactions, with genesis: ``txn_id``."""
    return log.select("txn_id").where("txn_id is not null").union(log.sparkSession.range(1).select(F.lit(0).cast("long"))).distinct()


def latest_snapshot(log: DataFrame) -> int:
    """The greatest committed transaction, 0 for an empty log."""
    return log.agg(F.max("txn_id")).first()[0] or 0


def has_snapshot(log: DataFrame, txn_id: int) -> bool:
    return txn_id == 0 or not log.where(F.col("txn_id") == txn_id).isEmpty()


def as_of(log: DataFrame, txn_id: int | None = None, check: bool = True) -> DataFrame:
    """The live keys after transaction ``txn_id``, inclusive (None: all): ``key, value, txn_id, seq``.

    Raises :class:`SnapshotNotFound` for a transaction that isn't in the log, past or future, unless ``check`` is off. Rows without key or
    transaction are ignored; deleting an absent key does nothing; an empty or null value is a value.
    """
    if txn_id is not None and check and not has_snapshot(log, txn_id):
        raise SnapshotNotFound(txn_id)
    upto = log.where("key is not null and txn_id is not null" if txn_id is None else f"key is not null and txn_id <= {int(txn_id)}")
    put = F.lower(F.trim("op")) == "put"
    newest = F.row_number().over(W.partitionBy("key").orderBy(F.desc("txn_id"), F.desc("seq")))
    # The rank limit works before the shuffle too: a busy key sends one row per task.
    return upto.select("key", "value", "txn_id", "seq", put.alias("put"), newest.alias("age")).where("age = 1").where("put").select("key", "value", "txn_id", "seq")


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above all keys with ``prefix``; None if there is none (a prefix of only 0xFF)."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def key_range(state: DataFrame, start: bytes | str | None = None, end: bytes | str | None = None, end_inclusive: bool = False) -> DataFrame:
    """The keys in [start, end), or [start, end], in order. The bounds reach the scan of a sorted table."""
    if start is not None:
        state = state.where(F.col("key") >= F.lit(start))
    if end is not None:
        state = state.where(F.col("key") <= F.lit(end) if end_inclusive else F.col("key") < F.lit(end))
    return state.orderBy("key")


def key_prefix(state: DataFrame, prefix: bytes) -> DataFrame:
    """The keys that begin with ``prefix``, in order, as a range."""
    return key_range(state, prefix or None, prefix_end(prefix))


def overlay(state: DataFrame, pending: DataFrame) -> DataFrame:
    """What a writer reads: ``state`` under its own ``pending`` mutations (``seq, op, key, value``), the last per key."""
    mine = pending.select(F.lit(2**63 - 1).alias("txn_id"), "seq", "op", "key", "value")
    base = state.select("txn_id", F.coalesce("seq", F.lit(0)).alias("seq"), F.lit("put").alias("op"), "key", "value")
    return as_of(base.unionByName(mine), check=False).select("key", "value")


def changes_between(log: DataFrame, older: int, newer: int) -> DataFrame:
    """``key, old_value, new_value, change_kind`` of the keys whose value differs between two snapshots."""
    a = as_of(log, older).select("key", F.struct("value").alias("a"))
    b = as_of(log, newer).select("key", F.struct("value").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a.value").eqNullSafe(F.col("b.value")), "changed")
    joined = a.join(b, "key", "full_outer").select("key", F.col("a.value").alias("old_value"), F.col("b.value").alias("new_value"), kind.alias("change_kind"))
    return joined.where("change_kind is not null")


def states_equal(log: DataFrame, one: int, other: int) -> bool:
    """Whether two snapshots hold the same keys and values."""
    return changes_between(log, one, other).isEmpty()


def replay_counts(log: DataFrame) -> DataFrame:
    """``txn_id, puts, deletes, keys`` of each transaction."""
    op = F.lower(F.trim("op"))
    return log.where("txn_id is not null").groupBy("txn_id").agg(F.count_if(op == "put").alias("puts"), F.count_if(op.isin("del", "delete")).alias("deletes"), F.countDistinct("key").alias("keys"))


def retained_snapshots(log: DataFrame, keep_txns: int, keep_count: int) -> DataFrame:
    """The snapshots that a clean-up keeps: genesis, and those near enough to the latest.

    One goes if it is at least ``keep_count`` behind the latest and, with ``keep_txns``, older than that many transactions; none goes
    while there are no more than ``keep_count``.
    """
    all_of = snapshots(log)
    top, n = latest_snapshot(log), all_of.count()
    if n <= keep_count:
        return all_of
    old = (F.lit(top) - F.col("txn_id") >= keep_count) & (F.lit(keep_txns == 0) | (F.col("txn_id") < top - keep_txns))
    return all_of.where((F.col("txn_id") == 0) | ~old)


def compact(log: DataFrame, upto: int) -> DataFrame:
    """A log with the same snapshots from ``upto`` on: what is live then as puts, and all later rows."""
    live = as_of(log, upto, check=False).select("txn_id", "seq", F.lit("put").alias("op"), "key", "value")
    return live.unionByName(log.where(F.col("txn_id") > upto).select("txn_id", "seq", "op", "key", "value"))


def unapplied(log: DataFrame, applied: DataFrame) -> DataFrame:
    """Transactions in the log that a replica (``txn_id``) has not applied; its lag is their number."""
    return snapshots(log).join(applied, "txn_id", "left_anti")


def checksum(log: DataFrame) -> DataFrame:
    """``txn_id, checksum``: CRC-32 of each transaction's mutations in order, null values told from empty ones."""
    row = F.concat_ws("|", F.lower(F.trim("op")), F.hex(F.col("key").cast("binary")), F.coalesce(F.hex(F.col("value").cast("binary")), F.lit("null")))
    # A transaction is bounded in operations, so its list is too.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("row")))), lambda x: x["row"])
    return log.where("txn_id is not null").groupBy("txn_id").agg(F.crc32(F.array_join(ordered, "\n").cast("binary")).alias("checksum"))
