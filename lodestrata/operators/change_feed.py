"""Applying a feed of inserts, updates and deletes in the order of commit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def latest_changes(feed: DataFrame) -> DataFrame:
    """The last change of each key: ``key, txn_id, seq, deleted, value``.

    ``feed`` has ``txn_id, seq, op, key, value, feed_offset``. Rows with equal (``txn_id``, ``seq``) are one change, of which the
    first delivered holds. ``op`` counts in lower case without surrounding blanks: ``put``, or ``del``/``delete``; rows with another or
    no ``op``, or without key, ``txn_id`` or ``seq``, are no changes. The window's rank limit is applied before the shuffle
    too, so that a busy key sends one row per task.
    """
    op = F.lower(F.trim(feed["op"]))
    changes = feed.select(
        feed["txn_id"], feed["seq"], op.isin("del", "delete").alias("deleted"), feed["key"], feed["value"], feed["feed_offset"]
    ).where(op.isin("put", "del", "delete") & feed["key"].isNotNull() & feed["txn_id"].isNotNull() & feed["seq"].isNotNull())
    first = F.row_number().over(W.partitionBy("txn_id", "seq").orderBy(F.col("feed_offset").asc_nulls_last(), "key", "deleted", "value"))
    once = changes.withColumn("copy", first).where("copy = 1").drop("copy", "feed_offset")
    last = F.row_number().over(W.partitionBy("key").orderBy(F.col("txn_id").desc(), F.col("seq").desc()))
    return once.withColumn("age", last).where("age = 1").select("key", "txn_id", "seq", "deleted", "value")


def apply_feed(feed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """The state after the feed: ``key, value, txn_id, seq`` of each key whose last change is a put.

    A put with an empty or null value is a put. ``base`` is an earlier state with the same columns; its rows give way to later
    changes of their key, are dropped by later deletes, and outlive changes that are older than they are. Null keys of the base
    are dropped.
    """
    last = latest_changes(feed)
    if base is None:
        return last.where("not deleted").select("key", "value", "txn_id", "seq")
    change = F.struct(last["txn_id"], last["seq"], last["deleted"], last["value"])
    changed = last.select("key", change.alias("change"))
    kept = base.where(base["key"].isNotNull()).select("key", F.struct(base["txn_id"], base["seq"], F.lit(False).alias("deleted"), base["value"]).alias("was"))
    order = lambda c: F.struct(F.col(f"{c}.txn_id"), F.col(f"{c}.seq"))
    won = F.when(F.col("was").isNull() | (F.col("change").isNotNull() & (order("change") >= order("was"))), F.col("change")).otherwise(F.col("was"))
    return (
        changed.join(kept, "key", "full_outer")
        .select("key", won.alias("now"))
        .where("not now.deleted")
        .select("key", "now.value", "now.txn_id", "now.seq")
    )
