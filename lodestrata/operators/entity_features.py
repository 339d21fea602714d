"""Per-entity feature table from events: two-stage salted aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Entity-type groups that the heavy-hitter sketch may name at most, which bounds what is collected and broadcast.
MAX_HEAVY_GROUPS = 1_000


def normal_type(column: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.btrim(column, F.lit(" \t\n\x0b\f\r")))


def _heavy_groups(events: DataFrame, share: float) -> list[tuple]:
    """The (entity, type) groups that hold at least ``share`` of the rows, from a sketch of bounded size."""
    row = events.agg(
        F.expr(f"approx_top_k(xxhash64(entity, kind), {MAX_HEAVY_GROUPS}, {MAX_HEAVY_GROUPS * 8})").alias("top"),
        F.count("*").alias("n"),
    ).first()
    return [(x["item"],) for x in row["top"] or [] if x["count"] >= max(2, share * row["n"])]


def entity_type_stats(
    events: DataFrame,
    entity: str = "actor_id",
    kind: str = "event_type",
    ts: str = "ts",
    event_id: str = "event_id",
    value: Column | None = None,
    salts: int = 64,
    heavy_share: float = 0.0005,
) -> DataFrame:
    """One row per entity and event type that occur together: ``entity, kind, n, first_ts, last_ts, last_event_id, total``.

    Stage one shuffles each event once, by entity, type and salt, and there drops repeated deliveries and merges what is
    left into partial statistics; only groups that a bounded sketch finds heavy are spread over ``salts`` parts, by the
    event's id, so that copies of an event meet. Stage two merges the few parts of each group. Heaviness steers only where
    rows go, never what comes out.

    Rows without entity, type, time or id do not count; nor do blank types differ from a type named ``''``. Copies of an
    event that disagree count once per entity and type, with the greatest time and value. ``value`` is summed as DOUBLE, nulls
    as nothing. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    narrow = events.select(
        events[entity].alias("entity"),
        normal_type(events[kind]).alias("kind"),
        events[ts].alias("ts"),
        events[event_id].alias("event_id"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    ).where("entity is not null and kind is not null and ts is not null and event_id is not null")
    spark = events.sparkSession
    heavy = _heavy_groups(narrow, heavy_share)
    if heavy:
        hot = F.broadcast(spark.createDataFrame(heavy, "group long").withColumn("hot", F.lit(True)))
        salted = narrow.withColumn("group", F.xxhash64("entity", "kind")).join(hot, "group", "left").drop("group")
        salt = F.when(F.col("hot"), F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int")).otherwise(0)
        salted = salted.withColumn("salt", salt).drop("hot")
    else:
        salted = narrow.withColumn("salt", F.lit(0))
    once = (
        salted.repartition("entity", "kind", "salt")
        .groupBy("entity", "kind", "salt", "event_id")
        .agg(F.max("ts").alias("ts"), F.max("value").alias("value"))
    )
    part = once.groupBy("entity", "kind", "salt").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first_ts"),
        F.max(F.struct("ts", "event_id")).alias("last"),
        F.sum("value").alias("total"),
    )
    return part.groupBy("entity", "kind").agg(
        F.sum("n").alias("n"),
        F.min("first_ts").alias("first_ts"),
        F.max("last.ts").alias("last_ts"),
        F.max("last").getField("event_id").alias("last_event_id"),
        F.sum("total").alias("total"),
    )


def feature_table(stats: DataFrame, types: Sequence[str], as_of: Column) -> DataFrame:
    """One row per entity: over all types, and an entry per type of the complete list, in its order.

    ``stats`` comes from :func:`entity_type_stats`; ``types`` is the complete, bounded list of types (hundreds), normalised
    and made unique here. Columns: ``entity, n_events, n_types, first_ts, last_ts, other_events`` (of types outside the list)
    and the arrays ``counts, recency_s, totals``, of the length of the list: 0, null and 0.0 for a type that the entity
    lacks. Recency is in whole seconds from the type's last event to ``as_of``.
    """
    listed = sorted({t.strip().lower() for t in types if t is not None})
    names = F.array(*[F.lit(t) for t in listed]) if listed else F.array().cast("array<string>")
    known = F.col("kind").isin(listed) if listed else F.lit(False)
    seconds = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))
    entry = F.struct(F.col("n"), F.floor(seconds / 1_000_000).alias("recency_s"), F.coalesce("total", F.lit(0.0)).alias("total"))
    # A map of at most len(types) entries per entity: bounded, whatever the number of events.
    per = stats.groupBy("entity").agg(
        F.sum("n").alias("n_events"),
        F.count("*").alias("n_types"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("other_events"),
        F.map_from_entries(F.collect_list(F.when(known, F.struct("kind", entry)))).alias("by"),
    )
    pick = lambda field, default: F.transform(names, lambda t: F.coalesce(F.try_element_at("by", t).getField(field), default))
    return per.select(
        "entity",
        "n_events",
        "n_types",
        "first_ts",
        "last_ts",
        "other_events",
        pick("n", F.lit(0).cast("long")).alias("counts"),
        pick("recency_s", F.lit(None).cast("long")).alias("recency_s"),
        pick("total", F.lit(0.0)).alias("totals"),
    )
