"""State changes of entities over time.

A log of changes has ``seq, ts, entity_ns, entity_id, key, old_value, new_value`` (values as text). An entity is the pair of namespace and
id; equal times are decided by the lowest ``seq``, the change that came first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.plans.ranking import BIG_GROUP, lagged, null_safe_join, place_of, running_sums, value_blocks

ENTITY = ("entity_ns", "entity_id")


def _between(changes: DataFrame, start: Column, end: Column) -> DataFrame:
    return changes.where((F.col("ts") >= start) & (F.col("ts") <= end))


def _last(order: str = "seq") -> Column:
    """Latest time first, of equal times the first change."""
    return F.struct("ts", -F.col(order))


def as_of(changes: DataFrame, at: Column, by: Sequence[str] = ENTITY) -> DataFrame:
    """The last change of each entity up to ``at``, inclusive; with ``key`` in ``by``, of each attribute."""
    kept = [c for c in changes.columns if c not in by]
    upto = changes.where(F.col("ts") <= at).groupBy(*by).agg(F.max_by(F.struct(*kept), _last()).alias("x"))
    return upto.select(*by, *[F.col(f"x.{c}").alias(c) for c in kept])


def multi_as_of(changes: DataFrame, entities: DataFrame, at: Column) -> DataFrame:
    """One row per row of ``entities`` (``entity_ns, entity_id``, any others), with nulls where nothing had happened yet."""
    found = as_of(changes.join(entities.select(*ENTITY).distinct(), list(ENTITY), "left_semi"), at)
    return entities.join(found, list(ENTITY), "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], ts: str = "ts", seq: str = "seq", big: int = BIG_GROUP) -> DataFrame:
    """``left`` with, as struct ``match``, the last row of ``right`` of the same ``by`` up to the row's time.

    Both sides are sorted together once and the last row seen is carried forward, instead of an inequality join. A key of very many
    rows is sorted in blocks of time, and the last row of the blocks before is carried into each. Rows of ``right`` without time
    match nothing, rows of ``left`` without time have no match.
    """
    rows = [c for c in right.columns if c not in by]
    theirs = right.where(F.col(ts).isNotNull())
    a = left.select(*by, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_s"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*rows).alias("x")).schema[0].dataType).alias("_r"))
    b = theirs.select(*by, F.col(ts).alias("_t"), F.lit(0).alias("_side"), (-F.col(seq)).cast("long").alias("_s"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema[0].dataType).alias("_l"), F.struct(*rows).alias("_r"))
    both = a.unionByName(b)
    both = both.withColumn("_x", place_of(both, "_t"))
    blocked, split = value_blocks(both, by, "_x", big)
    keys = [*by, "block"]
    order = W.partitionBy(*(keys if split else by)).orderBy("_t", "_side", "_s").rowsBetween(W.unboundedPreceding, 0)
    carried = blocked.withColumn("match", F.last("_r", ignorenulls=True).over(order))
    if split:
        before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        ends = blocked.groupBy(*keys).agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_s"))).alias("_last")).withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
        carried = null_safe_join(carried, ends, keys).withColumn("match", F.coalesce("match", "_carry"))
    return carried.where("_side = 1").select(*[F.col(f"_l.{c}").alias(c) for c in left.columns], "match")


def between(changes: DataFrame, start: Column, end: Column) -> DataFrame:
    """The changes in the closed period."""
    return _between(changes, start, end)


def at_timestamp(changes: DataFrame, at: Column) -> DataFrame:
    """The changes of all entities at exactly ``at``."""
    return changes.where(F.col("ts") == at)


def first_state(changes: DataFrame) -> DataFrame:
    """The first change of each entity."""
    kept = [c for c in changes.columns if c not in ENTITY]
    return changes.where("ts is not null").groupBy(*ENTITY).agg(F.min_by(F.struct(*kept), F.struct("ts", "seq")).alias("x")).select(*ENTITY, "x.*")


def last_state(changes: DataFrame) -> DataFrame:
    """The last change of each entity."""
    kept = [c for c in changes.columns if c not in ENTITY]
    return changes.where("ts is not null").groupBy(*ENTITY).agg(F.max_by(F.struct(*kept), _last()).alias("x")).select(*ENTITY, "x.*")


def change_frequency(changes: DataFrame, start: Column, end: Column) -> DataFrame:
    """``changes, first_ts, last_ts, per_day`` of each entity with changes in the closed period."""
    grouped = _between(changes, start, end).groupBy(*ENTITY).agg(F.count("*").alias("changes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    days = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000)
    return grouped.withColumn("per_day", F.try_divide("changes", days))


def count_distinct(changes: DataFrame, start: Column, end: Column, approximate: bool = False) -> DataFrame:
    """Distinct new values of each attribute of each entity in the closed period; by a sketch, if ``approximate``."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return _between(changes, start, end).groupBy(*ENTITY, "key").agg(count("new_value").alias("distinct_values"))


def numeric(changes: DataFrame) -> DataFrame:
    """The changes whose new value is a number, with it as ``value``; others are skipped."""
    return changes.withColumn("value", F.col("new_value").try_cast("double")).where("value is not null and not isnan(value)")


def rates(changes: DataFrame, start: Column, end: Column, per_seconds: int, big: int = BIG_GROUP) -> DataFrame:
    """``avg_rate, max_rate, min_rate, steps`` of each attribute: change of value per ``per_seconds`` between neighbours in time."""
    timed = numeric(_between(changes, start, end)).select(*ENTITY, "key", "ts", "seq", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    pairs = lagged(timed, [*ENTITY, "key"], ["ts", "seq"], {"value": "before", "at": "since"}, big)
    steps = pairs.select(*ENTITY, "key", (F.col("value") - F.col("before")).alias("dv"), (F.col("at") - F.col("since")).alias("dt"))
    rate = F.col("dv") / (F.col("dt") / F.lit(1e6)) * F.lit(float(per_seconds))
    return steps.where("dt > 0").withColumn("rate", rate).groupBy(*ENTITY, "key").agg(F.avg("rate").alias("avg_rate"), F.max("rate").alias("max_rate"), F.min("rate").alias("min_rate"), F.count("*").alias("steps"))


def threshold_violations(changes: DataFrame, start: Column, end: Column, upper: float | None, lower: float | None) -> DataFrame:
    """Each numeric change above ``upper`` or below ``lower``: ``kind`` and ``severity``, the excess over the threshold's size."""
    rows = numeric(_between(changes, start, end))
    v = F.col("value")
    cases = []
    if upper is not None:
        cases.append(F.when(v > upper, F.struct(F.lit("above").alias("kind"), F.try_divide(v - F.lit(float(upper)), F.lit(abs(float(upper)))).alias("severity"))))
    if lower is not None:
        cases.append(F.when(v < lower, F.struct(F.lit("below").alias("kind"), F.try_divide(F.lit(float(lower)) - v, F.lit(abs(float(lower)))).alias("severity"))))
    return rows.withColumn("x", F.explode(F.filter(F.array(*cases), lambda c: c.isNotNull()))).select(*changes.columns, "value", "x.kind", "x.severity")


# --- captures of whole states ----------------------------------------------------------------------------------------------


def snapshot_as_of(snapshots: DataFrame, at: Column, keys: Sequence[str]) -> DataFrame:
    """The snapshot of each entity with the greatest time up to ``at``, of equal times the greatest version."""
    kept = [c for c in snapshots.columns if c not in keys]
    return snapshots.where(F.col("ts") <= at).groupBy(*keys).agg(F.max_by(F.struct(*kept), F.struct("ts", "version", "received_at", "id")).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in kept])


def numbered_snapshots(captures: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, big: int = BIG_GROUP) -> DataFrame:
    """Captures, cut or cheap to read, as a chain: ``chain_version`` from 1 in ``order``, and ``chain_parent``, the id of the one before.

    The first of ``order`` is a time or number, by which long chains are taken in blocks.
    """
    linked = lagged(captures, keys, order, {id_column: "chain_parent"}, big).withColumn("_x", place_of(captures, order[0])).withColumn("_one", F.lit(1))
    blocked, split = value_blocks(linked, keys, "_x", big)
    return running_sums(blocked, keys, order, {"_one": "chain_version"}, split).withColumn("chain_version", F.col("chain_version").cast("int")).drop("_x", "_one", "block")


def field_delta(older: Column, newer: Column) -> Column:
    """The top-level fields in which two JSON objects differ: array of ``field, change``, ordered by field.

    ``change`` is added, removed or modified; values are compared as JSON values, so that nested order, blanks and escapes don't
    matter, but types do. A text that isn't an object has no fields.
    """
    fields = lambda text: F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    json = lambda v: F.concat_ws(":", F.schema_of_variant(v), F.to_json(v))
    a, b = F.transform_values(fields(older), lambda _, v: json(v)), F.transform_values(fields(newer), lambda _, v: json(v))
    kind = F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), "added").when(y.isNull(), "removed").when(x != y, "modified"))
    return F.array_sort(F.transform(F.filter(F.map_entries(kind), lambda e: e["value"].isNotNull()), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("change"))))


def retained(changes: DataFrame, now: Column, raw_days: int = 30, total_days: int = 90, sample: float = 0.1) -> DataFrame:
    """What a retention policy keeps: all of ``raw_days``, a share of what is older, nothing older than ``total_days``.

    The share is chosen by a hash of the id, alike on every run.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    sampled = F.pmod(F.xxhash64("seq"), F.lit(1000)) < F.lit(int(sample * 1000))
    return changes.where((age <= total_days * day) & ((age <= raw_days * day) | sampled))
