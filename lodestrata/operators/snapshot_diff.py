"""What changed between full snapshots: one aggregation over both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from lodestrata.functions.jsonstate import state_hash
from lodestrata.plans.bounded import broadcast_if_bounded
from lodestrata.plans.lineage import cut


def neighbouring_changes(
    deliveries: DataFrame,
    number: str = "delivery_no",
    keys: Sequence[str] = ("entity_namespace", "entity_local_id"),
    state: str = "state_data",
    arrived: str | None = "delivered_at",
    keep_state: bool = False,
) -> DataFrame:
    """The records added, removed and changed in each delivery against the nearest earlier one that is present.

    Each row stands once as the newer side of its own delivery and once as the older side of the next; one shuffle groups
    by delivery and key, after a map-side merge, and the hashes of both sides classify the record. The list of deliveries, made in a
    scan of that column alone, is broadcast if it is short, as it is but for hundreds of thousands of deliveries. Columns:
    the number, the keys and ``change_kind`` (``added``, ``removed``, ``changed``), with ``keep_state`` also ``old_state`` and
    ``new_state``.

    States are compared as JSON values; a null state equals only a null state. Of several rows of a key in a delivery the one
    that ``arrived`` last holds, of equal ones the one with the greatest hash. Null keys are keys like any other; rows without a
    number are ignored. The first delivery has no changes; an empty table gives an empty result.
    """
    # The order of arrival decides between repeats; the hash is computed once per row, before the shuffle.
    narrow = deliveries.select(
        deliveries[number].alias("no"),
        F.struct(*[deliveries[k].alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"),
        F.struct(
            (F.lit(0) if arrived is None else deliveries[arrived]).alias("arrived"),
            state_hash(deliveries[state]).alias("hash"),
            *([deliveries[state].alias("state")] if keep_state else []),
        ).alias("row"),
    ).where("no is not null")
    # As many rows as deliveries. Joined by a shuffle, each delivery would be one task's, and all rows would move twice.
    following = cut(narrow.select("no").distinct()).select("no", F.lead("no").over(W.orderBy("no")).alias("next"), F.lag("no").over(W.orderBy("no")).alias("before"))
    both = narrow.join(broadcast_if_bounded(following), "no").select(
        F.explode(
            F.array(
                F.when(F.col("before").isNotNull(), F.struct(F.col("no").alias("at"), F.lit(True).alias("newer"))),
                F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), F.lit(False).alias("newer"))),
            )
        ).alias("side"),
        "key",
        "row",
    ).where("side is not null")
    new, old = F.when(F.col("side.newer"), F.col("row")), F.when(~F.col("side.newer"), F.col("row"))
    sides = both.groupBy("side.at", "key").agg(F.max(new).alias("new"), F.max(old).alias("old"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old.hash") != F.col("new.hash"), "changed")
    )
    return (
        sides.withColumn("change_kind", kind)
        .where("change_kind is not null")
        .select(
            F.col("at").alias(number),
            *[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)],
            "change_kind",
            *([F.col("old.state").alias("old_state"), F.col("new.state").alias("new_state")] if keep_state else []),
        )
    )
