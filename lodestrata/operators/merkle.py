"""History of changing attributes: hash trees over key buckets, compared snapshot by snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.functions.jsonstate import state_hash
from lodestrata.plans.lineage import cut
from lodestrata.plans.ranking import BIG_GROUP, value_blocks

#: A node of the tree has 2**FAN_BITS children; a leaf bucket has about LEAF_KEYS keys, within the limits of the depth.
FAN_BITS, LEAF_KEYS, DEPTHS = 4, 16, (2, 8)
#: Captures of one key beyond which its chain is taken in blocks.
BIG = BIG_GROUP


def depth_for(keys: int) -> int:
    """The depth of a tree over so many keys: were it fixed, a leaf of a large table would hold so many keys that all leaves differ."""
    depth = DEPTHS[0]
    while depth < DEPTHS[1] and keys > LEAF_KEYS << (FAN_BITS * depth):
        depth += 1
    return depth


def _leaf(key: Column, depth: int) -> Column:
    """The leaf bucket of a key: the top bits of its hash, so that a node's bucket is a prefix of its children's."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("bucket"), key), 64 - FAN_BITS * depth)


def _up(bucket: Column, levels: int) -> Column:
    return F.shiftrightunsigned(bucket, FAN_BITS * levels)


def differing_leaves(rows: DataFrame, depth: int) -> DataFrame:
    """The leaf buckets (``at, leaf``) in which two snapshots differ, for any number of comparisons at once.

    ``rows`` has ``at`` (the comparison), ``newer`` (the side), ``key``, ``hash``; within a side keys are unique. Leaf digests are
    made in one map-side merged aggregation, digests of a level from those of the level below; the comparison then starts at
    the roots and descends only from nodes whose digests differ.
    """
    sides = rows.groupBy("at", _leaf(F.col("key"), depth).alias("node")).agg(
        *[F.bit_xor(F.xxhash64(F.lit(seed), F.col("key"), F.col("hash"))).alias(f"d{seed}") for seed in (1, 2)],
        F.sum(F.when(F.col("newer"), 1).otherwise(-1)).alias("surplus"),
    )  # equal rows of both sides cancel out in the xor
    levels = [sides]
    for _ in range(depth):
        below = levels[-1]
        # A parent's digest hashes its children's: xor of the raw digests would let equal differences of two children cancel out.
        levels.append(
            below.groupBy("at", _up(F.col("node"), 1).alias("node")).agg(
                *[F.bit_xor(F.when(F.expr("d1 = 0 and d2 = 0 and surplus = 0"), 0).otherwise(F.xxhash64(F.lit(seed), "node", "d1", "d2", "surplus"))).alias(f"e{seed}") for seed in (1, 2)],
            ).select("at", "node", F.col("e1").alias("d1"), F.col("e2").alias("d2"), F.lit(0).cast("long").alias("surplus"))
        )
    differs = F.expr("d1 != 0 or d2 != 0 or surplus != 0")
    open_nodes = levels[-1].where(differs).select("at", "node")
    for level in reversed(levels[:-1]):
        parents = open_nodes.withColumnRenamed("node", "parent")
        open_nodes = level.where(differs).withColumn("parent", _up(F.col("node"), 1)).join(parents, ["at", "parent"], "left_semi").select("at", "node")
    return open_nodes.withColumnRenamed("node", "leaf")


def diff_rows(rows: DataFrame, depth: int) -> DataFrame:
    """``at, key, old, new`` of the keys that differ between the sides of a comparison, read from differing leaf buckets only.

    ``old`` and ``new`` are the structs in the column ``row``, null where the side lacks the key.
    """
    leaves = differing_leaves(rows, depth)
    # One entry per comparison and differing bucket; the semi join is broadcast by the optimizer where statistics allow.
    touched = rows.withColumn("leaf", _leaf(F.col("key"), depth)).join(leaves, ["at", "leaf"], "left_semi")
    sides = touched.groupBy("at", "key").agg(
        F.max(F.when(~F.col("newer"), F.struct("hash", "row"))).alias("old"),
        F.max(F.when(F.col("newer"), F.struct("hash", "row"))).alias("new"),
    )
    return sides.where(~F.col("old.hash").eqNullSafe(F.col("new.hash"))).select("at", "key", F.col("old.row").alias("old"), F.col("new.row").alias("new"))


def append_snapshot(history: DataFrame, previous: DataFrame, current: DataFrame, at: Column, depth: int | None = None, hashed: str | None = None) -> DataFrame:
    """``history`` with what ``current``, a full snapshot taken ``at``, brings against the snapshot ``previous``.

    Snapshots have ``key`` and ``state``; ``history`` has ``key, state, valid_from, valid_to``. A key's open version is closed where its
    state changed or it disappeared; a new version is opened where it changed or appeared. Keys are unique in a snapshot and
    compare as values; null states are states. The tree is as deep as the number of keys asks for, if ``depth`` isn't given.
    A snapshot that is kept with the :func:`state_hash` of its rows names that column as ``hashed``, so that no state is read twice.
    """
    depth = depth_for(current.count()) if depth is None else depth
    side = lambda df, newer: df.select(F.lit(0).alias("at"), F.lit(newer).alias("newer"), df["key"], (state_hash(df["state"]) if hashed is None else df[hashed]).alias("hash"), F.struct(df["state"]).alias("row"))
    changed = diff_rows(side(previous, False).unionByName(side(current, True)), depth)
    closed = changed.where("old is not null").select("key", F.lit(True).alias("closes"))
    opened = changed.where("new is not null").select("key", F.col("new.state").alias("state"), at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    kept = history.join(closed, "key", "left").select(
        "key", "state", "valid_from", F.when(F.col("valid_to").isNull() & F.col("closes"), at).otherwise(F.col("valid_to")).alias("valid_to")
    )
    return kept.unionByName(opened)


def _chains(rows: DataFrame, key: str, version: str, most: int) -> tuple[DataFrame, list[str], bool]:
    """``rows`` with ``block``, the columns that hold a window over a stretch of a key's chain, and whether chains have several.

    ``most`` bounds the rows of a key. Up to BIG they are one window's; longer chains are cut at quantiles of their versions, however these
    are spread, and ``rows`` is cut before.
    """
    if most <= BIG:
        return rows.withColumn("block", F.lit(0)), [key], False
    blocked, split = value_blocks(cut(rows), [key], version, BIG)
    return blocked, [key, "block"], split


def _rounds(captures: DataFrame, most: int) -> DataFrame:
    """``captures`` (``key, version`` unique) with ``round``, the capture's place in its key's order, and ``final``."""
    blocked, within, split = _chains(captures, "key", "version", most)
    inside = W.partitionBy(*within).orderBy("version")
    numbered = blocked.withColumn("round", F.row_number().over(inside).cast("long")).withColumn("final", F.lead("version").over(inside).isNull())
    if not split:
        return numbered.drop("block")
    sizes = blocked.groupBy("key", "block").agg(F.count("*").alias("size"))
    along = W.partitionBy("key").orderBy("block")
    starts = sizes.select("key", "block", F.coalesce(F.sum("size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.lead("block").over(along).isNull().alias("closing"))
    return numbered.join(starts, ["key", "block"]).withColumn("round", F.col("start") + F.col("round")).withColumn("final", F.col("final") & F.col("closing")).drop("block", "start", "closing")


def changed_versions(
    captures: DataFrame,
    keys: Sequence[str] = ("entity_namespace", "entity_local_id"),
    version: str = "version",
    ts: str = "ts",
    state: str = "state_data",
    received: str = "received_at",
    branch: str | None = "branch_id",
    depth: int | None = None,
    keep_state: bool = True,
) -> DataFrame:
    """Each version of a key whose state differs from the version before it: the keys, ``version, ts`` and, if kept, ``state``.

    The n-th captures of all keys form the n-th snapshot. Each snapshot is compared with the one before it over the keys it
    holds, by hash trees over key buckets; only differing leaf buckets are read again. First versions are always cases.

    Only rows with a null branch count (any, if ``branch`` is None), and only rows with a version. Of several rows of one key and
    version the one received last holds, of equal ones that with the greatest hash, time and text. Keys with null parts are
    keys; null states equal only null states; versions may have gaps. An empty table gives an empty result. A first count gives the
    number of keys, which sets the depth of the trees if ``depth`` doesn't, and the length of the longest chain.
    """
    main = captures if branch is None else captures.where(captures[branch].isNull())
    rows = main.select(
        F.struct(*[main[k].alias(f"k{i}") for i, k in enumerate(keys)]).alias("key"),
        main[version].alias("version"),
        F.struct(main[received].alias("received"), state_hash(main[state]).alias("hash"), main[ts].alias("ts"), (main[state] if keep_state else F.lit(None).cast("string")).alias("state")).alias("row"),
    ).where("version is not null")
    count = main.groupBy(*[main[k] for k in keys]).count().agg(F.count("*").alias("keys"), F.max("count").alias("most")).first()
    if (count["most"] or 0) <= BIG:
        rows = rows.repartition("key")  # both steps that follow then find a key's rows in place
    once = rows.groupBy("key", "version").agg(F.max("row").alias("row")).select("key", "version", F.col("row.hash").alias("hash"), F.struct("version", "row.ts", "row.state").alias("row"))
    # Read twice, by the trees and by the rows of differing leaves; cut, as parsing the states is what costs.
    rounds = cut(_rounds(once, count["most"] or 0))
    # A capture is the newer side of its own round and, unless it is the last, the older side of the next.
    sides = rounds.select(
        F.explode(F.array(F.struct(F.col("round").alias("at"), F.lit(True).alias("newer")), F.when(~F.col("final"), F.struct((F.col("round") + 1).alias("at"), F.lit(False).alias("newer"))))).alias("side"),
        "key", "hash", "row",
    ).where("side is not null").select("side.at", "side.newer", "key", "hash", "row")
    return diff_rows(sides, depth_for(count["keys"]) if depth is None else depth).where("new is not null").select(
        *[F.col(f"key.k{i}").alias(k) for i, k in enumerate(keys)], F.col("new.version").alias(version), F.col("new.ts").alias(ts), *([F.col("new.state").alias(state)] if keep_state else [])
    )


def validity(changes: DataFrame, keys: Sequence[str] = ("entity_namespace", "entity_local_id"), version: str = "version", ts: str = "ts") -> DataFrame:
    """``changes`` with ``valid_from``, ``valid_to`` (open for the last version, the end excluded) and ``is_current``.

    Where clocks disagree with versions, a version begins at the greatest time of the versions up to it, so that periods never
    overlap; a version that a later one overtook in the same instant has an empty period. A null time leaves the
    beginning to the versions before. A key's versions are unique; a busy key's are taken in blocks.
    """
    rows = cut(changes.select(F.struct(*keys).alias("_key"), F.col(version).alias("_v"), F.col(ts).alias("_t"), F.struct(*changes.columns).alias("_row")))
    most = rows.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
    blocked, within, split = _chains(rows, "_key", "_v", most)
    inside = W.partitionBy(*within).orderBy("_v")
    from_ = F.max("_t").over(inside.rowsBetween(W.unboundedPreceding, 0))
    if not split:
        begun = blocked.withColumn("valid_from", from_)
        return begun.select("_row.*", "valid_from", F.lead("valid_from").over(inside).alias("valid_to"), F.lead("_v").over(inside).isNull().alias("is_current"))
    along = W.partitionBy("_key").orderBy("block")
    ends = blocked.groupBy("_key", "block").agg(F.max("_t").alias("top"), F.min_by("_t", "_v").alias("first")).withColumn("before", F.max("top").over(along.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.withColumn("begun", F.greatest("first", "before")).select("_key", "block", "before", F.lead("begun").over(along).alias("next"), F.lead("block").over(along).isNull().alias("closing"))
    begun = blocked.join(ends, ["_key", "block"]).withColumn("valid_from", F.greatest(from_, F.col("before"))).withColumn("_ends", F.lead("_v").over(inside).isNull())
    until = F.when(F.col("_ends"), F.col("next")).otherwise(F.lead("valid_from").over(inside))
    return begun.withColumn("valid_to", until).select("_row.*", "valid_from", "valid_to", (F.col("_ends") & F.col("closing")).alias("is_current"))
