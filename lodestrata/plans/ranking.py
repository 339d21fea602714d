"""Ranks and prefix sums within groups of any size, in blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestrata.plans.bounded import broadcast_if_bounded
from lodestrata.plans.lineage import cut

#: Rows from which a group is split, and the number of blocks of such a group.
BIG_GROUP, BLOCKS = 100_000, 256


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which nulls are equal; the keys come from the left. Without keys the right side has one row."""
    own = [f"_k{j}" for j in range(len(keys))]
    other = right.select(*[F.col(k).alias(c) for k, c in zip(keys, own)], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, own)], F.lit(True)), how).drop(*own)


def value_blocks(df: DataFrame, groups: Sequence[str], value: str, big: int = BIG_GROUP, blocks: int = BLOCKS) -> tuple[DataFrame, bool]:
    """``df``, which must be cut or cheap to read, with ``block``, rising with ``value`` within a group, and whether any group has several.

    Groups of more than ``big`` rows are split at approximate quantiles, found by mergeable sketches. Any splits give
    exact results, as equal values share a block. Null groups are groups, and without groups all rows are one.
    """
    if not groups:
        out, split = value_blocks(df.withColumn("_all", F.lit(0)), ["_all"], value, big, blocks)
        return out.drop("_all"), split
    sizes = df.groupBy(*groups).count().where(F.col("count") > big).select(*groups)
    if sizes.isEmpty():
        return df.withColumn("block", F.lit(0)), False
    at = [i / blocks for i in range(1, blocks)]
    splits = null_safe_join(df, broadcast_if_bounded(sizes), groups, "left_semi").groupBy(*groups).agg(F.percentile_approx(value, at, 10_000).alias("splits"))
    split = null_safe_join(df, broadcast_if_bounded(splits, 10_000), groups, "left")
    block = F.when(F.col("splits").isNull(), 0).otherwise(F.size(F.filter("splits", lambda b: b < F.col(value))))
    return split.withColumn("block", block).drop("splits"), True


def range_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df``, cut, with ``block``, rising in the order of columns of any type: the partition of a range partitioning."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("block", F.spark_partition_id()))


def running_sums(df: DataFrame, groups: Sequence[str], order: Sequence, sums: dict[str, str], split: bool = True) -> DataFrame:
    """``df`` (with ``block``) with the running sum, up to and with the row, of each column of ``sums`` under its new name.

    ``order`` sorts within a block, and blocks follow one another. A window sums within each block; the sums of the blocks before
    it, one row per group and block, are added, unless no group is ``split``.
    """
    keys = [*groups, "block"]
    inside = W.partitionBy(*(keys if split else groups)).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if not split:
        return df.select("*", *[F.sum(c).over(inside).alias(new) for c, new in sums.items()])
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"{new}_t") for c, new in sums.items()])
    before = W.partitionBy(*groups).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"{new}_t").over(before), F.lit(0)).alias(f"{new}_o") for new in sums.values()])
    joined = null_safe_join(df.select("*", *[F.sum(c).over(inside).alias(f"{new}_i") for c, new in sums.items()]), offsets, keys)
    return joined.select(*df.columns, *[(F.col(f"{new}_i") + F.col(f"{new}_o")).alias(new) for new in sums.values()])


def place_of(df: DataFrame, column: str) -> Column:
    """A time or number as a double that rises with it, by which groups are split."""
    kind = df.schema[column].dataType.typeName()
    return (F.unix_micros(F.col(column).cast("timestamp")) if kind.startswith("timestamp") else F.col(column)).cast("double")


def lagged(df: DataFrame, groups: Sequence[str], order: Sequence[str], columns: dict[str, str], big: int = BIG_GROUP) -> DataFrame:
    """``df``, cut or cheap to read, with columns of the row before it in its group, under their new names; null in a group's first row.

    Groups of more than ``big`` rows are taken in blocks of the first of ``order``, a time or number, and a block's first row looks at the last
    row of the blocks before.
    """
    blocked, split = value_blocks(df.withColumn("_x", place_of(df, order[0])), groups, "_x", big)
    if not split:
        inside = W.partitionBy(*groups).orderBy(*order)
        return blocked.select(*df.columns, *[F.lag(c).over(inside).alias(new) for c, new in columns.items()])
    keys = [*groups, "block"]
    inside = W.partitionBy(*keys).orderBy(*order)
    ends = blocked.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_end"))
    ends = ends.select(*keys, F.lag("_end").over(W.partitionBy(*groups).orderBy("block")).alias("_before"))
    rows = blocked.withColumn("_first", F.row_number().over(inside) == 1).withColumns({f"_l{j}": F.lag(c).over(inside) for j, c in enumerate(columns)})
    joined = null_safe_join(rows, ends, keys)
    return joined.select(*df.columns, *[F.when(F.col("_first"), F.col(f"_before.{c}")).otherwise(F.col(f"_l{j}")).alias(new) for j, (c, new) in enumerate(columns.items())])
