"""One ranking from several scores on different scales: outranking net flow on percentiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from lodestrata.plans.bounded import broadcast_if_bounded
from lodestrata.plans.lineage import cut
from lodestrata.plans.ranking import BIG_GROUP, BLOCKS, range_blocks, running_sums, value_blocks

#: Differences of percentiles up to which two items are indifferent, and from which one is fully preferred.
INDIFFERENT, PREFERRED = 0.02, 0.3
#: Rows that a task takes at once, and the group that is then open beyond them.
CHUNK = 50_000


def net_flow(
    items: DataFrame,
    weights: Mapping[str, float],
    group: str = "query_id",
    item: str = "result_id",
    latest: str | None = "computed_at",
    indifferent: float = INDIFFERENT,
    preferred: float = PREFERRED,
    big: int = BIG_GROUP,
) -> DataFrame:
    """``group, item``, the flow of each score (``flow_<score>``), ``net_flow`` and ``position`` (from 1) of each item.

    A score counts through its percentile among the group's items only: the share below it plus half the share that equals it.
    Of a pair, the one whose percentile is higher by d is preferred by 0 up to ``indifferent``, by 1 from ``preferred`` on, and in
    between by a straight line. An item's flow in a score is what it is preferred minus what others are preferred to it, over all
    other items of the group, divided by their number; ``net_flow`` is the weighted mean over the scores, in [-1, 1].

    No pair is formed: percentiles are whole multiples of half an item, so that sorted prefix sums of counts and of percentiles, both
    of whole numbers, give each sum over others exactly. One shuffle brings together each group of up to ``big`` rows, whose
    sums are looked up in Arrow batches, many groups at once; larger groups are split into blocks of values.

    A missing score (null or NaN) neither prefers nor is preferred in that score; a constant one prefers nobody. Of
    several rows of an item the one ``latest`` holds, of equal ones the greatest. Rows without group or item are ignored. A single item
    has flow 0. Items of equal net flow (to 12 decimals) follow in the order of ``item``. No rows give no rows.
    """
    if not 0 <= indifferent < preferred:
        raise ValueError("0 <= indifferent < preferred must hold")
    names = list(weights)
    share = np.array([weights[c] for c in names], float) / sum(weights.values())
    score = lambda c: F.when(~F.isnan(items[c].cast("double")), items[c].cast("double") + F.lit(0.0))  # noqa: E731  # -0.0 becomes 0.0
    rows = items.select(items[group].alias("g"), items[item].alias("i"), F.struct((F.lit(0) if latest is None else items[latest]).alias("at"), *[score(c).alias(f"s{k}") for k, c in enumerate(names)]).alias("row")).where("g is not null and i is not null")
    busy = items.select(items[group].alias("g")).where("g is not null").groupBy("g").count().where(F.col("count") > big).select("g")
    if busy.isEmpty():
        out = _in_batches(rows, share, indifferent, preferred)
    else:
        busy = broadcast_if_bounded(cut(busy))
        out = _in_batches(rows.join(busy, "g", "left_anti"), share, indifferent, preferred).unionByName(_in_blocks(rows.join(busy, "g", "left_semi"), share, indifferent, preferred, big))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), *[F.col(f"w{k}").alias(f"flow_{c}") for k, c in enumerate(names)], F.col("net").alias("net_flow"), "position")


# --- groups that fit a task ------------------------------------------------------------------------------------------------------


def group_flows(group: np.ndarray, values: np.ndarray, indifferent: float, preferred: float) -> np.ndarray:
    """The flow sums of one score, 0 where it is missing (NaN); ``group`` numbers the groups from 0, each in one stretch.

    Per group the values' places are whole numbers, sorted; groups are told apart by an offset, so that one search finds the
    bounds of all items of all groups.
    """
    out = np.zeros(len(values))
    have = np.flatnonzero(~np.isnan(values))
    if not len(have):
        return out
    have = have[np.lexsort((values[have], group[have]))]
    g, v = group[have], values[have]
    n_of = np.bincount(g)
    base, n = (np.cumsum(n_of) - n_of)[g], n_of[g]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    m = np.diff(np.append(first, len(g)))[run]
    u = 2 * (first[run] - base) + m  # twice the items below plus the items equal
    sums = np.concatenate([[0], np.cumsum(u)])
    room = 4 * int(n_of.max()) + 4
    keys = g * room + u

    def upto(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the places of the own group that are at most ``t``."""
        at = np.searchsorted(keys, g * room + np.clip(np.floor(t), -1, room - 2).astype(np.int64), "right")
        return at - base, sums[at] - sums[base]

    q, p = 2 * n * indifferent, 2 * n * preferred
    (c1, s1), (c2, s2), (c3, s3), (c4, s4) = upto(u - p), upto(u - q), upto(u + q), upto(u + p)
    plus = c1 + ((u - q) * (c2 - c1) - (s2 - s1)) / (p - q)
    minus = (n - c4) + ((s4 - s3) - (u + q) * (c4 - c3)) / (p - q)
    out[have] = plus - minus
    return out


def _in_batches(rows: DataFrame, share: np.ndarray, indifferent: float, preferred: float) -> DataFrame:
    """``g, i``, the flows ``w<k>``, ``net`` and ``position``, of groups that a task can hold."""
    names = [f"s{k}" for k in range(len(share))]
    order = W.partitionBy("g").orderBy("i", F.col("row").desc())
    # Sorted by the window, rows reach Python group by group and item by item, the row that holds first.
    sorted_ = rows.select("g", "i", "row", (F.row_number().over(order) == 1).alias("begins"), (F.col("i") == F.lag("i").over(order)).alias("again"))
    once = sorted_.where("not coalesce(again, false)").select("g", "i", "begins", *[F.col(f"row.{c}").alias(c) for c in names])

    def solve(part: pa.Table) -> pa.RecordBatch:
        begins = part.column("begins").to_numpy()
        group = np.cumsum(begins) - 1
        first = np.flatnonzero(begins)
        n = np.diff(np.append(first, len(group)))[group]
        flows = [group_flows(group, part.column(c).to_numpy().astype(float), indifferent, preferred) / np.maximum(1, n - 1) for c in names]
        net = sum((w * x for w, x in zip(share, flows)), np.zeros(len(group)))
        best = np.lexsort((np.arange(len(group)), np.round(-net, 12) + 0.0, group))
        position = np.empty(len(group), np.int64)
        position[best] = np.arange(len(group)) - first[group] + 1
        columns = [part.column(c).combine_chunks() for c in ("g", "i")]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, flows), pa.array(net), pa.array(position)], ["g", "i", *[f"w{k}" for k in range(len(share))], "net", "position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                part = pa.Table.from_batches(held)
                last = int(np.flatnonzero(part.column("begins").to_numpy())[-1])  # the last group may go on
                if last:
                    yield solve(part.slice(0, last))
                held, size = part.slice(last).to_batches(), len(part) - last
        if size:
            yield solve(pa.Table.from_batches(held))

    kinds = [T.StructField("g", rows.schema["g"].dataType), T.StructField("i", rows.schema["i"].dataType), *[T.StructField(f"w{k}", T.DoubleType()) for k in range(len(share))], T.StructField("net", T.DoubleType()), T.StructField("position", T.LongType())]
    return once.mapInArrow(run, T.StructType(kinds))


# --- larger groups ----------------------------------------------------------------------------------------------------------------


def _in_blocks(rows: DataFrame, share: np.ndarray, indifferent: float, preferred: float, big: int) -> DataFrame:
    """The same for groups of any size: values are counted, ranked and summed in blocks, by windows and joins."""
    names = [f"s{k}" for k in range(len(share))]
    once = cut(rows.groupBy("g", "i").agg(F.max("row").alias("row")).select("g", "i", "row.*").drop("at"))
    long = once.select("g", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(f"s{k}").alias("v")) for k in range(len(names))])).alias("x")).select("g", "i", "x.f", "x.v").where("v is not null")
    values = cut(long.groupBy("g", "f", "v").agg(F.count("*").alias("m")))
    blocked, split = value_blocks(values, ["g", "f"], "v", big)
    ranked = running_sums(blocked, ["g", "f"], ["v"], {"m": "upto"}, split)
    sizes = values.groupBy("g", "f").agg(F.sum("m").alias("n"), F.count("*").alias("kinds"))
    # u = twice the items below plus the items equal: the percentile times 2n.
    placed = cut(ranked.join(sizes, ["g", "f"]).select("g", "f", "v", "m", "n", "kinds", (2 * F.col("upto") - F.col("m")).alias("u")))
    q, p = 2 * F.col("n") * F.lit(float(indifferent)), 2 * F.col("n") * F.lit(float(preferred))
    parts = F.when(F.col("kinds") > big, BLOCKS).otherwise(1)
    block_of = lambda t: F.greatest(F.lit(0), F.least(parts - 1, F.floor(t * parts / (2 * F.col("n") + 1)))).cast("int")
    point = lambda k, t, m, mu: F.struct(F.lit(k).alias("k"), t.cast("double").alias("t"), m.alias("c"), mu.alias("s"), block_of(t).alias("block"))
    u, m, none = F.col("u"), F.col("m"), F.lit(0).cast("long")
    marks = placed.select("g", "f", "v", F.explode(F.array(point(0, u, m, m * u), point(1, u - p, none, none), point(2, u - q, none, none), point(3, u + q, none, none), point(4, u + p, none, none))).alias("x")).select("g", "f", "v", "x.*")
    sums = running_sums(marks, ["g", "f"], ["t", "k"], {"c": "cc", "s": "ss"}).where("k > 0")
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    looked = sums.groupBy("g", "f", "v").agg(*[at(k, c) for k in (1, 2, 3, 4) for c in ("cc", "ss")])
    x = lambda text: F.expr(text)
    span = p - q
    plus = x("cc1") + ((u - q) * x("cc2 - cc1") - x("ss2 - ss1")) / span
    minus = (F.col("n") - x("cc4")) + (x("ss4 - ss3") - (u + q) * x("cc4 - cc3")) / span
    flows = placed.join(looked, ["g", "f", "v"]).select("g", "f", "v", (plus - minus).alias("flow"))
    groups = once.groupBy("g").agg(F.count("*").alias("all"))
    # Equal values of a group can be very many: the side that is unique per value is the small one of the join.
    by = long.join(flows, ["g", "f", "v"]).groupBy("g", "i").agg(*[F.max(F.when(F.col("f") == k, F.col("flow"))).alias(f"w{k}") for k in range(len(names))])
    part = lambda k: F.when(F.col("all") > 1, F.coalesce(F.col(f"w{k}"), F.lit(0.0)) / (F.col("all") - 1)).otherwise(F.lit(0.0))
    scored = once.select("g", "i").join(by, ["g", "i"], "left").join(groups, "g").select("g", "i", *[part(k).alias(f"w{k}") for k in range(len(names))])
    net = sum((F.col(f"w{k}") * F.lit(float(x)) for k, x in enumerate(share)), F.lit(0.0))
    scored = scored.withColumn("net", net).withColumn("down", F.round(-F.col("net"), 12) + F.lit(0.0)).withColumn("one", F.lit(1).cast("long"))
    # Places are counted in blocks too, of flow and item together, as equal flows can be very many.
    placed = running_sums(range_blocks(scored, ["g", "down", "i"]), ["g"], ["down", "i"], {"one": "position"})
    return placed.select("g", "i", *[f"w{k}" for k in range(len(names))], "net", "position")
