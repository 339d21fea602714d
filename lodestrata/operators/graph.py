"""Relationships as edges: ``src, dst, rel_type, strength, seq`` (a unique number in the order of insertion)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, functions as F

from lodestrata.plans.lineage import cut


#: Hops after which what was seen is written anew.
REWRITE = 16


def outgoing(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node)


def incoming(edges: DataFrame, node) -> DataFrame:
    """The edges into a node, each once, parallel ones included."""
    return edges.where(F.col("dst") == node)


def walks(edges: DataFrame, starts: DataFrame, max_depth: int, rel_types: Sequence[str] | None = None) -> DataFrame:
    """Every walk of 1 to ``max_depth`` edges (at least 1) from ``starts`` (``node``): ``start, node, hops, path, strength``.

    Cycles are walked again and again up to the depth; the strength is the product along the walk. One join per hop.
    """
    usable = edges if rel_types is None else edges.where(F.col("rel_type").isin(list(rel_types)))
    step = usable.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("strength").cast("double").alias("w"))
    at = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"), F.lit(1.0).alias("strength"), F.lit(0).alias("hops"))
    out = None
    for hop in range(1, max(1, max_depth) + 1):
        at = at.join(step, "node").select("start", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"), (F.col("strength") * F.col("w")).alias("strength"), F.lit(hop).alias("hops"))
        out = at if out is None else out.unionByName(at)
    return out


def neighbors(edges: DataFrame, starts: DataFrame, max_hops: int, rel_types: Sequence[str] | None = None) -> DataFrame:
    """Distinct nodes within ``max_hops`` of each start, but for itself: ``start, node, hops`` (the fewest).

    The frontier of each hop holds only nodes not seen before.
    """
    usable = edges if rel_types is None else edges.where(F.col("rel_type").isin(list(rel_types)))
    step = usable.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        reached = frontier.join(step, "node").select("start", F.col("to").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % REWRITE == 0:
            seen = cut(seen)
    return seen.where("hops > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """The shortest path of each pair (``src, dst``) that has one: ``src, dst, hops, path, strength``.

    Of equally short paths the one whose edges come first in ``seq``, from the start on. A node has an empty path to itself. Breadth
    first from all sources at once; a source stops when all its goals are reached. It enters each node once, so the search ends without
    ``max_hops`` too.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("strength").cast("double").alias("w"), "seq")
    goals = cut(pairs.select("src", "dst").distinct())
    frontier = goals.select("src", F.col("src").alias("node")).distinct().select("src", "node", F.array("node").alias("path"), F.lit(1.0).alias("strength"), F.array().cast("array<long>").alias("order"))
    seen = frontier.select("src", "node")
    done = goals.where(F.col("src") == F.col("dst")).select("src", "dst", F.lit(0).alias("hops"), F.array("src").alias("path"), F.lit(1.0).alias("strength"))
    open_goals = goals.where(F.col("src") != F.col("dst"))
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        moved = frontier.join(step, "node").join(seen.select("src", F.col("node").alias("to")), ["src", "to"], "left_anti")
        grown = moved.select("src", "to", F.struct(F.concat("order", F.array(F.col("seq").cast("long"))).alias("order"), F.concat("path", F.array("to")).alias("path"), (F.col("strength") * F.col("w")).alias("strength")).alias("x"))
        best = grown.groupBy("src", "to").agg(F.min("x").alias("x")).select("src", F.col("to").alias("node"), "x.path", "x.strength", "x.order")
        frontier = cut(best.join(open_goals.select("src", F.col("dst").alias("node"), F.lit(True).alias("hit")), ["src", "node"], "left"))
        new, hits = frontier.agg(F.count("*"), F.count("hit")).first()
        if not new:
            break
        # Frontiers are added as they are; only now and then are they written as one, so that neither plans nor partitions grow with the hops.
        seen = seen.unionByName(frontier.select("src", "node"))
        if hits:
            reached = frontier.where("hit").select("src", F.col("node").alias("dst"), F.lit(hop).alias("hops"), "path", "strength")
            done = done.unionByName(reached)
            open_goals = cut(open_goals.join(reached.select("src", "dst"), ["src", "dst"], "left_anti"))
            if open_goals.isEmpty():
                break
            frontier = frontier.join(open_goals.select("src").distinct(), "src", "left_semi")
        if hop % REWRITE == 0:
            seen, done = cut(seen.repartition("src", "node")), cut(done)
    return done


def simple_paths(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """All paths without repeated nodes of at most ``max_depth`` + 1 edges between pairs (``src, dst``): ``src, dst, hops, path, strength``.

    Parallel edges give paths of their own.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("strength").cast("double").alias("w"))
    at = pairs.select("src", "dst").distinct().select("src", "dst", F.col("src").alias("node"), F.array("src").alias("path"), F.lit(1.0).alias("strength"))
    out = None
    for hop in range(1, max_depth + 2):
        at = at.where("node != dst or size(path) = 1").join(step, "node").where(~F.array_contains("path", F.col("to")))
        at = at.select("src", "dst", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"), (F.col("strength") * F.col("w")).alias("strength"))
        hits = at.where("node = dst").select("src", "dst", F.lit(hop).alias("hops"), "path", "strength")
        out = hits if out is None else out.unionByName(hits)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """``node, out_degree, in_degree`` of each node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def patterns(edges: DataFrame, fan: int = 3) -> DataFrame:
    """Nodes by shape: ``fan_out`` and ``fan_in`` from ``fan`` edges on, else ``pipeline`` with one edge in and one out."""
    kind = F.when(F.col("out_degree") >= fan, "fan_out").when(F.col("in_degree") >= fan, "fan_in").when((F.col("out_degree") == 1) & (F.col("in_degree") == 1), "pipeline")
    return degrees(edges).withColumn("pattern", kind).where("pattern is not null")


def lineage(edges: DataFrame, node, max_depth: int) -> DataFrame:
    """Ancestors and descendants of a node within ``max_depth``: ``node, hops, direction``."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(node,)], edges.select(F.col("src").alias("node")).schema)
    down = neighbors(edges, start, max_depth).select("node", "hops", F.lit("descendant").alias("direction"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in ("rel_type", "strength", "seq") if c in edges.columns])
    up = neighbors(back, start, max_depth).select("node", "hops", F.lit("ancestor").alias("direction"))
    return down.unionByName(up)
