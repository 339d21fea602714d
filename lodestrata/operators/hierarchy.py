"""Parent links to hierarchies: fragment contraction, solved recursively."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestrata.plans.bounded import broadcast_if_bounded
from lodestrata.plans.lineage import cut

#: Nodes per fragment task, and nodes up to which a forest is solved in one task (some 100 MB each).
FRAGMENT_ROWS = 150_000

_SOLVED = "id string, exit string, top string, hops long, least string, cycle string, chain array<string>"


def number_key(number: Column) -> Column:
    """A BIGINT as text whose byte order is the order of the numbers."""
    return F.lpad((number.cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")


def key_number(key: Column) -> Column:
    """The BIGINT of a :func:`number_key`."""
    return (key.cast("decimal(20,0)") - F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def solve_fragment(ids: np.ndarray, parents: np.ndarray, least: np.ndarray, hops: np.ndarray, chains: list | None) -> pd.DataFrame:
    """Follow the parent links of one fragment as far as they stay within it.

    For each node: ``exit``, the first node outside (null at a root or on a cycle), ``top``, the last node inside, ``hops`` from the node
    to ``top``, ``least``, the smallest id from the node up to ``top``, ``cycle``, the smallest id of the cycle it runs into, and
    ``chain``, the nodes above it up to ``top``, nearest first. A node may stand for a contracted chain: of ``hops`` links beyond
    itself, with ``least`` and ``chains`` of it. Iterative, by levels, so that depth doesn't matter.
    """
    n = len(ids)
    up = pd.Index(ids).get_indexer(pd.Index(parents, dtype=object)) if n else np.zeros(0, int)
    up = np.where(pd.isna(parents), -1, up)
    children = np.argsort(up, kind="stable")
    starts = np.searchsorted(up[children], np.arange(n + 1))
    top, done = np.arange(n), np.zeros(n, bool)
    far, low = np.zeros(n, np.int64), least.copy()
    chain: list = [[] for _ in range(n)] if chains is not None else []
    cycle = np.full(n, None, object)

    def spread(level: np.ndarray) -> None:
        """From solved nodes down to their children, level by level."""
        while len(level):
            done[level] = True
            below = np.concatenate([children[starts[i] : starts[i + 1]] for i in level]) if len(level) else level
            below = below[~done[below]]
            above = up[below]
            top[below], cycle[below] = top[above], cycle[above]
            far[below] = hops[below] + 1 + far[above]
            low[below] = np.where(least[below] < low[above], least[below], low[above]) if len(below) else low[below]
            if chains is not None:
                for i, j in zip(below, above):
                    chain[i] = [*chains[i], ids[j], *chain[j]]
            level = below

    roots = np.flatnonzero(up < 0)
    far[roots] = hops[roots]
    if chains is not None:
        for i in roots:
            chain[i] = list(chains[i])
    spread(roots)
    for i in np.flatnonzero(~done):
        if done[i]:
            continue
        seen: dict[int, int] = {}
        while i not in seen and not done[i]:
            seen[i] = len(seen)
            i = up[i]
        if not done[i]:  # what remains has a parent within: the walk closes a cycle
            ring = [j for j, at in seen.items() if at >= seen[i]]
            first = min(least[j] for j in ring)
            cycle[ring] = first
            spread(np.array(ring))
    on = pd.notna(cycle)
    out = np.where(on | (up[top] >= 0), None, parents[top]) if n else parents
    return pd.DataFrame({"id": ids, "exit": out, "top": ids[top] if n else ids, "hops": far, "least": low, "cycle": cycle, "chain": chain if chains is not None else [None] * n})


def _fragments(nodes: DataFrame, paths: bool) -> DataFrame:
    """:func:`solve_fragment` over each partition of ``id, parent, hops, least, chain``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)  # a partition is a fragment, of FRAGMENT_ROWS on average
        if not parts:
            return
        x = pd.concat(parts, ignore_index=True)
        of = lambda c: x[c].to_numpy(dtype=object)
        chains = [[] if c is None else list(c) for c in x["chain"]] if paths else None
        yield solve_fragment(of("id"), of("parent"), of("least"), x["hops"].to_numpy(dtype=np.int64), chains)

    return nodes.mapInPandas(run, _SOLVED)


def _solve(nodes: DataFrame, count: int, paths: bool, level: int) -> DataFrame:
    """``id, top, hops, cycle, chain`` of each node of a forest with unique ids; ``top`` is the root where there is no cycle.

    Contracted nodes carry the hops, least id and chain of the links they stand for.
    """
    parts = max(1, -(-count // FRAGMENT_ROWS))
    if parts == 1:
        placed = nodes.coalesce(1)
    elif level == 0:
        placed = nodes.repartitionByRange(parts, "id")  # related ids are often near one another
    else:
        # By coin: a node that lost moves to its parent's place. A link whose child lost and whose parent won becomes local, whatever
        # the links are, so that each level contracts a quarter of the links at least. Children of a parent with very many stay
        # where they are, so that no fragment outgrows its share; there are few such parents, and all else still contracts.
        crowded = nodes.groupBy(F.col("parent").alias("p")).count().where(F.col("count") > max(2, FRAGMENT_ROWS // 8)).select("p")
        coin = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2)) == 0
        moves = F.col("parent").isNotNull() & F.col("p").isNull() & coin(F.col("id")) & ~coin(F.col("parent"))
        placed = nodes.join(broadcast_if_bounded(crowded), F.col("parent") == F.col("p"), "left").withColumn("place", F.when(moves, F.col("parent")).otherwise(F.col("id"))).drop("p")
        placed = placed.repartition(parts, "place").drop("place")
    solved = cut(_fragments(placed, paths))
    exits = solved.where("exit is not null").select(F.col("exit").alias("id")).distinct()
    entries = cut(solved.join(exits, "id", "left_semi").select("id", F.col("exit").alias("parent"), "hops", "least", "cycle", "top", "chain"))
    left = entries.count()
    if left == 0:  # every exit leads to a node that doesn't exist: what it left from is a root
        return solved.select("id", "top", "hops", "cycle", "chain")
    # Of a node that ends within its fragment nothing remains to be found.
    above = _solve(entries.select("id", F.when(F.col("cycle").isNull(), F.col("parent")).alias("parent"), "hops", "least", "chain"), left, paths, level + 1)
    ends = entries.select("id", F.col("top").alias("own_top"), F.col("cycle").alias("own_cycle"))
    # The quotient's top is an entry; the true top is that entry's own.
    tops = ends.select(F.col("id").alias("top"), F.col("own_top").alias("true_top"), F.col("own_cycle"))
    above = above.join(tops, "top").select(F.col("id").alias("exit"), F.col("true_top").alias("a_top"), F.col("hops").alias("a_hops"), F.coalesce("cycle", "own_cycle").alias("a_cycle"), F.col("chain").alias("a_chain"))
    found = F.col("a_top").isNotNull()
    return cut(
        solved.join(above, "exit", "left").select(
            "id",
            F.when(found, F.col("a_top")).otherwise(F.col("top")).alias("top"),
            F.when(found, F.col("hops") + 1 + F.col("a_hops")).otherwise(F.col("hops")).alias("hops"),
            F.coalesce("cycle", "a_cycle").alias("cycle"),
            (F.when(found, F.concat("chain", F.array("exit"), "a_chain")).otherwise(F.col("chain")) if paths else F.col("chain")).alias("chain"),
        )
    )


def hierarchies(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """``id, root, depth, cycle_id, path`` of each node of ``nodes`` (``id STRING, parent STRING``).

    A node whose parent is null or doesn't exist is a root, of depth 0. ``path`` leads from the root to the node. A node from which no
    root is reached, on a cycle or below one, has a null ``root``, ``depth`` and ``path``, and in ``cycle_id`` the smallest id, by bytes, on
    the cycle; else ``cycle_id`` is null. ``paths=False`` leaves ``path`` null and its cost out. Of several rows of an id the one with the
    greatest parent holds; rows without id are ignored; other columns are ignored; no rows give no rows.

    Each partition follows links as far as they stay within it, which contracts its chains to exits; the links between exits and
    the nodes they lead to are a smaller forest, solved the same way, down to one of a fixed size that one task solves; then each
    node's path is its own up to the exit and that of the exit's goal. Levels are cut into the checkpoint folder.
    """
    unique = nodes.where(nodes["id"].isNotNull()).groupBy(nodes["id"]).agg(F.max(nodes["parent"]).alias("parent"))
    unique = cut(unique.select("id", "parent", F.lit(0).cast("long").alias("hops"), F.col("id").alias("least"), F.lit(None).cast("array<string>").alias("chain")))
    solved = _solve(unique, unique.count(), paths, 0)
    fine = F.col("cycle").isNull()
    return solved.select(
        "id",
        F.when(fine, F.col("top")).alias("root"),
        F.when(fine, F.col("hops")).alias("depth"),
        F.col("cycle").alias("cycle_id"),
        F.when(fine & F.lit(paths), F.reverse(F.concat(F.array("id"), "chain"))).alias("path"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` for each node of :func:`hierarchies` and each node above it.

    Read off the paths without a shuffle, so that no task gathers the descendants of a node. Nodes without root have none.
    """
    up = F.posexplode(F.slice(F.reverse("path"), 2, F.greatest(F.size("path") - 1, F.lit(0)))).alias("i", "ancestor")
    return tree.where("path is not null and size(path) > 1").select("id", up).select("ancestor", F.col("id").alias("descendant"), (F.col("i") + 1).cast("long").alias("distance"))
