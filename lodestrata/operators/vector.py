"""Nearest neighbours by euclidean, cosine or dot distance: exact ones, and those of an index of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Query vectors that are multiplied at once, and blocks of them that one scan of the vectors asks (some MB are broadcast).
QUERY_BLOCK, BLOCKS_PER_SCAN = 2_048, 8


def _products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def dot_distance(a: Column, b: Column) -> Column:
    """The negated scalar product over the common dimensions."""
    return -_products(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    """The euclidean distance over the common dimensions."""
    square = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine, within [0, 2]; 1 if either norm is below 1e-6."""
    na, nb = F.sqrt(_products(a, a)), F.sqrt(_products(b, b))
    return F.when((na < 1e-6) | (nb < 1e-6), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - _products(a, b) / (na * nb))))


DISTANCES = {"euclidean": euclidean_distance, "cosine": cosine_distance, "dot": dot_distance}


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "euclidean", max_distance: float | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors to one query, ties by key; each task keeps its own ``k``. Null vectors are ignored."""
    found = vectors.where(F.col(column).isNotNull()).select(key, DISTANCES[metric](F.col(column), F.array(*[F.lit(float(x)) for x in query])).alias("distance"))
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return found.orderBy("distance", key).limit(k)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """The distances of the rows of ``q`` to those of ``x``, pair by pair, alike for equal vectors wherever they stand."""
    if metric == "euclidean":  # differences, not the expanded square: near vectors must not cancel out
        return np.sqrt(((q - x) ** 2).sum(1))
    dot = (q * x).sum(1)
    if metric == "dot":
        return -dot
    a, b = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a < 1e-6) | (b < 1e-6), 1.0, np.clip(1 - dot / (a * b), 0, 2))


def _close(q: np.ndarray, x: np.ndarray, metric: str, k: int | None, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``q``, row of ``x``) among which are the ``k`` nearest, or all within ``most``: found by one product, with room for its rounding."""
    dot, qq, xx = q @ x.T, (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
    if metric == "euclidean":
        d, room = qq + xx - 2 * dot, 1e-9 * (qq + xx.max())
    elif metric == "dot":
        d, room = -dot, 1e-9 * np.sqrt(qq * xx.max())
    else:
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where((qq < 1e-12) | (xx < 1e-12), 1.0, 1 - dot / np.sqrt(qq * xx))
        room = 1e-9
    if most is not None:
        limit = most**2 if metric == "euclidean" and most > 0 else most
        return np.nonzero(d <= limit + room)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.inf
    return np.nonzero(d <= kth + room)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int | None = None, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", exclude_self: bool = True, max_distance: float | None = None) -> DataFrame:
    """``query_id, neighbor_id, distance, rank`` of the ``k`` nearest vectors of each query, or of all within ``max_distance``, exactly.

    A stated query set against all rows, in blocks: blocks of queries are broadcast, some for each scan of the vectors; tasks multiply
    their batches with a block, measure the pairs that may count, and keep the ``k`` best per query, so that what is shuffled grows with
    queries times tasks, not with pairs. Keys are numbers or texts. Vectors of another length than the first query, and null
    ones, are ignored. Ties follow the key. Exact at every size, its work is queries times vectors; more than some 10,000 queries need
    another scan.
    """
    if (k is None) == (max_distance is None):
        raise ValueError("either k or max_distance")
    dtype = queries.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("query_id", dtype), T.StructField("neighbor_id", dtype), T.StructField("distance", T.DoubleType())])
    spark = vectors.sparkSession
    narrow = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column)
    arrow = _arrow(schema)

    def one_scan(rows: list) -> DataFrame:
        size = len(rows[0][1])
        fit = [r for r in rows if len(r[1]) == size]
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in fit]), np.array([r[1] for r in fit], np.float64)))

        def measured(own: np.ndarray, q: np.ndarray, names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Query number, key and distance of the pairs of a batch that may count."""
            # One more than k, as the query itself may be among them.
            i, j = _close(q, x, metric, None if k is None else k + exclude_self, max_distance)
            if exclude_self:
                i, j = i[own[i] != names[j]], j[own[i] != names[j]]
            d = _exact(q[i], x[j], metric)
            if max_distance is not None:
                i, j, d = i[d <= max_distance], j[d <= max_distance], d[d <= max_distance]
            return i, names[j], d

        def best(i: np.ndarray, names: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((names, d, i))
            i, names, d = i[order], names[order], d[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < k
            return i[keep], names[keep], d[keep]

        def out(own: np.ndarray, i: np.ndarray, names: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[i].tolist(), arrow.field(0).type), pa.array(names.tolist(), arrow.field(1).type), pa.array(d)], schema=arrow)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, q = shared.value
            held: tuple | None = None
            for batch in batches:
                rows = batch.column(1).to_pylist()
                fit = [n for n, r in enumerate(rows) if len(r) == q.shape[1]]
                if not fit:
                    continue
                names, x = np.array(batch.column(0).take(pa.array(fit)).to_pylist()), np.array([rows[n] for n in fit], np.float64)
                for at in range(0, len(own), QUERY_BLOCK):
                    part = slice(at, at + QUERY_BLOCK)
                    i, n, d = measured(own[part], q[part], names, x)
                    if k is None:
                        yield out(own, i + at, n, d)
                    else:
                        found = (i + at, n, d)
                        held = best(*(np.concatenate(pair) for pair in zip(held, found))) if held else best(*found)
            if held:
                yield out(own, *held)

        return narrow.mapInArrow(run, schema)

    scans, part = [], []
    for row in queries.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column).toLocalIterator():
        part.append((row[0], list(row[1])))
        if len(part) == QUERY_BLOCK * BLOCKS_PER_SCAN:
            scans.append(one_scan(part))
            part = []
    if part:
        scans.append(one_scan(part))
    found = scans[0] if scans else spark.createDataFrame([], schema)
    for more in scans[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    ranked = found.withColumn("rank", rank)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


# --- an index of cells ------------------------------------------------------------------------------------------------------------------

#: Vectors that the cells are fitted on, queries that the probes are measured with, and vectors of a cell that one task holds.
FIT_ROWS, MEASURED_QUERIES, CELL_ROWS = 20_000, 100, 50_000


def _ready(rows: list, metric: str) -> np.ndarray:
    x = np.array(rows, np.float64)
    if metric == "cosine":
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    return x


def fit_cells(vectors: DataFrame, cells: int, metric: str = "euclidean", key: str = "vec_id", column: str = "embedding", rounds: int = 10) -> np.ndarray:
    """Centres of at most ``cells`` cells, by k-means on the FIT_ROWS vectors whose keys hash least: a bounded sample, alike on every run."""
    sample = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(FIT_ROWS).select(column).collect()
    if not sample:
        return np.zeros((0, 1))
    x = _ready([r[0] for r in sample if len(r[0]) == len(sample[0][0])], metric)
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = _ranked_cells(x, centres, 1)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centres)
    return centres


def _ranked_cells(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest cells of each vector, nearest first."""
    d = (centres * centres).sum(1)[None, :] - 2 * (x @ centres.T)
    if n >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def in_cells(vectors: DataFrame, centres: np.ndarray, n: int, metric: str, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``key, column, cells``: the ``n`` nearest cells of each vector; null vectors and those of another length are left out."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = T.StructType([vectors.schema[key], vectors.schema[column], T.StructField("cells", T.ArrayType(T.IntegerType()))])
    names = [f.name for f in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            fit = [k for k, r in enumerate(rows) if len(r) == shared.value.shape[1]]
            if fit:
                cells = _ranked_cells(_ready([rows[k] for k in fit], metric), shared.value, n)
                at = pa.array(fit)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(cells.astype(np.int32).tolist(), pa.list_(pa.int32()))], names)

    return vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(key, column).mapInArrow(run, kinds)


def probes_for(vectors: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, recall: float, metric: str, key: str = "vec_id", column: str = "embedding") -> tuple[int, float]:
    """The fewest cells to look into for a recall, and the recall they have: measured against the exact neighbours of MEASURED_QUERIES queries.

    One exact scan finds the neighbours; the place of a neighbour's cell among the query's cells is what it costs to find it.
    """
    asked = queries.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(MEASURED_QUERIES)
    exact = nearest_each(vectors, asked, k, metric, key, column)
    theirs = in_cells(vectors, centres, 1, metric, key, column).select(F.col(key).alias("neighbor_id"), F.col("cells")[0].alias("cell"))
    ours = in_cells(asked, centres, len(centres), metric, key, column).select(F.col(key).alias("query_id"), "cells")
    place = F.array_position("cells", F.col("cell")).alias("place")
    costs = sorted(r[0] for r in exact.join(F.broadcast(ours), "query_id").join(theirs, "neighbor_id").select(place).collect())  # MEASURED_QUERIES times k at most
    if not costs:
        return len(centres), 1.0
    need = costs[min(len(costs) - 1, int(np.ceil(recall * len(costs))) - 1)]
    return int(need), sum(c <= need for c in costs) / len(costs)


def nearest_indexed(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", cells: int = 256, recall: float = 0.95, key: str = "vec_id", column: str = "embedding", exclude_self: bool = True) -> DataFrame:
    """``query_id, neighbor_id, distance, rank``: of each query the ``k`` nearest vectors among those in the cells nearest to it.

    Every vector is in the index, in one cell; a query looks into as many cells as :func:`probes_for` measures for the ``recall``. Vectors and
    queries meet by cell, a large cell in parts of about CELL_ROWS. Where vectors have no structure the measured number of cells is most of
    them, and :func:`nearest_each`, the exact way, is as cheap. Distances are exact; only euclidean and cosine distances have cells.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError("cells are for euclidean and cosine distances")
    dtype = queries.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("query_id", dtype), T.StructField("neighbor_id", dtype), T.StructField("distance", T.DoubleType())])
    centres = fit_cells(vectors, cells, metric, key, column)
    if not len(centres):
        return vectors.sparkSession.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    probes, _ = probes_for(vectors, queries, centres, k, recall, metric, key, column)
    placed = in_cells(vectors, centres, 1, metric, key, column).select(key, column, F.col("cells")[0].alias("cell"))
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))  # one row per cell
    here = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"), F.col(key).alias("id"), F.col(column).alias("v"))
    asked = in_cells(queries, centres, probes, metric, key, column).select(key, column, F.explode("cells").alias("cell")).join(parts, "cell")
    asked = asked.select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(key).alias("id"), F.col(column).alias("v"))
    arrow = _arrow(schema)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], f.type) for f in arrow], schema=arrow)
        if not len(left) or not len(right):
            return empty
        names, x = np.array(left.column("id").to_pylist()), np.array(left.column("v").to_pylist(), np.float64)
        own, q = np.array(right.column("id").to_pylist()), np.array(right.column("v").to_pylist(), np.float64)
        out = []
        for at in range(0, len(own), QUERY_BLOCK):
            some, block = own[at : at + QUERY_BLOCK], q[at : at + QUERY_BLOCK]
            i, j = _close(block, x, metric, k + exclude_self, None)
            if exclude_self:
                i, j = i[some[i] != names[j]], j[some[i] != names[j]]
            d = _exact(block[i], x[j], metric)
            order = np.lexsort((names[j], d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append(pa.table([pa.array(some[i[keep]].tolist(), arrow.field(0).type), pa.array(names[j[keep]].tolist(), arrow.field(1).type), pa.array(d[keep])], schema=arrow))
        return pa.concat_tables(out)

    found = here.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInArrow(search, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def upsert(vectors: DataFrame, changes: DataFrame, key: str = "vec_id") -> DataFrame:
    """``vectors`` after ``changes``, which has the same columns and ``deleted``; keys are unique in both."""
    return vectors.join(changes.select(key), key, "left_anti").unionByName(changes.where("not deleted").select(*vectors.columns))
