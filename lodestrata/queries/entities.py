"""Topics, rankings, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.operators import graph, predicates, ranking, search, vector
from lodestrata.operators.hierarchy import hierarchies, key_number, number_key
from lodestrata.plans.lineage import cut
from lodestrata.queries.registry import Registry
from lodestrata.sources.tables import table

REGISTRY = Registry()
Q = REGISTRY.query

# --- topics: the words of the parts' names -------------------------------------------------------------------------------------------


def index_of(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of the parts: a part is the entity ``brand:partkey``, its terms are the words of its name and type."""
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("ns"), F.col("p_partkey").cast("string").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return search.postings(parts, "text")


_INDEX = """terms AS (SELECT p_brand AS ns, CAST(p_partkey AS VARCHAR) AS id, unnest(string_split_regex(lower(concat_ws(' ', p_name, p_type)), '[^\\p{L}\\p{N}_]+')) AS term FROM part),
    idx AS (SELECT term, ns, id, count(*) AS frequency FROM terms WHERE term != '' GROUP BY 1, 2, 3)"""


@Q("topic_postings", f"WITH {_INDEX} SELECT * FROM idx")
def topic_postings(spark: SparkSession, sf: str) -> DataFrame:
    return index_of(spark, sf)


def _two(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The most frequent term that some but not all entities have, and the next."""
    rows = search.term_stats(index_of(spark, sf), 1).orderBy(F.desc("df"), "term").limit(2).collect()
    return rows[0]["term"], rows[1]["term"]


_TWO = "top AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS r FROM idx GROUP BY 1), a AS (SELECT term FROM top WHERE r = 1), b AS (SELECT term FROM top WHERE r = 2)"


@Q("topic_search_and", f"WITH {_INDEX}, {_TWO} SELECT ns, id, CAST(sum(frequency) AS BIGINT) AS score FROM idx WHERE term IN (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1, 2 HAVING count(*) = 2")
def topic_search_and(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_all(index_of(spark, sf), _two(spark, sf))


@Q("topic_search_or", f"WITH {_INDEX}, {_TWO} SELECT ns, id, CAST(sum(frequency) AS BIGINT) AS score FROM idx WHERE term IN (SELECT * FROM a UNION SELECT * FROM b) GROUP BY 1, 2")
def topic_search_or(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_any(index_of(spark, sf), _two(spark, sf))


@Q("topic_search_not", f"WITH {_INDEX}, {_TWO} SELECT ns, id, frequency AS score FROM idx WHERE term IN (SELECT * FROM a) AND (ns, id) NOT IN (SELECT (ns, id) FROM idx WHERE term IN (SELECT * FROM b))")
def topic_search_not(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return search.search(index_of(spark, sf), predicates.parse_topic_query(f"{a} NOT {b}"))


@Q("topic_term_stats", f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(frequency) AS BIGINT) AS tf, round(ln((SELECT count(*) FROM part) / count(*)), 6) AS idf FROM idx GROUP BY 1")
def topic_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_stats(index_of(spark, sf), table(spark, sf, "part").count()).withColumn("idf", F.round("idf", 6))


@Q("topic_tfidf", f"WITH {_INDEX}, s AS (SELECT term, ln((SELECT count(*) FROM part) / count(*)) AS idf FROM idx GROUP BY 1) SELECT term, ns, id, round(frequency * idf, 6) AS weight FROM idx JOIN s USING (term)")
def topic_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return search.tf_idf(index_of(spark, sf), table(spark, sf, "part").count()).withColumn("weight", F.round("weight", 6))


@Q("topic_prefix_terms", f"WITH {_INDEX} SELECT DISTINCT term FROM idx WHERE starts_with(term, 'p')")
def topic_prefix_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.prefix_terms(index_of(spark, sf), "p")


@Q("join_broadcast_terms", f"WITH {_INDEX}, t AS (SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS term FROM part WHERE p_size <= 3) SELECT ns, id, CAST(sum(frequency) AS BIGINT) AS score, count(*) AS matched FROM idx JOIN t USING (term) GROUP BY 1, 2")
def join_broadcast_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "part").where("p_size <= 3").select(F.explode(F.split(F.lower("p_type"), " ")).alias("term"))
    return search.search_terms(index_of(spark, sf), terms)


@Q("topic_ancestors", "SELECT DISTINCT family || '.' || split_part(type_name, '.', 2) AS path, a AS ancestor FROM (SELECT *, unnest([family, family || '.' || split_part(type_name, '.', 2)]) AS a FROM event_types)")
def topic_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "event_types").select(F.concat_ws(".", "family", F.split_part("type_name", F.lit("."), F.lit(2))).alias("path")).distinct()
    return search.topic_ancestors(paths).select("path", "ancestor")


@Q("scope_filters", "SELECT id, entity_namespace, version FROM (SELECT DISTINCT id, entity_namespace, version, ts, txn_id FROM entity_snapshots WHERE entity_namespace = 'agent' AND txn_id >= 100 AND txn_id <= 3000 AND ts BETWEEN TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-04-01')")
def scope_filters(spark: SparkSession, sf: str) -> DataFrame:
    asked = predicates.parse_topic_query("type:agent after:100 before:3000 time_range:2024-01-15,2024-04-01")
    rows = table(spark, sf, "entity_snapshots").where(predicates.scope(asked.filters, entity_type="entity_namespace", created="txn_id"))
    return rows.select("id", "entity_namespace", "version", "ts", "txn_id").distinct().select("id", "entity_namespace", "version")


@Q("glob_filter", "SELECT DISTINCT entity_local_id FROM entity_snapshots WHERE regexp_full_match(entity_local_id, 'src/.*_.*\\.(.).*#..*', 's')")
def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "entity_snapshots").where(predicates.glob(F.col("entity_local_id"), "src/*_*.?*#?*")).select("entity_local_id").distinct()


# --- sets ----------------------------------------------------------------------------------------------------------------------------

_EVER = "SELECT entity_namespace AS ns, entity_local_id AS id FROM"


def _sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pick = lambda name: table(spark, sf, name).select(F.col("entity_namespace").alias("ns"), F.col("entity_local_id").alias("id"))
    return pick("relevance_factors"), pick("snapshot_deliveries")


for _name, _op, _f in (("set_union", "UNION", search.merge_union), ("set_intersect", "INTERSECT", search.merge_intersection), ("set_except", "EXCEPT", search.merge_difference)):
    REGISTRY.add(_name, lambda spark, sf, f=_f: f(*reversed(_sets(spark, sf))), f"{_EVER} snapshot_deliveries {_op} {_EVER} relevance_factors")


@Q(
    "set_weighted_combine",
    """WITH a AS (SELECT entity_namespace AS ns, entity_local_id AS id, count(*) AS score FROM relevance_factors GROUP BY 1, 2), b AS (SELECT entity_namespace AS ns, entity_local_id AS id, count(*) AS score FROM snapshot_deliveries GROUP BY 1, 2)
    SELECT ns, id, round(CAST(sum(score) AS DOUBLE), 6) AS score FROM (SELECT ns, id, 0.7 * score AS score FROM a UNION ALL SELECT ns, id, 0.3 * score FROM b) GROUP BY 1, 2""",
)
def set_weighted_combine(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (df.groupBy("ns", "id").agg(F.count("*").alias("score")) for df in _sets(spark, sf))
    return search.merge_weighted([(a, 0.7), (b, 0.3)]).withColumn("score", F.round("score", 6))


@Q("join_semi_all_tags", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def join_semi_all_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that have both flags: division as one aggregation."""
    return table(spark, sf, "lineitem").where(F.col("l_returnflag").isin("A", "R")).groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n")).where("n = 2").select("l_orderkey")


@Q("join_anti_unused", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def join_anti_unused(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey").join(used, "p_partkey", "left_anti")


# --- ranking -------------------------------------------------------------------------------------------------------------------------


def scored(spark: SparkSession, sf: str, weights: str) -> DataFrame:
    once = table(spark, sf, "relevance_factors").groupBy("query_id", "result_id").agg(F.max(F.struct("computed_at", *[F.nanvl(F.col(c), F.lit(None).cast("float")).alias(c) for c in ranking.WEIGHTS["balanced"]])).alias("x")).select("query_id", "result_id", "x.*")
    return once.withColumn("score", F.round(ranking.score(ranking.WEIGHTS[weights]), 6))


def _scored_sql(weights: str) -> str:
    names = list(ranking.WEIGHTS["balanced"])
    clean = {c: f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in names}
    total = " + ".join(f"coalesce(CAST({c} AS DOUBLE), 0) * {w}" for c, w in ranking.WEIGHTS[weights].items())
    order = ", ".join(f"{c} DESC NULLS LAST" for c in names)
    return f"""SELECT query_id, result_id, round({total}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, result_id ORDER BY computed_at DESC NULLS LAST, {order}) AS copy
      FROM (SELECT query_id, result_id, computed_at, {", ".join(clean.values())} FROM relevance_factors)) WHERE copy = 1"""


for _w in ranking.WEIGHTS:
    REGISTRY.add(
        f"rank_{_w}",
        lambda spark, sf, w=_w: ranking.ranked(scored(spark, sf, w), ["query_id"], ["result_id"]).select("query_id", "result_id", "score", F.col("rank").cast("long").alias("rank")),
        f"SELECT query_id, result_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, result_id) - 1 AS rank FROM ({_scored_sql(_w)})",
    )


@Q("rank_topk", f"SELECT * FROM ({_scored_sql('balanced')}) ORDER BY score DESC, query_id, result_id LIMIT 20")
def rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(scored(spark, sf, "balanced"), 20, ["query_id", "result_id"]).select("query_id", "result_id", "score")


@Q("rank_topk_per_query", f"SELECT query_id, result_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS r FROM ({_scored_sql('balanced')})) WHERE r <= 3")
def rank_topk_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k_per(scored(spark, sf, "balanced"), ["query_id"], 3, ["result_id"]).select("query_id", "result_id")


@Q("rank_factors", "SELECT p_partkey, round(greatest(0, 1 - (p_size * 24.0) / 720), 6) AS recency, round(least(1.0, p_retailprice / 100.0), 6) AS popularity, round((CASE WHEN list_contains(string_split(p_type, ' '), 'STEEL') THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(p_type, ' '), 'BRASS') THEN 1 ELSE 0 END) / 2.0, 6) AS semantic_similarity, CASE WHEN contains(p_type, 'STEEL BRASS') THEN CAST(1 AS DOUBLE) ELSE 0 END AS exact_match FROM part")
def rank_factors(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    made = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.col("p_size").cast("long") * 86_400_000_000)
    f = ranking.factors(F.lit(1.0), made, F.col("p_retailprice"), F.col("p_type"), "STEEL BRASS", now)
    return table(spark, sf, "part").select("p_partkey", *[F.round(f[c], 6).alias(c) for c in ("recency", "popularity", "semantic_similarity", "exact_match")])


@Q("summary_cutoff", "WITH s AS (SELECT p_brand, p_partkey, sum(length(p_name)) OVER (PARTITION BY p_brand) AS whole, sum(length(p_name) + 10) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS used FROM part) SELECT p_brand, p_partkey FROM s WHERE whole <= 1000 OR used <= 1000")
def summary_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.summary_cutoff(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], "p_name", 1000).select("p_brand", "p_partkey")


# --- vectors -------------------------------------------------------------------------------------------------------------------------

_DUCK = {
    "euclidean": "sqrt(list_sum([(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2 for p in list_zip(v.embedding, q.embedding)]))",
    "dot": "-list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) for p in list_zip(v.embedding, q.embedding)])",
    "cosine": "1 - list_sum([CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE) for p in list_zip(v.embedding, q.embedding)]) / sqrt(list_sum([CAST(x AS DOUBLE) ** 2 for x in v.embedding])) / sqrt(list_sum([CAST(x AS DOUBLE) ** 2 for x in q.embedding]))",
}


def _first(spark: SparkSession, sf: str) -> list[float]:
    return list(table(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"])


for _m in vector.DISTANCES:
    REGISTRY.add(
        f"knn_{_m}",
        lambda spark, sf, m=_m: vector.nearest(table(spark, sf, "embeddings"), _first(spark, sf), 10, m).withColumn("distance", F.round("distance", 5)),
        f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT v.vec_id, round({_DUCK[_m]}, 5) AS distance FROM embeddings v, q ORDER BY {_DUCK[_m]}, vec_id LIMIT 10",
    )


@Q("knn_threshold", f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT v.vec_id, {_DUCK['cosine']} AS distance FROM embeddings v, q) SELECT vec_id, round(distance, 5) AS distance FROM d WHERE distance <= 0.9 ORDER BY d.distance, vec_id LIMIT 1000000")
def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return vector.nearest(table(spark, sf, "embeddings"), _first(spark, sf), 1_000_000, "cosine", 0.9).withColumn("distance", F.round("distance", 5))


def _each(metric: str, where: str) -> str:
    return f"WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, {_DUCK[metric]} AS distance FROM embeddings q JOIN embeddings v ON v.vec_id != q.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, neighbor_id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS r FROM d) WHERE {where}"


def _knn_each(spark: SparkSession, sf: str, metric: str, k: int | None, most: float | None = None) -> DataFrame:
    """The stated query set, every 50th vector, against all vectors."""
    vectors = table(spark, sf, "embeddings")
    found = vector.nearest_each(vectors, vectors.where("vec_id % 50 = 0"), k, metric, max_distance=most)
    return found.select("query_id", "neighbor_id", F.round("distance", 4).alias("distance"))


for _name, _m in (("knn_each", "euclidean"), ("knn_each_cosine", "cosine"), ("knn_each_dot", "dot")):
    REGISTRY.add(_name, lambda spark, sf, m=_m: _knn_each(spark, sf, m, 5), _each(_m, "r <= 5"))
REGISTRY.add("knn_each_threshold", lambda spark, sf: _knn_each(spark, sf, "cosine", None, 0.8), _each("cosine", "distance <= 0.8"))


@Q("knn_indexed", "SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL")
def knn_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the index of cells finds nine of ten of the five nearest vectors of every 50th vector, beside the exact search."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    exact = vector.nearest_each(vectors, asked, 5).select("query_id", "neighbor_id")
    found = vector.nearest_indexed(vectors, asked, 5, cells=32).select("query_id", "neighbor_id", F.lit(1).alias("hit"))
    both = exact.join(found, ["query_id", "neighbor_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.countDistinct("query_id").alias("queries"))
    return both.select("queries", (F.col("recall") >= 0.9).alias("reached"))


# --- graphs: nation to nation by orders' suppliers ---------------------------------------------------------------------------------------


def edges_of(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between nations: from a nation to those with the next keys, and back to its region's first nation."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    hop = lambda to, kind, strength, place: F.struct(to.cast("int").alias("dst"), F.lit(kind).alias("rel_type"), F.lit(strength).alias("strength"), (k * 3 + place).alias("seq"))
    return n.select(k.alias("src"), F.explode(F.array(hop((k * 7 + 3) % 25, "calls", 0.5, 0), hop((k + 1) % 25, "imports", 0.8, 1), hop(F.col("n_regionkey"), "owns", 0.9, 2))).alias("x")).select("src", "x.*")


_EDGES = """edges AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst, 'calls' AS rel_type, 0.5 AS strength, n_nationkey * 3 AS seq FROM nation
    UNION ALL SELECT n_nationkey, (n_nationkey + 1) % 25, 'imports', 0.8, n_nationkey * 3 + 1 FROM nation UNION ALL SELECT n_nationkey, n_regionkey, 'owns', 0.9, n_nationkey * 3 + 2 FROM nation)"""


def _nodes(spark: SparkSession, *nodes: int) -> DataFrame:
    return spark.createDataFrame([(x,) for x in nodes], "node int")


@Q("graph_outgoing", f"WITH {_EDGES} SELECT src, CAST(dst AS INTEGER) AS dst, rel_type FROM edges WHERE src = 5")
def graph_outgoing(spark: SparkSession, sf: str) -> DataFrame:
    return graph.outgoing(edges_of(spark, sf), 5).select("src", "dst", "rel_type")


@Q("graph_incoming", f"WITH {_EDGES} SELECT src, CAST(dst AS INTEGER) AS dst, rel_type FROM edges WHERE dst = 2")
def graph_incoming(spark: SparkSession, sf: str) -> DataFrame:
    return graph.incoming(edges_of(spark, sf), 2).select("src", "dst", "rel_type")


_WALKS = f"""WITH RECURSIVE {_EDGES}, w AS (SELECT src AS start, dst AS node, src || '>' || dst AS path, CAST(strength AS DOUBLE) AS strength, 1 AS hops FROM edges
    UNION ALL SELECT w.start, e.dst, w.path || '>' || e.dst, w.strength * e.strength, w.hops + 1 FROM w JOIN edges e ON e.src = w.node WHERE w.hops < 3)"""


@Q("graph_walks_depth3", f"{_WALKS} SELECT start, CAST(node AS INTEGER) AS node, hops, path, round(strength, 6) AS strength FROM w")
def graph_walks(spark: SparkSession, sf: str) -> DataFrame:
    edges = edges_of(spark, sf)
    w = graph.walks(edges, edges.select(F.col("src").alias("node")).distinct(), 3)
    return w.select("start", "node", "hops", F.array_join("path", ">").alias("path"), F.round("strength", 6).alias("strength"))


@Q("graph_neighbors", f"WITH RECURSIVE {_EDGES}, w AS (SELECT src AS start, dst AS node, 1 AS hops FROM edges WHERE rel_type != 'owns' UNION SELECT w.start, e.dst, w.hops + 1 FROM w JOIN edges e ON e.src = w.node AND e.rel_type != 'owns' WHERE w.hops < 3) SELECT start, CAST(node AS INTEGER) AS node, min(hops) AS hops FROM w WHERE node != start GROUP BY 1, 2")
def graph_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    edges = edges_of(spark, sf)
    return graph.neighbors(edges, edges.select(F.col("src").alias("node")).distinct(), 3, ["calls", "imports"])


_SIMPLE = f"""WITH RECURSIVE {_EDGES}, p AS (SELECT src AS start, dst AS node, [src, dst] AS path, CAST(strength AS DOUBLE) AS strength, 1 AS hops, [seq] AS ord FROM edges WHERE src IN (0, 7, 13) AND dst != src
    UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst), p.strength * e.strength, p.hops + 1, list_append(p.ord, e.seq) FROM p JOIN edges e ON e.src = p.node WHERE p.hops < 6 AND p.node != 19 AND NOT list_contains(p.path, e.dst))"""


@Q("graph_all_paths", f"{_SIMPLE} SELECT start AS src, CAST(node AS INTEGER) AS dst, hops, array_to_string(path, '>') AS path, round(strength, 6) AS strength FROM p WHERE node = 19 AND hops <= 4")
def graph_all_paths(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(x, 19) for x in (0, 7, 13)], "src int, dst int")
    return graph.simple_paths(edges_of(spark, sf), pairs, 3).select("src", "dst", "hops", F.array_join("path", ">").alias("path"), F.round("strength", 6).alias("strength"))


@Q("graph_shortest_path", f"{_SIMPLE} SELECT src, dst, hops, path, strength FROM (SELECT start AS src, CAST(node AS INTEGER) AS dst, hops, array_to_string(path, '>') AS path, round(strength, 6) AS strength, row_number() OVER (PARTITION BY start ORDER BY hops, ord) AS r FROM p WHERE node = 19) WHERE r = 1")
def graph_shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([(x, 19) for x in (0, 7, 13)], "src int, dst int")
    return graph.shortest_paths(edges_of(spark, sf), pairs).select("src", "dst", "hops", F.array_join("path", ">").alias("path"), F.round("strength", 6).alias("strength"))


_SESSIONS = "links AS (SELECT parent_session_id AS src, session_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC, parent_session_id DESC NULLS LAST) AS c FROM session_nodes) WHERE c = 1 AND parent_session_id IS NOT NULL)"


def _session_edges(spark: SparkSession, sf: str) -> DataFrame:
    newest = table(spark, sf, "session_nodes").groupBy("session_id").agg(F.max(F.struct("received_at", "parent_session_id")).alias("x"))
    return newest.select(F.col("x.parent_session_id").alias("src"), F.col("session_id").alias("dst")).where("src is not null")


@Q("session_patterns", f"WITH {_SESSIONS}, d AS (SELECT node, sum(o) AS o, sum(i) AS i FROM (SELECT src AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links) GROUP BY 1) SELECT node, CASE WHEN o >= 3 THEN 'fan_out' WHEN i >= 3 THEN 'fan_in' ELSE 'pipeline' END AS pattern FROM d WHERE o >= 3 OR i >= 3 OR (o = 1 AND i = 1)")
def session_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return graph.patterns(_session_edges(spark, sf)).select("node", "pattern")


@Q("session_degrees", f"WITH {_SESSIONS} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM links UNION ALL SELECT dst, 0, 1 FROM links) GROUP BY 1")
def session_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_session_edges(spark, sf))


@Q(
    "session_lineage",
    f"""WITH RECURSIVE {_SESSIONS}, hub AS (SELECT src FROM links GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1),
    down AS (SELECT dst AS node, 1 AS hops FROM links WHERE src = (SELECT src FROM hub) UNION SELECT l.dst, d.hops + 1 FROM down d JOIN links l ON l.src = d.node WHERE d.hops < 4),
    up AS (SELECT src AS node, 1 AS hops FROM links WHERE dst = (SELECT src FROM hub) UNION SELECT l.src, u.hops + 1 FROM up u JOIN links l ON l.dst = u.node WHERE u.hops < 4)
    SELECT node, min(hops) AS hops, 'descendant' AS direction FROM down WHERE node != (SELECT src FROM hub) GROUP BY 1 UNION ALL SELECT node, min(hops), 'ancestor' FROM up WHERE node != (SELECT src FROM hub) GROUP BY 1""",
)
def session_lineage(spark: SparkSession, sf: str) -> DataFrame:
    edges = _session_edges(spark, sf)
    hub = edges.groupBy("src").count().orderBy(F.desc("count"), "src").first()["src"]
    return graph.lineage(edges, hub, 4)


_STARTS = "SELECT DISTINCT session_id AS node FROM session_nodes WHERE session_id % 50 = 0"


@Q(
    "graph_session_neighbors",
    f"""WITH RECURSIVE {_SESSIONS}, both_ways AS (SELECT src, dst FROM links UNION SELECT dst, src FROM links), s AS ({_STARTS}),
    w AS (SELECT node AS start, node, 0 AS hops FROM s UNION SELECT w.start, b.dst, w.hops + 1 FROM w JOIN both_ways b ON b.src = w.node WHERE w.hops < 3)
    SELECT start, node, min(hops) AS hops FROM w WHERE node != start GROUP BY 1, 2""",
)
def graph_session_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """What lies within three links, up or down, of every 50th session: hubs and all."""
    links = _session_edges(spark, sf)
    both = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    starts = table(spark, sf, "session_nodes").where("session_id % 50 = 0").select(F.col("session_id").alias("node")).distinct()
    return graph.neighbors(both, starts, 3)


@Q(
    "graph_session_paths",
    f"""WITH RECURSIVE {_SESSIONS}, known AS (SELECT * FROM links WHERE src IN (SELECT session_id FROM session_nodes)), s AS ({_STARTS}),
    w AS (SELECT node AS dst, node AS here, 0 AS hops, CAST(node AS VARCHAR) AS path FROM s
          UNION ALL SELECT w.dst, l.src, w.hops + 1, l.src || '>' || w.path FROM w JOIN known l ON l.dst = w.here WHERE NOT list_contains(string_split(w.path, '>'), CAST(l.src AS VARCHAR)))
    SELECT here AS src, dst, hops, path FROM w WHERE hops > 0 AND here NOT IN (SELECT dst FROM known)""",
)
def graph_session_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path to every 50th session from the root of its tree."""
    links = _session_edges(spark, sf)
    sessions = table(spark, sf, "session_nodes").select(F.col("session_id").alias("src")).distinct()
    edges = cut(links.join(sessions, "src", "left_semi").select("src", "dst", F.lit(1.0).alias("strength"), F.col("dst").alias("seq")))
    nodes = sessions.join(edges.select(F.col("dst").alias("node"), F.col("src").alias("parent")), F.col("src") == F.col("node"), "left").where("src is not null")
    tree = hierarchies(nodes.select(number_key(F.col("src")).alias("id"), number_key(F.col("parent")).alias("parent")), paths=False)
    pairs = tree.where("root is not null").select(key_number(F.col("root")).alias("src"), key_number(F.col("id")).alias("dst")).where("src != dst and dst % 50 = 0")
    return graph.shortest_paths(edges, pairs).select("src", "dst", "hops", F.array_join("path", ">").alias("path"))
