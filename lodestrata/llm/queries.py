"""Queries p7 to p9, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.leakage import leaked_items
from lodestrata.llm.shared_spans import shared_clusters, shared_coverage, shared_pairs
from lodestrata.llm.tokenizer import encode_texts
from lodestrata.queries.registry import Registry
from lodestrata.sources.tables import table

REGISTRY = Registry()


@REGISTRY.query("p7_ids")
def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"))


# Runs of as many words as some item needs, of items and of documents, met as texts.
_LEAKS = """WITH split AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM documents WHERE text IS NOT NULL),
    items AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM benchmark WHERE regexp_matches(lower(text), '[a-z0-9]')),
    grams AS (SELECT DISTINCT item_id, array_to_string(words[k : k + least(13, len(words)) - 1], ' ') AS gram FROM items, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS t(k)),
    sizes AS (SELECT DISTINCT least(13, len(words)) AS n FROM items),
    runs AS (SELECT doc_id, array_to_string(words[k : k + n - 1], ' ') AS gram FROM split, sizes, unnest(range(1, len(words) - n + 2)) AS t(k))
    SELECT DISTINCT doc_id, item_id FROM runs JOIN grams USING (gram)"""


@REGISTRY.query("p8_found", _LEAKS)
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark")).select("doc_id", "item_id")


# Every window of 300 characters: met by hash, compared as texts.
_SPANS = """WITH long AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
    windows AS (SELECT doc_id, k, hash(substring(text, k, 300)) AS h FROM long, unnest(range(1, length(text) - 298)) AS t(k)),
    shared AS (SELECT h FROM windows GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    few AS (SELECT w.doc_id, substring(l.text, w.k, 300) AS w FROM windows w SEMI JOIN shared USING (h) JOIN long l ON l.doc_id = w.doc_id)
    SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM few a JOIN few b ON a.w = b.w AND a.doc_id < b.doc_id"""


@REGISTRY.query("p9_found", _SPANS)
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return shared_pairs(table(spark, sf, "documents"))


# The windows of each document that stand in another one too cover its shared characters.
_COVERAGE = _SPANS.partition("few AS")[0] + """few AS (SELECT w.doc_id, w.k, substring(l.text, w.k, 300) AS w FROM windows w SEMI JOIN shared USING (h) JOIN long l ON l.doc_id = w.doc_id),
    twice AS (SELECT w FROM few GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
    covered AS (SELECT doc_id, sum(least(300, following - k)) AS chars FROM (SELECT doc_id, k, lead(k, 1, k + 300) OVER (PARTITION BY doc_id ORDER BY k) AS following FROM few SEMI JOIN twice USING (w)) GROUP BY 1),
    classes AS (SELECT text, min(doc_id) AS class_id FROM documents WHERE text IS NOT NULL GROUP BY 1)
    SELECT d.doc_id, c.class_id, length(d.text) AS n_chars, CAST(coalesce(v.chars, 0) AS BIGINT) AS shared_chars
    FROM documents d LEFT JOIN classes c ON c.text = d.text LEFT JOIN covered v ON v.doc_id = d.doc_id"""


@REGISTRY.query("p9_coverage", _COVERAGE)
def p9_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return shared_coverage(table(spark, sf, "documents"))


# Everything that a document reaches along pairs; the smallest reached names the cluster.
_CLUSTERS = f"""WITH RECURSIVE pairs AS ({_SPANS}), links AS (SELECT doc_id_a AS x, doc_id_b AS y FROM pairs UNION SELECT doc_id_b, doc_id_a FROM pairs),
    reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
    SELECT x AS doc_id, least(x, min(y)) AS cluster_id, x <= min(y) AS keep FROM reached GROUP BY x"""


@REGISTRY.query("p9_clusters", _CLUSTERS)
def p9_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return shared_clusters(table(spark, sf, "documents"))
