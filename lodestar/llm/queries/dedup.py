"""Near-duplicate detection over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..neardup import NearDup, near_duplicates
from ..vecdup import near_vectors


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), NearDup(words=2))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_minhash_near_dedup": op1_minhash_near_dedup, "op8_embedding_near_dedup": op8_embedding_near_dedup}

SQL = {
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), inter AS (
  SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT u, v FROM inter WHERE 100 * c >= 80 * (nu + nv - c)
), edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(root, node) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.root, e.v FROM reach r JOIN edges e ON r.node = e.u
), lows AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN lows l ON l.node = s.doc_id
""",
    "op8_embedding_near_dedup": """
WITH RECURSIVE norms AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL
), good AS (SELECT * FROM norms WHERE n > 0 AND isfinite(n) AND len(list_filter(v, lambda x: x IS NULL)) = 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98
), reach(root, node) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.root, l.w FROM reach r JOIN links l ON r.node = l.u
), lows AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1
), counts AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT l.node AS vec_id, coalesce(c.n, 0) AS n_links, l.component_id, l.node = l.component_id AS kept FROM lows l LEFT JOIN counts c ON c.u = l.node
""",
}
