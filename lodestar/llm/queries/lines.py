"""Line dedup and benchmark decontamination over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import table
from ..decontam import contamination
from ..linededup import dedup_lines


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = dedup_lines(docs.withColumn("n_lines", n_lines))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contamination(docs, bench)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        F.size("spots").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES = {"op5_benchmark_decontamination": op5_benchmark_decontamination, "op10_line_dedup": op10_line_dedup}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op10_line_dedup": rf"""
WITH texts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, i, l[i] AS line, translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_LOWER}) AS k
  FROM texts, unnest(range(1, len(l) + 1)) AS t(i)
), firsts AS (
  SELECT k, min(doc_id) AS d FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT a.doc_id, a.i, a.line, f.k IS NOT NULL AND f.d <> a.doc_id AS gone FROM lines a LEFT JOIN firsts f ON a.k = f.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op5_benchmark_decontamination": rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS k
  FROM bw, unnest(range(1, len(w) - least(len(w), 8) + 2)) AS t(i) WHERE len(w) > 0
), occ AS (
  SELECT x.doc_id, x.i, x.n, v.item_id FROM (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
    FROM dw, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i)
  ) x JOIN win v ON x.n = v.n AND x.k = v.k
), spots AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, unnest(range(0, n)) AS t(j) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.s, '')) AS items_sha256, coalesce(t.n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN spots s ON s.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
""",
}
