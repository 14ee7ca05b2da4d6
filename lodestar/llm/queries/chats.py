"""Chat formatting of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chat import format_chats, read_loss, read_turns
from ..common import table

_PROBE = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    chats = format_chats(rows.union(probe)).withColumn("turns", read_turns(F.col("text"))).withColumn("loss", read_loss(F.col("segments")))
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
        "ordered",
        F.col("bad_turn").cast("long").alias("bad_turn"),
    )


QUERIES = {"op3_chat_formatting": op3_chat_formatting}

SQL = {
    "op3_chat_formatting": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'
), coded AS (
  SELECT *, row_number() OVER w - 1 AS i, coalesce(lag(role) OVER w, 'start') AS was, lead(role) OVER w AS next,
    length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) AS n,
    length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) AS m
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, n + CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 9 WHEN 'assistant' THEN 6 + 4 ELSE m + 7 + 7 + 8 END AS size,
    (was || '>' || role) NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS bad
  FROM coded
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars,
  NOT bool_or(bad) AND bool_or(role = 'assistant' AND next IS NULL) AS ordered,
  CAST(coalesce(min(i) FILTER (bad), -1) AS BIGINT) AS bad_turn
FROM judged GROUP BY conv_id
"""
}
