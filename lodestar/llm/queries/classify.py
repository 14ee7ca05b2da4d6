"""Language identification and toxicity of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import langid, toxicity
from ..common import table


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a letter gets a language, as its contract has it, so nothing is too far here."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.held_out(4, 2)
    model = langid.fit(docs.where(~out))
    found = langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), model, langid.LangId(least=0.0))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = langid.held_out(5, 0)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    found = toxicity.score_toxicity(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op6_language_id": op6_language_id, "op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
