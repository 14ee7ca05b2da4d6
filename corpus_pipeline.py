"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it
as Parquet and pass what it reads back to the next. All but the last return the columns
of ``documents``. Each stage's docstring says what leaves; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, linededup, neardup, packing, toxicity
from lodestar.llm.common import save, table
from lodestar.llm.queries.packed import packing as packing_of

#: Classifier, hashing and packing have no SQL form; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, calls toxic leave."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines leave their texts, save in the smallest doc_id; every document stays. n_chars follows."""
    found = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return found.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with half or more of the windows of one benchmark item, or windows of two or more items, leave."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), decontam.Decontaminate(share=0.5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left is tokenised and packed; one row a piece."""
    return packing.pack(docs, packing_of())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
