"""Bounded, repeatable samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null where the id is null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def sample_ids(rows: DataFrame, label: str, most: int, labels: int) -> DataFrame:
    """(doc_id, label, rows_of_label): at most ``most`` rows of each of the ``labels`` commonest labels.

    Which rows depends on their ids alone. Rows are thinned by hash before they are
    ranked, so ranking costs the sample, not the table.
    """
    rows = rows.where(f"doc_id is not null and `{label}` is not null").select("doc_id", F.col(label).alias("label"))
    sizes = rows.groupBy("label").agg(F.count("*").alias("rows_of_label")).orderBy(F.desc("rows_of_label"), "label").limit(labels)
    h = F.xxhash64(F.lit(41), "doc_id")
    share = F.lit(2.0 * most) / F.col("rows_of_label")
    thin = rows.join(F.broadcast(sizes), "label").where(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30) + 64)
    rank = F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id"))
    return thin.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank").dropDuplicates(["doc_id"])
