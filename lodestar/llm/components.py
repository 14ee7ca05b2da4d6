"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    near = _both_ways(edges)
    low = near.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("w"), F.least("u", "low").alias("m"))
    out = near.where("v > u").join(low, F.col("u") == F.col("w"))
    return out.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = down.join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select(F.col("w").alias("u"), F.col("m").alias("v")))


def connected_components(edges: DataFrame, most_rounds: int = 100) -> tuple[DataFrame, str]:
    """(node, component) for each node that is not the smallest of its component.

    ``edges`` has long columns ``u`` and ``v``; loops, repeated and null ends are
    ignored. Stars are joined to a minimum by aggregates and joins alone, so a node
    with very many neighbours is never gathered in one row, and each round is
    written to the shared folder. Nothing but one count and one checksum a round
    reaches the driver. Returns the table and its path, for ``forget``.
    """
    spark = edges.sparkSession
    now = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = save(now, "edges")
    seen = None
    for _ in range(most_rounds):
        step = _small_star(_large_star(now).where("u <> v").distinct()).where("u <> v").distinct()
        step, new = save(step, "edges")
        mark = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(spark, path)
        now, path = step, new
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")), path
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
