"""Queries of the text operators, by name, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import chats, classify, dedup, lines, packed, shards, webpages

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**chats.QUERIES, **classify.QUERIES, **dedup.QUERIES, **lines.QUERIES, **packed.QUERIES, **shards.QUERIES, **webpages.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**chats.SQL, **classify.SQL, **dedup.SQL, **lines.SQL, **packed.SQL, **shards.SQL, **webpages.SQL}
