"""Best-fit packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..packing import Packing, pack


def packing() -> Packing:
    import public_tokenizers

    return Packing(tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), packing())


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
