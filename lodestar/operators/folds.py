"""Batch folds of the step kernels: one pass over each key's rows in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.steps import Cooldown
from ..semantics import settled


def fold(df: DataFrame, by: list[str], order: list[str], kernel, value: str, at: str | None = None) -> DataFrame:
    """``df`` with the kernel's outputs; a reading it skips has none.

    Rows are sorted within the partition of their key and streamed, batch by batch, with
    one state a key, so neither a long series nor many keys are held in memory.
    """
    extra = T._parse_datatype_string(kernel.out)
    names = [f.name for f in extra.fields]
    plain = df.drop(*names)
    schema = T.StructType([*plain.schema.fields, *extra.fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, kernel.start()
        for pdf in parts:
            keys = list(pdf[by].itertuples(index=False, name=None)) if by else [()] * len(pdf)
            xs = [None if pd.isna(x) else x for x in pdf[value]]
            ts = pdf[at].tolist() if at else [None] * len(pdf)
            out = []
            for k, x, t in zip(keys, xs, ts, strict=True):
                if k != key:
                    key, state = k, kernel.start()
                state, got = kernel.step(state, x, t)
                out.append(got if got is not None else (None,) * len(names))
            for i, n in enumerate(names):
                pdf[n] = pd.Series([o[i] for o in out], index=pdf.index, dtype=object)
            yield pdf

    dealt = plain.repartition(*[F.col(c) for c in by]) if by else plain.coalesce(1)
    return dealt.sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def shared_clock(df: DataFrame, arrival: str, at: str, out: str = "clock") -> DataFrame:
    """Latest time seen by any row so far, in order of ``arrival``.

    Rows are range-partitioned by arrival; a partition's running maximum starts from the
    largest of all earlier partitions, a table of one row a partition. The dealt rows are
    written once, because ranges are sampled and partitions coalesced anew each time a
    plan runs, and both sides of the join must see the same ones.
    """
    dealt = settled(df.repartitionByRange(F.col(arrival)).withColumn("__p", F.spark_partition_id()))
    dealt = dealt.withColumn("__r", F.max(at).over(Window.partitionBy("__p").orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)))
    tops = dealt.groupBy("__p").agg(F.max(at).alias("__top"))
    tops = tops.withColumn("__before", F.max("__top").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))).select("__p", "__before")
    return dealt.join(tops, "__p").withColumn(out, F.greatest("__r", "__before")).drop("__p", "__r", "__before")


def cooldown(df: DataFrame, by: list[str], arrival: str, at: str, period_ns: int) -> DataFrame:
    """Allowed once ``period_ns`` have gone since the key's last that was; the clock is shared by all keys."""
    timed = shared_clock(df, arrival, at, "__clock").withColumn("__x", F.lit(0.0))
    return fold(timed, by, [arrival], Cooldown(period_ns), "__x", "__clock").drop("__clock", "__x")
