"""Rules decided once: missing values, guards, arrival order.

A missing number is null or NaN; ``finite`` is false for both and for infinities.
Aggregates that must show a missing value return NaN, as the operators' users expect.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def window(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def running(by: list[str], order: list[str]):
    return window(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(by: list[str], order: list[str]):
    return window(by, order).rowsBetween(Window.unboundedPreceding, -1)


def accepted(df: DataFrame, by: list[str], arrival: list[str], at: str, value: str) -> DataFrame:
    """Readings that move time forward: finite, and later than every finite one before.

    A reading that is not finite does not advance the clock.
    """
    ok = df.where(finite(F.col(value)))
    last = F.max(at).over(before(by, arrival))
    return ok.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(at) > F.col("__last"))).drop("__last")


def clamped(by: list[str], arrival: list[str], at: str) -> Column:
    """Time that never goes back: a late reading counts at the latest time seen."""
    return F.max(at).over(running(by, arrival))


def shared_folder(spark) -> str:
    """A new folder name in the place every executor sees; one of this machine only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else f"file://{tempfile.gettempdir()}/lodestar-shared"
    return f"{named.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so later plans do not grow with its own."""
    spark = df.sparkSession
    path = shared_folder(spark)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
