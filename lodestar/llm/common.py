"""Shared folder handling and small helpers for the text operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    ``spark.checkpoint.dir`` is set by a cluster. Only where it is unset (tests,
    a single machine) is a folder of this machine chosen.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        named = f"file://{os.path.join(tempfile.gettempdir(), 'lodestar-shared')}"
        spark.sparkContext.setCheckpointDir(named)
    return named


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a table in the shared folder and read it back.

    This cuts lineage and survives lost executors. The files go when the
    driver's JVM ends, or earlier through :func:`forget`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lodestar/{what}-{uuid.uuid4().hex}"
    p, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for path in paths:
        p, fs = _hadoop_path(spark, path)
        fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe_key(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def byte_chunks(text: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """Slices of a text column of about ``most`` bytes: first row, end row, texts.

    A null counts as an empty text. One text is never cut, however long.
    """
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    raw = [b"" if x is None else x for x in text.cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(raw):
        end, held = at, 0
        while end < len(raw) and (end == at or held + len(raw[end]) <= most):
            held += len(raw[end])
            end += 1
        yield at, end, raw[at:end]
        at = end


def as_list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))
