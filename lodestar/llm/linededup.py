"""Line dedup: keep the first occurrence of each repeated line of a corpus.

Hashes of line keys are range-partitioned together with document and position, and
sorted so; each partition streams its runs and sees first occurrences. As the range
also splits on document and position, a line that a third of all documents hold is
spread over many partitions; where a run goes on from an earlier partition, the
first document of that run is looked up in a table of one row a partition. What
comes back is, for each document with dropped lines, one compressed bitmap of the
lines to keep. Texts are not moved until bitmaps are applied.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save

_SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineDedup:
    """Keys of at least ``least`` code points count; a partition gets about ``rows`` lines."""

    least: int = 10
    rows: int = 2_000_000


def _lines():
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _row_key():
    return F.xxhash64("doc_id", "text")


def line_hashes(docs: DataFrame, p: LineDedup) -> DataFrame:
    """(a, b, doc_id, row_key, pos) of each line that may be dropped; a and b are a 128-bit hash."""
    pieces = docs.where("doc_id is not null").select("doc_id", _row_key().alias("row_key"), F.posexplode(_lines()).alias("pos", "line"))
    # Key code points never outnumber the line's; short lines go before any regex.
    pieces = pieces.where(F.length("line") >= p.least)
    key = F.translate(F.regexp_replace("line", _SPACE, ""), _UPPER, _LOWER)
    pieces = pieces.select("doc_id", "row_key", "pos", key.alias("key")).where(F.length("key") >= p.least)
    return pieces.select(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), F.reverse("key")).alias("b"), "doc_id", "row_key", "pos")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds. 0: drop this line. 1: drop it if the run began earlier with a
    smaller document. 2: the last run of this partition, with its first document."""
    last, first_doc, opening = None, None, True
    part = np.int32(-1)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, doc, key, pos, where = (batch.column(n).to_numpy() for n in ("a", "b", "doc_id", "row_key", "pos", "part"))
        part = where[0]
        n = len(a)
        new = np.ones(n, dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new[0] = last is None or (a[0], b[0]) != last
        run = np.cumsum(new) - 1
        starts = doc[new]
        heads = np.concatenate([[first_doc if first_doc is not None and not new[0] else 0], starts]) if not new[0] else starts
        firsts = heads[run + (0 if new[0] else 1)]
        in_opening = np.zeros(n, dtype=bool)
        if opening:
            begun = 0 if last is None else -1
            in_opening = run == begun
            opening = bool(in_opening[-1])
        drop = doc != firsts
        kinds = np.where(drop, 0, np.where(in_opening, 1, -1)).astype(np.int32)
        keep = kinds >= 0
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (kinds, a, b, doc, key, pos, where)], ["kind", "a", "b", "doc_id", "row_key", "pos", "part"])
        last, first_doc = (a[-1], b[-1]), firsts[-1]
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in ((2, pa.int32()), (last[0], pa.int64()), (last[1], pa.int64()), (first_doc, pa.int64()), (0, pa.int64()), (0, pa.int32()), (part, pa.int32()))], ["kind", "a", "b", "doc_id", "row_key", "pos", "part"])


def pack_bits(n_lines: int, dropped: list[int]) -> bytes:
    """A zlib-compressed bitmap, one bit a line, set where the line stays."""
    bits = np.ones(-(-n_lines // 8) * 8, dtype=np.uint8)  # what pads the last byte stays
    bits[np.asarray(dropped, dtype=np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n_lines].astype(bool)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("dropped").to_pylist()
        bits = pa.array([pack_bits(max(x) + 1, x) for x in lists], type=pa.binary())
        sizes = pa.array([len(x) for x in lists], type=pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), sizes, bits], ["doc_id", "row_key", "n_dropped", "bitmap"])


def keep_bitmaps(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(doc_id, row_key, n_dropped, bitmap) for each document that loses lines.

    Lines after the end of a bitmap stay. ``row_key`` tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    rows, path = save(line_hashes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), p), "lines")
    n = max(rows.count() // p.rows + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["a", "b", "doc_id", "row_key", "pos"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    kinds, kinds_path = save(dealt.mapInArrow(_stream, "kind int, a long, b long, doc_id long, row_key long, pos int, part int"), "runs")
    forget(spark, path)
    ends = kinds.where("kind = 2").select("a", "b", F.col("doc_id").alias("first_doc"), F.col("part").alias("end_part"))
    # Documents ascend within a key, so of all partitions that end in it the first has the
    # smallest, and that decides for the openings of all later ones.
    ends = ends.groupBy("a", "b").agg(F.min("first_doc").alias("first_doc"), F.min("end_part").alias("end_part"))
    doubt = kinds.where("kind = 1").join(F.broadcast(ends) if n <= 10_000 else ends, ["a", "b"]).where("end_part < part and first_doc < doc_id").select("doc_id", "row_key", "pos").distinct()
    drops = kinds.where("kind = 0").select("doc_id", "row_key", "pos").union(doubt)
    lists = drops.groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))
    return lists.mapInArrow(_bitmaps, "doc_id long, row_key long, n_dropped long, bitmap binary")


def _apply(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts, bits = batch.column("text").to_pylist(), batch.column("__bitmap").to_pylist()
            out = []
            for t, bitmap in zip(texts, bits, strict=True):
                if bitmap is not None:
                    lines = t.split("\n")
                    stay = np.ones(len(lines), dtype=bool)
                    known = unpack_bits(bitmap, len(lines))
                    stay[: len(known)] = known
                    t = "\n".join(x for x, keep in zip(lines, stay.tolist(), strict=True) if keep)
                out.append(t)
            cols = [batch.column(n) for n in names]
            cols[at] = pa.array(out, type=pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def with_bitmaps(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with __n_dropped (0 where nothing goes) and __bitmap (null there)."""
    bits = keep_bitmaps(docs, p).select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("n_dropped").alias("__n_dropped"), F.col("bitmap").alias("__bitmap"))
    both = docs.withColumn("__row", _row_key()).join(bits.hint("shuffle_hash"), (F.col("doc_id") == F.col("__id")) & (F.col("__row") == F.col("__key")), "left")
    return both.drop("__id", "__key", "__row").withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0).cast("long")))


def dedup_lines(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and a long column ``n_dropped``.

    A text is split at line feeds. A line's key is the line without ASCII white space
    at both ends, A-Z lower-cased. A key of ``least`` or more code points that two or
    more doc_ids hold stays in the smallest doc_id only, there in all its lines. Null
    text: one empty line, never dropped, and it stays null. Rows with a null doc_id
    take no part and stay whole. Rows that share a doc_id are one document. Other
    columns stay; those named ``n_dropped``, or ``__bitmap``, ``__n_dropped``,
    ``__row``, ``__id`` and ``__key``, are replaced. An empty table gives an empty one.
    """
    plain = docs.drop("n_dropped", "__bitmap", "__n_dropped", "__row", "__id", "__key")
    both = with_bitmaps(plain, p)
    names = [*plain.columns, "n_dropped"]
    src = both.withColumnRenamed("__n_dropped", "n_dropped")
    return src.mapInArrow(_apply(names), src.select(*[F.col(f"`{n}`") for n in names]).schema)
