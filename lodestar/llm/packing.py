"""Best-fit packing of tokenised documents into sequences of fixed length.

A length histogram is planned on the driver: best-fit decreasing over counts, at
most one count a length, so the plan costs the same for a thousand documents as for
a trillion. Each planned run says which ranks of one length go to which sequences
and offsets; pieces take their slots by joining on (length, rank within length).
Ranks are counted in two steps, within slices of a length and over slices, so a
length that a third of all pieces have is not ranked in one task.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Chunks between white space that a task remembers, about 60 MB; beyond it half of them go.
CACHE_CHUNKS = 300_000


@dataclass(frozen=True)
class Packing:
    """``tokenizer``: path of a word-split BPE file; ``end``: the id after each document.

    Strings of the file's special tokens in a text get those tokens' ids, as the library
    has it unless told otherwise; with ``plain``, they are ordinary text.
    """

    tokenizer: str
    length: int = 4096
    end: int = 1
    plain: bool = False
    slices: int = 256
    with_ids: bool = False


class WordTokenizer:
    """Ids as ``tokenizers`` gives them, chunk by chunk.

    The file's pre-tokeniser keeps the matches of one pattern over the normalised
    text and drops what lies between, so a text's ids are its words' ids in a row,
    and each chunk between white space is encoded once. Texts beyond Latin-1 are normalised by the
    library itself; for the rest its normaliser is lower-casing.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        added = self.lib.get_added_tokens_decoder()
        self.special = {} if plain else {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.V0)
        self.cache: dict[bytes, bytes] = {}
        # Byte-level BPE sees each byte as one printable character.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.bpe = self.lib.model.tokenize

    def _normal(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.lib.normalizer.normalize_str(text)
        return text.lower()

    def _word(self, w: str) -> bytes:
        seen = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.bpe(seen)]).tobytes()

    def _encode(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text.isalpha():
            return self._word(text)
        # Most other chunks are a word and one sign.
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            head, sign = chunk[:-1], chunk[-1:]
            known = self.cache.get(head)
            if known is None:
                known = self.cache[head] = self._word(text[:-1])
            return known + (self.cache.get(sign) or self._word(text[-1]))
        return b"".join([self._word(w) for w in self.word.findall(text)])

    def ids(self, text: str) -> np.ndarray:
        """All ids of one text as little-endian unsigned 32-bit numbers."""
        if self.cut is None or not any(t in text for t in self.special):
            return np.frombuffer(self._ids(text), dtype="<u4")
        # Special tokens are found in the text as it is, and what lies between stands alone.
        return np.frombuffer(b"".join([self.special.get(t) or self._ids(t) for t in self.cut.split(text)]), dtype="<u4")

    def _ids(self, text: str) -> bytes:
        cache, out = self.cache, []
        # No match of the pattern holds white space, so each chunk between it stands alone.
        chunks = self._normal(text).encode().split()
        for at in range(0, len(chunks), CACHE_CHUNKS):
            part = chunks[at : at + CACHE_CHUNKS]
            try:
                out.append(b"".join([cache[c] for c in part]))
            except KeyError:
                for c in part:
                    if c not in cache:
                        cache[c] = self._encode(c)
                out.append(b"".join([cache[c] for c in part]))
                if len(cache) > CACHE_CHUNKS:
                    for c in list(itertools.islice(cache, len(cache) - CACHE_CHUNKS // 2)):
                        del cache[c]
        return b"".join(out)


def _pieces(p: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(p.tokenizer, p.plain)  # goes with the task, and its cache with it
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * p.with_ids
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            while part := list(itertools.islice(rows, 512)):
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d, text in part:
                    all_ids = np.append(tokenizer.ids(text or ""), np.uint32(p.end)).astype("<u4")
                    for i, at in enumerate(range(0, len(all_ids), p.length)):
                        own = all_ids[at : at + p.length]
                        doc.append(d)
                        piece.append(i)
                        start.append(at)
                        length.append(len(own))
                        crc.append(zlib.crc32(own.tobytes()))
                        if p.with_ids:
                            ids.append(own.astype(np.int32))
                cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if p.with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def plan(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs (item length, first rank, ranks, first sequence, items a sequence,
    first offset): rank ``first + r`` goes to sequence ``first sequence + r // items``
    at ``first offset + (r % items) * item length``. Each step fills the fullest
    sequences that still fit, all that are equally full at once.
    """
    open_at: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, sequences)
    runs, made = [], 0
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_at:
                open_at[room] = []
                bisect.insort(rooms, room)
            open_at[room].append((first, n))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            k = bisect.bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                first, n = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(k)
            else:
                room, first, n = length, made, -(-left // (length // size))
                made += n
            fit = room // size
            full = min(n, left // fit)
            if full:
                runs.append((size, rank, full * fit, first, fit, length - room))
                rank, left = rank + full * fit, left - full * fit
                add(room - fit * size, first, full)
            if full < n and left:
                # The last sequence takes what is left and closes this length.
                runs.append((size, rank, left, first + full, left, length - room))
                add(room - left * size, first + full, 1)
                rank, left = rank + left, 0
                add(room, first + full + 1, n - full - 1)
            elif full < n:
                add(room, first + full, n - full)
    return runs


def tokenise(docs: DataFrame, p: Packing) -> DataFrame:
    """Pieces of at most ``length`` ids: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * p.with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(p), kind)


def pack(docs: DataFrame, p: Packing) -> DataFrame:
    """One row for each piece of each row of ``docs``, with sequence_id and offset.

    ``docs`` needs doc_id and text; other columns, whatever their names, are not
    read. A null or empty text is the end id alone; a null doc_id stays null. Repeated
    rows are packed each. Only documents longer than ``length`` are cut; a sequence
    is filled from offset 0 without gaps. Pieces of equal length may take each other's
    places; ties go by doc_id, piece and content. No rows give no rows.
    """
    spark = docs.sparkSession
    pieces, _ = save(tokenise(docs, p), "pieces")
    cut = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(p.slices)).cast("int")
    pieces = pieces.withColumn("cut", cut)
    counts = pieces.groupBy("length", "cut").count()
    # At most ``length`` rows come to the driver, whatever the size of the corpus.
    histogram = {row[0]: row[1] for row in counts.groupBy("length").agg(F.sum("count")).collect()}
    earlier = Window.partitionBy("length").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "cut", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    runs: dict[int, list] = {}
    for run in plan(histogram, p.length):
        runs.setdefault(run[0], []).append(run[1:])
    plans = spark.createDataFrame([(k, v) for k, v in runs.items()], "length long, runs array<struct<rank:long,n:long,first:long,fit:long,at:long>>")
    inner = Window.partitionBy("length", "cut").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("r", F.row_number().over(inner) - 1).join(bases, ["length", "cut"]).withColumn("rank", F.col("r") + F.col("base"))
    # The plan has at most one row a length, so it may be broadcast.
    placed = ranked.join(F.broadcast(plans), "length")
    hit = F.element_at(F.filter("runs", lambda x: (F.col("rank") >= x["rank"]) & (F.col("rank") < x["rank"] + x["n"])), 1)
    placed = placed.withColumn("run", hit).withColumn("k", F.col("rank") - F.col("run.rank"))
    out = placed.withColumn("sequence_id", F.col("run.first") + F.expr("k div run.fit"))
    out = out.withColumn("offset", F.col("run.at") + (F.col("k") % F.col("run.fit")) * F.col("length"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] * p.with_ids))
