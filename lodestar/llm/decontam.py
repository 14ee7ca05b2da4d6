"""Benchmark decontamination by winnowing.

A shared span of ``window`` words holds ``window - k + 1`` k-grams. Both sides keep
the smallest k-gram hash of each run of that many, so every shared span puts the
same fingerprint on both sides. Training fingerprints found among the test
fingerprints are hits; each hit is extended to the windows around it, which are
compared in full. Test items shorter than a window are one window of their own
length, found by their whole hash.

The test side goes to the workers in blocks of about ``block_bytes`` of text, measured
before, as sorted arrays of about five times that size. Usually that is one block; more
blocks mean more passes over the documents, whose hit positions are then united.
Documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_list_array, byte_chunks
from .wordhash import ALNUM, grams, hash_words


@dataclass(frozen=True)
class Decontaminate:
    """``window`` words make a hit; ``k`` a fingerprint; ``items`` hit items contaminate a document.

    So does ``share`` of the different windows of any one item; above 1, no share does.
    """

    window: int = 8
    k: int = 5
    items: int = 2
    block_bytes: int = 8 << 20
    share: float = 2.0


def _winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Positions whose hash is the smallest of some ``run`` consecutive ones (all of them, on ties)."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    run = min(run, n)
    lows = np.lib.stride_tricks.sliding_window_view(hashes, run).min(axis=1)
    kept = np.zeros(n, dtype=bool)
    for d in range(run):
        kept[d : d + len(lows)] |= hashes[d : d + len(lows)] == lows
    return np.flatnonzero(kept)


class Index:
    """Fingerprints and windows of one block of test items, in sorted arrays."""

    def __init__(self, ids: list[str], texts: list[bytes], p: Decontaminate):
        self.p, self.ids = p, ids
        words, counts = hash_words(texts, ALNUM)
        prints = [np.zeros(0, np.uint64)]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.sizes = np.zeros(len(ids), np.int64)
        at = 0
        for item, n in enumerate(counts.tolist()):
            own = words[at : at + n]
            at += n
            if not n:
                continue
            size = min(n, p.window)
            different = np.unique(grams(own, size))
            self.sizes[item] = len(different)
            found.setdefault(size, []).append((different, np.full(len(different), item, np.int32)))
            if n >= p.window:
                g = grams(own, p.k)
                prints.append(g[_winnow(g, p.window - p.k + 1)])
        self.prints = np.unique(np.concatenate(prints))
        # By the size of a window: its hashes, and the items of each.
        self.sorted: dict[int, np.ndarray] = {}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, parts in found.items():
            hashes, items = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(hashes, kind="stable")
            self.sorted[size], first = np.unique(hashes[order], return_index=True)
            self.items[size] = np.append(first, len(order)), items[order]

    def items_of(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """The items of each of some windows that are known, one after the other."""
        cut, items = self.items[size]
        at = np.searchsorted(self.sorted[size], hashes)
        return np.concatenate([items[cut[k] : cut[k + 1]] for k in at])

    def _among(self, x: np.ndarray, known: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(x), dtype=bool)
        at = np.searchsorted(known, x)
        at[at == len(known)] = 0
        return known[at] == x

    def hits(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, set[str], float]]:
        """(text number, positions of hit words, items, largest share of an item's windows) of each text that has any hit."""
        p = self.p
        text_of = np.repeat(np.arange(len(counts)), counts)
        first = np.concatenate([[0], np.cumsum(counts)])
        where: list[np.ndarray] = []  # of a window: start, words
        for n, known in self.sorted.items():
            if len(words) < n:
                continue
            if n == p.window:
                g = grams(words, p.k)
                kept = _winnow(g, p.window - p.k + 1)
                kept = kept[self._among(g[kept], self.prints)]
                near = (kept[:, None] - np.arange(p.window - p.k + 1)[None, :]).ravel()
                near = np.unique(near[(near >= 0) & (near + n <= len(words))])
            else:
                near = np.arange(len(words) - n + 1)
            near = near[text_of[near] == text_of[near + n - 1]]
            full = np.full(len(near), n, dtype=np.uint64)
            if n == p.window:
                full = grams_at(words, near, n)
            else:
                full = grams(words, n)[near]
            ok = self._among(full, known)
            if ok.any():
                where.append(np.stack([near[ok], np.full(ok.sum(), n), full[ok].view(np.int64)], axis=1))
        if not where:
            return
        found = np.concatenate(where)
        found = found[np.argsort(text_of[found[:, 0]], kind="stable")]
        texts = text_of[found[:, 0]]
        cuts = np.flatnonzero(np.diff(texts)) + 1
        for own in np.split(found, cuts):
            doc = int(text_of[own[0, 0]])
            mask = np.zeros(counts[doc] + 1, dtype=np.int64)
            rel = own[:, 0] - first[doc]
            np.add.at(mask, rel, 1)
            np.add.at(mask, rel + own[:, 1], -1)
            held = []
            for size in np.unique(own[:, 1]).tolist():
                held.append(self.items_of(size, np.unique(own[own[:, 1] == size, 2].view(np.uint64))))
            items, many = np.unique(np.concatenate(held), return_counts=True)
            yield doc, np.flatnonzero(np.cumsum(mask)[:-1] > 0), {self.ids[i] for i in items.tolist()}, float((many / self.sizes[items]).max())


def grams_at(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """As :func:`wordhash.grams`, only at the given starts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return grams(words[(starts[:, None] + np.arange(n)[None, :])].ravel(), n)[::n]


#: The index of the block in use, one for each worker process.
_built: dict[str, Index] = {}


def _index_of(name: str, held, p: Decontaminate) -> Index:
    if name not in _built:
        _built.clear()
        _built[name] = Index(*held.value, p)
    return _built[name]


def _scan(held, p: Decontaminate):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(name, held, p)
        for batch in batches:
            for a, b, texts in byte_chunks(batch.column("text")):
                words, counts = hash_words(texts, ALNUM)
                spots: list[np.ndarray] = [np.zeros(0, np.int64)] * (b - a)
                items: list[list[str]] = [[]] * (b - a)
                covered = np.zeros(b - a)
                for doc, at, own, most in index.hits(words, counts):
                    spots[doc], items[doc], covered[doc] = at, sorted(own), most
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("__row").slice(a, b - a),
                        pa.array(counts.astype(np.int64)),
                        as_list_array(np.concatenate(spots), np.array([len(x) for x in spots]), pa.int32()),
                        pa.array(items, type=pa.list_(pa.string())),
                        pa.array(covered),
                    ],
                    ["row", "n_words", "spots", "items", "covered"],
                )

    return run


def _blocks(items: DataFrame, p: Decontaminate) -> Iterator[tuple[list[str], list[bytes]]]:
    """The test items in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // (p.block_bytes // 2)) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows or n == 1:
            yield [r[0] for r in rows], [r[1].encode() for r in rows]


def contamination(docs: DataFrame, bench: DataFrame, p: Decontaminate = Decontaminate(), keep_text: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its row struct as ``row``, n_words, spots, items, covered, contaminated.

    ``docs`` needs text, ``bench`` item_id and text; other columns, whatever their
    names, ride along inside ``row``, text only if asked for. ``spots`` are the positions of hit
    words, ``items`` the sorted ids (as strings) of items with a window in the text, ``covered`` the
    largest share of the different windows of one item that are in the text.
    Null and empty texts have no words and no hits; an item without words or whose id
    is null is in no document. Repeated items count once by their id. An empty table
    of items hits nothing; an empty table of documents gives an empty table.
    """
    spark = docs.sparkSession
    items = bench.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    carried = [c for c in docs.columns if keep_text or c != "text"]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried], F.xxhash64("text").alias("__text_key")).alias("__row"), "text")
    parts = []
    told = T._parse_datatype_string("n_words long, spots array<int>, items array<string>, covered double")
    kinds = T.StructType([T.StructField("row", src.schema["__row"].dataType), *told.fields])
    for block in _blocks(items, p):
        held = spark.sparkContext.broadcast(block)
        parts.append(src.mapInArrow(_scan(held, p), kinds))
    found = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            found = found.union(part)
        key = F.xxhash64("row", "n_words")
        hit = found.where("size(items) > 0").groupBy("row", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spots")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("i"), F.max("covered").alias("c")).withColumn("k", key)
        all_rows = parts[0].select("row", "n_words").withColumn("k", key)
        none_s, none_i = F.array().cast("array<int>"), F.array().cast("array<string>")
        found = all_rows.alias("a").join(hit.alias("h"), (F.col("a.k") == F.col("h.k")) & F.col("a.row").eqNullSafe(F.col("h.row")), "left").select("a.row", "a.n_words", F.coalesce("h.s", none_s).alias("spots"), F.coalesce("h.i", none_i).alias("items"), F.coalesce("h.c", F.lit(0.0)).alias("covered"))
    return found.withColumn("contaminated", (F.size("items") >= p.items) | (F.col("covered") >= p.share))


def drop_contaminated(docs: DataFrame, bench: DataFrame, p: Decontaminate = Decontaminate()) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the same columns."""
    found = contamination(docs, bench, p, keep_text=True).where("not contaminated")
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
