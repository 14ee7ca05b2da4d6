"""MinHash near-duplicate detection.

Many universal hash minima with banding propose pairs, full shingle sets confirm
them, and alternating large-star and small-star joins the confirmed links.

How groups of copies are kept in bounds:

* Equal shingle sets form a class first; only one representative of a class goes on.
* A bucket links its members to its smallest member only. After components are
  known, the members of buckets that still hold several components meet under that
  smallest member, in cells of two tiles, where pairs of different components are
  judged on full sets; only links come out. So every pair
  that shares a bucket is judged, or lies in one component already.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list_array, byte_chunks, forget, save
from .components import connected_components
from .wordhash import SPACED, grams, hash_words, mix

TILE = 512


@dataclass(frozen=True)
class NearDup:
    """``words`` a shingle; link at ``percent`` or more; ``bands`` of ``rows`` minima.

    A pair at 0.8 shares no band with probability (1 - 0.8**5)**40 = 1.3e-7.
    """

    words: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    seed: int = 1


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    words, counts = hash_words(texts, SPACED)
    at = 0
    for c in counts.tolist():
        own = words[at : at + c]
        at += c
        yield np.unique(grams(own, n) if c >= n else grams(own, c) if c else own)


@functools.lru_cache(maxsize=4)
def _hashes(k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]


def _minima(items: np.ndarray, p: NearDup) -> np.ndarray:
    """The smallest value of each hash over a set that is not empty."""
    mul, add = _hashes(p.bands * p.rows, p.seed)
    x = (items >> np.uint64(32)).astype(np.uint32)
    best = None
    for c in range(0, len(x), 4096):
        part = (x[None, c : c + 4096] * mul + add).min(axis=1)
        best = part if best is None else np.minimum(best, part)
    return best


def _profile(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = p.bands * p.rows
        salt = mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in batches:
            for a, b, texts in byte_chunks(batch.column("text")):
                m = b - a
                sizes, low = np.zeros(m, np.int64), np.zeros((m, k), np.uint32)
                ids = np.zeros((m, 2), np.uint64)
                for i, s in enumerate(_sets(texts, p.words)):
                    sizes[i] = len(s)
                    if len(s):
                        ids[i] = s.sum(), mix(s).sum()
                        low[i] = _minima(s, p)
                key = np.zeros((m, p.bands), np.uint64)
                for r in range(p.rows):
                    key = mix(key * np.uint64(31) + low[:, r :: p.rows].astype(np.uint64) + salt)
                held = sizes > 0
                counts = np.where(held, p.bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, m),
                        pa.array(sizes),
                        pa.array(ids[:, 0].view(np.int64)),
                        pa.array(ids[:, 1].view(np.int64)),
                        as_list_array(key[held].view(np.int64).ravel(), counts, pa.int64()),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
                )

    return run


def _full_sets(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in byte_chunks(batch.column("text")):
                sets = list(_sets(texts, p.words))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), as_list_array(flat.view(np.int64), np.array([len(s) for s in sets]), pa.int64())], ["doc_id", "items"])

    return run


def _compare_tiles(p: NearDup):
    def run(cell: pa.Table) -> pa.Table:
        """Links between the two sides of a cell, of different components, by exact intersections."""
        sides = []
        column = cell.column("side").to_numpy()
        for s in (0, 1):
            own = cell.filter(pa.array(column == s)).combine_chunks()
            sets = [x.values.to_numpy().view(np.uint64) for x in own.column("items")]
            sides.append((own.column("doc").to_numpy(), own.column("component").to_numpy(), sets))
        (doc, part, sets), (doc2, part2, sets2) = sides
        u, v = [], []
        sizes = np.array([len(x) for x in sets2], np.int64)
        flat = np.concatenate(sets2) if sets2 else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], np.repeat(np.arange(len(sets2)), sizes)[order]
        for i, own in enumerate(sets):
            n = len(own)
            near = (part2 != part[i]) & (100 * np.minimum(sizes, n) >= p.percent * np.maximum(sizes, n))
            if not near.any():
                continue
            first = np.searchsorted(flat, own)
            runs = np.searchsorted(flat, own, "right") - first
            at = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            shared = np.bincount(holder[at], minlength=len(doc2))
            for j in np.flatnonzero(near & (100 * shared >= p.percent * (n + sizes - shared))):
                u.append(int(doc[i]))
                v.append(int(doc2[j]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _confirm(pairs: DataFrame, sets: DataFrame, p: NearDup) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b"))
    both = pairs.join(left, "u").join(right, "v").withColumn("shared", F.size(F.array_intersect("a", "b")).cast("long"))
    union = F.size("a") + F.size("b") - F.col("shared")
    return both.where(100 * F.col("shared") >= p.percent * union).select("u", "v")


def near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id (an integer) and text; other columns, whatever their
    names, are not read. Null, empty and wordless texts have no shingles, link with
    nothing and are kept. A text of fewer words than a shingle is one shingle. Rows
    that share a doc_id are one document, in the component of any of them. A row
    whose doc_id is null links with nothing: its component_id is null, kept is true.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = save(docs.mapInArrow(_profile(p), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"), "minima")
    live = rows.where("n_shingles > 0 and doc_id is not null")
    # Rows of a class have the same keys.
    classes, _ = save(live.groupBy("set_a", "set_b", F.col("n_shingles").alias("set_n")).agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")), "classes")
    paths: list[str] = []

    # A document is in as many classes as it has rows of different texts; those are links too.
    same = live.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, (live.set_a == classes.set_a) & (live.set_b == classes.set_b) & (live.n_shingles == classes.set_n)).select("doc_id", "rep")
    twice = live.select("doc_id", "set_a", "set_b").distinct().groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = same.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))

    buckets = classes.select(F.explode("keys").alias("bucket"), F.col("rep").alias("doc"))
    hubs = buckets.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").select("bucket", "hub")
    shared, path = save(buckets.join(hubs, "bucket"), "buckets")
    paths.append(path)
    stars = shared.where("doc <> hub").select(F.col("hub").alias("u"), F.col("doc").alias("v")).distinct()
    wanted = shared.select(F.col("doc").alias("doc_id")).distinct()
    sets = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets(p), "doc_id long, items array<long>")
    sets, path = save(sets, "sets")
    paths.append(path)
    links, path = save(_confirm(stars, sets, p).union(own), "links")
    paths.append(path)
    first, path = connected_components(links)
    paths.append(path)

    # Buckets that hold several components still: their members meet under the bucket's
    # smallest member, once for all bands, and are compared in cells of two tiles.
    named = shared.join(first, F.col("doc") == F.col("node"), "left").select("bucket", "hub", "doc", F.coalesce("component", "doc").alias("component"))
    mixed = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi and n > 2").select("bucket")
    family, path = save(named.join(mixed, "bucket", "left_semi").select("hub", "doc", "component").distinct(), "families")
    paths.append(path)
    tiles = family.groupBy("hub").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    mine = F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")
    cells = family.join(tiles, "hub").withColumn("t", mine).withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    # A tile meets itself and every other tile once; side 0 is the tile of the smaller number.
    side = F.when(F.col("t") == F.col("o"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.when(F.col("t") < F.col("o"), 0).otherwise(1)))
    cells = cells.select("hub", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), F.explode(side).alias("side"), "doc", "component")
    parts = sets.select(F.col("doc_id").alias("m_doc"), "items")
    cells = cells.join(parts, F.col("doc") == F.col("m_doc")).drop("m_doc")
    late, path = save(cells.groupBy("hub", "i", "j").applyInArrow(_compare_tiles(p), "u long, v long").distinct(), "links")
    paths.append(path)
    last, _ = connected_components(late.union(first.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    forget(spark, *paths)

    keyed = rows.select("doc_id", "n_shingles", "set_a", "set_b")
    known = classes.join(last, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", F.col("set_n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
    out = keyed.join(known, ["set_a", "set_b", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, p: NearDup = NearDup()) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all columns."""
    found = near_duplicates(docs, p).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs["doc_id"] == F.col("__gone"), "left_anti")
