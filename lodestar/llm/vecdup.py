"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors of cosine c or more are at a squared distance of 2 - 2c or less. Split
into blocks of coordinates after a rotation, at least one block is within its share of
that budget. So each block is range-joined under its share: a vector goes to every cell
of a grid, over the block's first coordinates, that a box of the block's radius around
it meets; two vectors close enough in the block meet in a cell. What travels to all the
cells is an id and a sketch of eight bytes: the block's coordinates in 64 levels, from
which a lower bound of the distance follows. A vector follows only to cells where some
other is within the bound of it. There candidates are verified by cosine in double
precision, each pair in one place only: the first block that is within budget, and there
the smallest cell both are in.

Equal vectors form a class first. Crowded cells are compared in tiles. What leaves a
cell is a list of its vectors that have candidates, then a count and a link to the
smallest linked vector for each of those, never the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, save
from .components import connected_components
from .wordhash import mix


#: Coordinates of a sketch; squared levels that a block's squared radius spans; most blocks.
_SKETCHED, _LEVELS, _BLOCKS = 8, 20.5, 4096
_FARTHEST = 1 + int(_LEVELS**0.5)


@dataclass(frozen=True)
class VecDup:
    """Link at a cosine of ``least``; blocks of ``width`` coordinates, cells over ``grid`` (at most 4) of them.

    Vectors of more than 4,096 blocks get wider blocks.
    """

    least: float = 0.98
    width: int = 8
    grid: int = 4
    tile: int = 1024
    seed: int = 11


class Space:
    """Rotation, blocks and cells of vectors of one dimension."""

    def __init__(self, dim: int, p: VecDup):
        self.p, self.dim = p, dim
        q, r = np.linalg.qr(np.random.default_rng(p.seed).normal(size=(dim, dim)))
        self.turn = q * np.sign(np.diag(r))
        width = p.width * -(-dim // (p.width * _BLOCKS))
        self.blocks = [slice(a, min(a + width, dim)) for a in range(0, dim, width)]
        # A little more than the budget, for rounding; verification is exact.
        self.budgets = [(2 - 2 * p.least) * (b.stop - b.start) / dim + 1e-9 for b in self.blocks]

    def place(self, raw: np.ndarray) -> np.ndarray:
        # Scaled first, so that neither very small nor very large components overflow.
        x = raw / np.abs(raw).max(axis=1, keepdims=True)
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.turn

    def ranges(self, x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest cell numbers in each grid coordinate of block ``b``."""
        r = np.sqrt(self.budgets[b])
        y = x[:, self.blocks[b]][:, : self.p.grid]
        return np.floor((y - r / 2) / (2 * r)).astype(np.int64), np.floor((y + r / 2) / (2 * r)).astype(np.int64)

    def sketch(self, x: np.ndarray, b: int) -> np.ndarray:
        """Levels of the first coordinates of block ``b``, six bits each."""
        step = np.sqrt(self.budgets[b] / _LEVELS)
        y = x[:, self.blocks[b]][:, :_SKETCHED]
        level = np.clip(np.floor(y / step) + 32, 0, 63).astype(np.int64)
        return level @ (np.int64(1) << (6 * np.arange(level.shape[1], dtype=np.int64)))

    def key(self, label: np.ndarray, b: int, cell: np.ndarray) -> np.ndarray:
        k = mix(np.asarray(label).astype(np.int64).view(np.uint64) + np.uint64(self.dim * 4096 + b))
        for c in range(cell.shape[-1]):
            k = mix(k * np.uint64(31) + cell[..., c].astype(np.int64).view(np.uint64))
        return k


_spaces: dict[tuple, Space] = {}


def _space(dim: int, p: VecDup) -> Space:
    if (dim, p) not in _spaces:
        _spaces[dim, p] = Space(dim, p)
    return _spaces[dim, p]


def _rows_of(vec: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, start, size) of the lists of a column, without nulls."""
    at = vec.offsets.to_numpy().astype(np.int64)
    return vec.values.to_numpy(zero_copy_only=False), at[:-1], np.diff(at)


def _cells(p: VecDup):
    ups = [np.array(up, dtype=np.int64) for up in itertools.product((0, 1), repeat=p.grid)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                flat, start, sizes = _rows_of(part.column("vec"))
                for dim in np.unique(sizes).tolist():
                    own = np.flatnonzero(sizes == dim)
                    s = _space(dim, p)
                    x = s.place(flat[start[own][:, None] + np.arange(dim)].astype(np.float64))
                    label, cid = (part.column(c).to_numpy(zero_copy_only=False)[own] for c in ("label", "cid"))
                    keys, sketches, cids = [], [], []
                    for b in range(len(s.blocks)):
                        low, high = s.ranges(x, b)
                        sketch = s.sketch(x, b) | np.int64(b) << 52
                        wide = low < high
                        for up in ups:
                            # A box is as wide as half a cell, so it meets two cells a coordinate at most.
                            if up[low.shape[1] :].any():
                                continue
                            step = up[: low.shape[1]]
                            ok = np.flatnonzero((wide | (step == 0)).all(axis=1))
                            keys.append(s.key(label[ok], b, low[ok] + step))
                            sketches.append(sketch[ok] | np.int64(up @ (1 << np.arange(p.grid))) << 48)
                            cids.append(cid[ok])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sketches)), pa.array(np.concatenate(cids))], ["key", "sketch", "cid"])

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole cells of rows sorted by cell, with the number of each row's cell."""
    rest = None
    for batch in itertools.chain(batches, [None]):
        rows = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rows is None or not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        # The last cell may go on in the next batch.
        whole = rows.num_rows if batch is None else int(np.flatnonzero(new)[-1])
        rest = None if batch is None else rows.slice(whole)
        if whole:
            yield rows.slice(0, whole), np.cumsum(new[:whole]) - 1


def _within(level: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of sketches may be within the radius: levels tell coordinates apart but for one."""
    gap = np.maximum(np.abs(level[u] - level[v]).astype(np.int32) - 1, 0)
    return (gap * gap).sum(axis=1) <= _LEVELS


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have another within the bound in this cell, told by sketches alone."""
    for rows, group in _whole_cells(batches):
        sketch, side, i, j = (rows.column(c).to_numpy() for c in ("sketch", "side", "i", "j"))
        level = ((sketch[:, None] >> (6 * np.arange(_SKETCHED))) & 63).astype(np.int8)
        ups, alone = (sketch >> 48) & 15, i == j
        held = np.zeros(len(sketch), dtype=bool)
        cuts = np.flatnonzero(np.diff(group, prepend=-1))
        counts = np.diff(np.append(cuts, len(group)))
        small = np.repeat(counts <= 32, counts)
        for d in range(1, min(32, int(counts.max(initial=0)))):
            # Both a cell up in one coordinate meet in the cell below it too.
            k = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (alone[:-d] | (side[:-d] != side[d:])) & (ups[:-d] & ups[d:] == 0))
            k = k[_within(level, k, k + d)]
            held[k] = held[k + d] = True
        for at, size in zip(cuts[counts > 32].tolist(), counts[counts > 32].tolist(), strict=True):
            mine = np.arange(at, at + size)
            one, two = (mine, mine) if alone[at] else (mine[side[mine] == 0], mine[side[mine] == 1])
            other = np.ascontiguousarray(level[two].T)
            for a in range(0, len(one), 256):
                own = one[a : a + 256]
                near = np.ones((len(own), len(two)), dtype=bool)
                # Most pairs are too far apart in some one coordinate.
                for c in range(_SKETCHED - 1, -1, -1):
                    near &= np.abs(level[own, c][:, None] - other[c][None, :]) <= _FARTHEST
                u, v = np.nonzero(near)
                u, v = own[u], two[v]
                ok = (u != v) & (ups[u] & ups[v] == 0)
                u, v = u[ok], v[ok]
                ok = _within(level, u, v)
                held[u[ok]] = held[v[ok]] = True
        if held.any():
            kept = rows.filter(pa.array(held)).combine_chunks()
            block = (sketch[held] >> 52).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[kept.column(c).combine_chunks() for c in ("key", "i", "j", "side", "cid")], pa.array(block)], ["key", "i", "j", "side", "cid", "block"])


def _links(p: VecDup):
    """Streams rows sorted by cell; gives links counted and components of each run of whole cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in _whole_cells(batches):
            yield from _cells_linked(rows, group, p)

    return run


def _cells_linked(rows: pa.Table, group: np.ndarray, p: VecDup) -> Iterator[pa.RecordBatch]:
    flat, starts, sizes = _rows_of(rows.column("vec").combine_chunks())
    key, cid, n, label, block, side, i, j = (rows.column(c).to_numpy() for c in ("key", "cid", "n", "label", "block", "side", "i", "j"))
    key = key.view(np.uint64)
    for dim in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == dim)
        s = _space(dim, p)
        raw = flat[(starts[own][:, None] + np.arange(dim))].astype(np.float64)
        x = s.place(raw)
        a, b = _near_pairs(s, x, group[own], block[own], side[own], (i == j)[own], cid[own], p)
        a, b = _told_once(s, x, a, b, block[own], label[own], key[own])
        if not len(a):
            continue
        unit = raw / np.abs(raw).max(axis=1, keepdims=True)
        norm = np.sqrt((unit * unit).sum(axis=1))
        ok = np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) / (norm[a[k : k + 65536]] * norm[b[k : k + 65536]]) >= p.least for k in range(0, len(a), 65536)])
        u, v = own[a[ok]], own[b[ok]]
        if not len(u):
            continue
        ids, at = np.unique(cid[np.concatenate([u, v])], return_inverse=True)
        at = at.reshape(2, -1)
        count = np.bincount(at[0], weights=n[v], minlength=len(ids)) + np.bincount(at[1], weights=n[u], minlength=len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count.astype(np.int64)), pa.array(ids[_roots(len(ids), at[0], at[1])])], ["cid", "n", "to"])


def _near_pairs(s: Space, x, group, block, side, alone, cid, p: VecDup) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one cell that are near in the cell's block, of two sides or of one tile."""
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    counts = np.diff(np.append(cuts, len(group)))
    small = np.repeat(counts <= 32, counts)
    width = max(b.stop - b.start for b in s.blocks)
    y = np.zeros((len(x), width))
    most = np.zeros(len(x))
    for b, cut in enumerate(s.blocks):
        mine = block == b
        y[mine, : cut.stop - cut.start] = x[mine, cut]
        most[mine] = s.budgets[b]
    for d in range(1, min(32, int(counts.max(initial=0)))):
        k = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & (alone[:-d] | (side[:-d] != side[d:])))
        if len(k):
            k = k[((y[k] - y[k + d]) ** 2).sum(axis=1) <= most[k]]
            first.append(k)
            second.append(k + d)
    for at, size in zip(cuts[counts > 32].tolist(), counts[counts > 32].tolist(), strict=True):
        rows = np.arange(at, at + size)
        one, two = (rows, rows) if alone[at] else (rows[side[rows] == 0], rows[side[rows] == 1])
        d = (y[one] ** 2).sum(axis=1)[:, None] + (y[two] ** 2).sum(axis=1)[None, :] - 2 * (y[one] @ y[two].T)
        near = d <= most[at] + 1e-12
        if alone[at]:
            near = np.triu(near, 1)
        u, v = np.nonzero(near)
        first.append(one[u])
        second.append(two[v])
    a, b = np.concatenate(first), np.concatenate(second)
    ok = (block[a] == block[b]) & (cid[a] != cid[b])
    return a[ok], b[ok]


def _told_once(s: Space, x, a, b, block, label, key) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first near block and smallest common cell this is."""
    ok = label[a] == label[b]
    a, b = a[ok], b[ok]
    for e in range(len(s.blocks)):
        d = ((x[a, s.blocks[e]] - x[b, s.blocks[e]]) ** 2).sum(axis=1)
        ok = (block[a] <= e) | (d > s.budgets[e])
        a, b = a[ok], b[ok]
    for e in range(len(s.blocks)):
        low, _ = s.ranges(x, e)
        here = block[a] == e
        cell = np.maximum(low[a], low[b])
        ok = ~here
        ok[here] = s.key(label[a[here]], e, cell[here]) == key[a[here]]
        a, b = a[ok], b[ok]
    return a, b


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each node is joined to by the pairs."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, u, was[v])
        np.minimum.at(root, v, was[u])
        root = root[root]
        if (root == was).all():
            return root


def near_vectors(rows: DataFrame, p: VecDup = VecDup()) -> DataFrame:
    """One row for each row of ``rows``: vec_id, n_links, component_id, kept.

    ``rows`` needs vec_id, embedding (an array of numbers) and label; other columns,
    whatever their names, are not read. Only vectors of equal label and length are
    compared. A vector that is null, empty, zero, or holds a null, NaN or infinity,
    and one whose label is null, links with nothing: 0 links, itself its component,
    kept. Equal rows are vectors of their own that link with each other, whatever
    their ids; a null vec_id is never a component's smallest. An empty table gives an
    empty table.
    """
    spark = rows.sparkSession
    held = rows.schema["embedding"].dataType
    # Vectors travel as they are stored; numbers that are not floats become doubles.
    vec = F.col("embedding").cast("array<float>" if isinstance(held.elementType, T.FloatType) else "array<double>")
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    good &= F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    label = F.when(F.col("label").cast("long").isNotNull(), F.col("label").cast("long"))
    marked = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.when(F.coalesce(good, F.lit(False)), vec).alias("vec"))
    live = F.col("vec").isNotNull()
    ids = marked.withColumn("cid", F.when(live, F.xxhash64("label", "vec")))
    classes, path = save(ids.where(live).groupBy("cid").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec")), "vectors")
    paths = [path]
    # Made twice, which costs less than to write them.
    cells = classes.select("cid", "label", "vec").mapInArrow(_cells(p), "key long, sketch long, cid long")
    crowd = cells.groupBy("key").count().where(f"count > {p.tile}").select("key", F.ceil(F.col("count") / p.tile).cast("int").alias("tiles"))
    crowd, path = save(crowd, "crowds")
    paths.append(path)
    dealt = cells.join(crowd, "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("t", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
    side = F.when(F.col("t") <= F.col("o"), 0).otherwise(1)
    dealt = dealt.select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), side.alias("side"), "sketch", "cid")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    near, path = save(dealt.mapInArrow(_candidates, "key long, i int, j int, side int, cid long, block int"), "candidates")
    paths.append(path)
    met = near.join(classes.select("cid", "n", "label", "vec"), "cid")
    sorted_cells = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    found, path = save(sorted_cells.select("key", "i", "j", "side", "block", "cid", "n", "label", "vec").mapInArrow(_links(p), "cid long, n long, to long"), "found")
    paths.append(path)
    linked = found.groupBy("cid").agg(F.sum("n").alias("more"))
    parts, path = connected_components(found.select(F.col("cid").alias("u"), F.col("to").alias("v")))
    paths.append(path)
    named = classes.select("cid", "n", "low").join(parts, F.col("cid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cid")).join(linked, "cid", "left")
    lows = named.groupBy("part").agg(F.min("low").alias("component_id"))
    whole, _ = save(named.join(lows, "part").select("cid", "component_id", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "components")
    forget(spark, *paths)
    out = ids.select("vec_id", "cid").join(whole, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
