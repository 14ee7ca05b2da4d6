import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lodestar.llm import neardup, vecdup
from lodestar.llm.components import connected_components

from . import brute

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("text", "lang", "keys", "hub", "component")]])


def _corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            t = rng.choice(docs)[1].split(" ")
            for _ in range(rng.choice([0, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(words)
            docs.append((i, " ".join(t)))
        else:
            docs.append((i, " ".join(rng.choices(words, k=rng.choice([1, 3, 12, 60])))))
    return docs


@pytest.mark.parametrize("n", [2, 5])
def test_components_equal_brute_force(spark, n):
    docs = _corpus(n)
    rows = [(i, t, None, "x", "y", "z") for i, t in docs]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), neardup.NearDup(words=n)).collect()}
    assert got == {i: (s, c, i == c) for i, (s, c) in brute.near_duplicates(docs, n).items()}


def test_large_bucket_of_unlinked_texts(spark):
    """Texts close to one base, most of them not to each other, some in chains: stars alone miss links."""
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    docs = []
    for i in range(150):
        t = list(base)
        for k in rng.sample(range(60), rng.choice([1, 3, 4, 5])):
            t[k] = f"x{rng.randrange(10_000)}"
        docs.append((i, " ".join(t)))
    old, neardup.TILE = neardup.TILE, 40
    try:
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), neardup.NearDup(words=2)).collect()}
    finally:
        neardup.TILE = old
    assert got == {i: c for i, (_, c) in brute.near_duplicates(docs, 2).items()}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (7, "word " * 20_000), (8, "word " * 20_001)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (None, 1, None, True), (7, 1, 7, True), (8, 1, 7, False)], key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_drop_keeps_columns_and_one_of_each_group(spark):
    rows = [(1, "a b c d e f", "en", "k", "h", "c"), (2, "A b c d e f", "de", "k", "h", "c"), (3, "z", None, None, None, None)]
    got = neardup.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert got.columns == DOCS.names and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(None, 3), (4, 4)]
    got, _ = connected_components(spark.createDataFrame(edges, "u long, v long"))
    want = brute.components(range(141), [e for e in edges if e[0] is not None])
    assert {r.node: r.component for r in got.collect()} == {n: c for n, c in want.items() if n != c}


def _vectors(seed, dim=16, n=160):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.05, 0.12, 0.2, 1.0])
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([1, 3]))], int(rng.integers(2))))
    return rows


def _links(rows, least=0.98):
    out = []
    for a, (i, v, y) in enumerate(rows):
        for j, w, z in rows[a + 1 :]:
            if y is None or y != z or v is None or w is None or len(v) != len(w):
                continue
            if any(x is None or not np.isfinite(x) for x in [*v, *w]):
                continue
            p, q = np.array(v), np.array(w)
            if p.any() and q.any() and p @ q / np.sqrt((p @ p) * (q @ q)) >= least:
                out.append((i, j))
    return out


@pytest.mark.parametrize("seed,tile", [(0, 1024), (1, 7)])
def test_vector_links_equal_brute_force(spark, seed, tile):
    nan = float("nan")
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [nan] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 0), (905, [1.0] * 16, None), (906, [1.0] * 15, 0), (907, [2.0] * 15, 0), (908, [float("inf")] * 16, 0)]
    rows = _vectors(seed) + odd
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vecdup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), vecdup.VecDup(tile=tile)).collect()}
    links = _links(rows)
    part = brute.components([r[0] for r in rows], links)
    assert got == {i: (sum(i in e for e in links), part[i], part[i] == i) for i, _, _ in rows}
    assert got[907] == (1, 906, False)


def test_no_vectors(spark):
    assert vecdup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_cells_lose_no_link():
    """Pairs around 0.8 whose few minima often differ: full sets alone decide."""
    rng = np.random.default_rng(3)
    p = neardup.NearDup(bands=2, rows=2)
    base = rng.integers(0, 2**63, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(75, 91)], rng.integers(0, 2**63, rng.integers(0, 9), dtype=np.uint64)])) for _ in range(60)]
    rows = [{"side": i % 2, "doc": i, "component": i // 4, "items": s.view(np.int64).tolist()} for i, s in enumerate(sets)]
    kinds = pa.schema([("side", pa.int32()), ("doc", pa.int64()), ("component", pa.int64()), ("items", pa.list_(pa.int64()))])
    got = neardup._compare_tiles(p)(pa.Table.from_pylist(rows, kinds)).to_pylist()

    def close(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 80 * (len(a) + len(b) - both)

    want = {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2) if i // 4 != j // 4 and close(sets[i], sets[j])}
    assert 50 < len(want) < 800 and {(r["u"], r["v"]) for r in got} == want
