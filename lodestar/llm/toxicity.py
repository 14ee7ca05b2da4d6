"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled rows. A text is a TF-IDF vector over the
beginnings of its words, of every length, so that a stem counts however it is inflected.
Each feature's weight is its TF-IDF times how surely it tells the labels apart: the
absolute log odds ratio over all labelled rows less ``z`` standard errors, for ratios
of ``lean`` or more. A text's nearest examples by exact cosine come from a block-max inverted
index; distance-weighted votes, weighted by how many rows each example stands for, are
calibrated on the examples themselves, each judged without itself, and the voters are
the evidence. A text without any weighted feature gets the rate of such texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_list_array, forget, save
from .langid import _KEEP
from .sampling import sample_ids

_ROWS = 256
_CHUNK = 1 << 18
_U = np.uint64
_BYTE = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64)
_STEP, _SPREAD = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SHIFT = _U(44)


@dataclass(frozen=True)
class Toxicity:
    """At most ``per_label`` examples of each label; features of ``shortest`` to ``longest`` bytes.

    Features whose log odds in the sample are ``loose`` standard errors from 0 are
    counted over all labelled rows; those there ``z`` errors and ``lean`` or more away have
    a weight. Without ``lean``, features would grow with the rows, as any difference,
    however small, is sure once there are enough. ``k`` examples vote;
    ``prior`` is the weight of the rate of plain texts in a vote. ``predicted`` is 1
    from a score of ``reject`` on.
    """

    per_label: int = 2000
    shortest: int = 3
    longest: int = 12
    loose: float = 2.0
    z: float = 4.0
    lean: float = 1.0
    k: int = 15
    block: int = 64
    prior: float = 3.0
    reject: float = 0.5


def word_codes(texts: list[str | None], p: Toxicity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, codes) of all beginnings of words of the texts, some words at a time.

    Words are runs of letters, lower-cased. A beginning may end with the end of its
    word, which counts as a sign of its own. In scripts of three bytes or more a letter, a word
    begins at each letter.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    b = _KEEP[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
    ends = np.cumsum(np.array([len(r) + 1 for r in raw])) + 1
    inside = b != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first | (b >= 0xE0))
    for at in range(0, len(starts), 200_000):
        pos = starts[at : at + 200_000]
        text = np.searchsorted(ends, pos, "right")
        h = np.zeros(len(pos), np.uint64)
        with np.errstate(over="ignore"):
            for size in range(1, p.longest + 1):
                c = b[pos]
                h = h * _STEP + _BYTE[c]
                if size >= p.shortest:
                    yield text, h
                on = c != 0x20
                h, pos, text = h[on], pos[on] + 1, text[on]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about ``_CHUNK`` characters, with the number of the first."""
    at = held = 0
    for i, t in enumerate(texts):
        if i > at and held + len(t or "") > _CHUNK:
            yield at, texts[at:i]
            at, held = i, 0
        held += len(t or "")
    if at < len(texts):
        yield at, texts[at:]


class BlockMaxIndex:
    """Inverted index over example vectors; exact top-k by cosine.

    Postings of a feature are sorted by example; of each block of examples the largest
    weight of each feature is kept, which bounds the cosine of any example in it.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], features: int, block: int):
        self.n, self.block = len(rows), block
        self.n_blocks = -(-self.n // block)
        feature = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
        example = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])
        weight = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        order = np.lexsort((example, feature))
        self.example, self.weight = example[order], weight[order]
        self.cut = np.searchsorted(feature[order], np.arange(features + 1))
        # Block maxima of each feature, as sparse as the postings.
        key = feature[order] * max(1, self.n_blocks) + self.example // block
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.peak_block = self.example[new] // block
        self.peak = np.maximum.reduceat(self.weight, new) if len(new) else np.zeros(0)
        self.peak_cut = np.searchsorted(feature[order][new], np.arange(features + 1))

    @staticmethod
    def _runs(cut: np.ndarray, features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all postings of ``features``, and the weight of the feature of each."""
        first, sizes = cut[features], cut[features + 1] - cut[features]
        return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), np.repeat(weights, sizes)

    def _scores(self, features: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at, w = self._runs(self.cut, features, weights)
        take = wanted[self.example[at] // self.block]
        at = at[take]
        return np.bincount(self.example[at], weights=w[take] * self.weight[at], minlength=self.n)

    def search(self, features: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest with a cosine above 0, ties by number."""
        at, w = self._runs(self.peak_cut, features, weights)
        bound = np.bincount(self.peak_block[at], weights=w * self.peak[at], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        first = max(1, -(-2 * k // self.block))
        wanted = np.zeros(self.n_blocks, dtype=bool)
        wanted[order[:first]] = True
        scores = self._scores(features, weights, wanted)
        kth = np.partition(scores, -k)[-k] if self.n >= k else 0.0
        more = (bound > 0) & (bound >= kth - 1e-9) & ~wanted
        if more.any():
            scores += self._scores(features, weights, more)
            kth = np.partition(scores, -k)[-k] if self.n >= k else 0.0
        hit = np.flatnonzero((scores > 0) & (scores >= kth))
        near = hit[np.lexsort((hit, -scores[hit]))[:k]]
        return near, scores[near]


class Vocabulary:
    """Codes of features; finds and counts them in texts."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes  # sorted
        self.seen = np.zeros(1 << 20, dtype=bool)
        with np.errstate(over="ignore"):
            self.seen[(codes * _SPREAD) >> _SHIFT] = True

    def counts(self, texts: list[str | None], p: Toxicity) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, counts) of each whole text."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        n = max(1, len(self.codes))
        for _, part in _chunks(texts):
            keys = [np.zeros(0, np.int64)]
            for text, code in word_codes(part, p) if len(self.codes) else ():
                with np.errstate(over="ignore"):
                    maybe = np.flatnonzero(self.seen[(code * _SPREAD) >> _SHIFT])
                code, at = code[maybe], np.searchsorted(self.codes, code[maybe])
                at[at == n] = 0
                ok = self.codes[at] == code
                keys.append(text[maybe[ok]] * n + at[ok])
            key, many = np.unique(np.concatenate(keys), return_counts=True)
            cut = np.searchsorted(key, np.arange(len(part) + 1) * n)
            out += [(key[a:b] % n, many[a:b].astype(float)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        return out


@dataclass
class Model:
    words: Vocabulary
    weight: np.ndarray
    index: BlockMaxIndex
    ids: list[int]
    labels: np.ndarray
    stands_for: np.ndarray
    plain: float
    line: tuple[float, float] = (1.0, 0.0)

    def vector(self, held: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = (1 + np.log(n)) * self.weight[held]
        return w / np.linalg.norm(w)

    def vote(self, near: np.ndarray, cos: np.ndarray, p: Toxicity) -> float:
        """Log odds of the label by the votes of the nearest."""
        votes = cos**2 * self.stands_for[near]
        share = (p.prior * self.plain + float(votes @ self.labels[near])) / (p.prior + float(votes.sum()))
        return float(np.log(share / (1 - share)))

    def judge(self, held: np.ndarray, n: np.ndarray, p: Toxicity) -> tuple[float, list[tuple[int, float, int]]]:
        """(score, evidence): voters as (doc_id, cosine, label)."""
        if not len(held):
            return self.plain, []
        near, cos = self.index.search(held, self.vector(held, n), p.k)
        score = _sigmoid(self.line[0] * self.vote(near, cos, p) + self.line[1])
        return score, [(self.ids[i], min(1.0, float(c)), int(self.labels[i])) for i, c in zip(near.tolist(), cos.tolist(), strict=True)]


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of labels on log odds, with smoothed targets and a slope above 0."""
    pos, neg = float((weight * y).sum()), float((weight * (1 - y)).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.column_stack([x, np.ones(len(x))])
    line = np.array([1.0, 0.0])
    ridge = np.diag([1e-3, 1e-6])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a @ line, -50, 50)))
        grad = a.T @ (weight * (q - target)) + ridge @ (line - [1.0, 0.0])
        step = np.linalg.solve((a * (weight * q * (1 - q))[:, None]).T @ a + ridge, grad)
        line = line - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(line[0]), float(line[1])) if line[0] > 0 and np.isfinite(line).all() else (1.0, 0.0)


def log_odds(t: np.ndarray, c: np.ndarray, toxic: int, clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds ratio of features in t of ``toxic`` and c of ``clean`` texts, and its standard error."""
    cells = [t + 0.5, toxic - t + 0.5, c + 0.5, clean - c + 0.5]
    return np.log(cells[0] * cells[3] / (cells[1] * cells[2])), np.sqrt(sum(1 / x for x in cells))


def _distinct_codes(p: Toxicity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column("text").to_pylist(), batch.column("label").to_numpy()
            for at, part in _chunks(texts):
                got = list(word_codes(part, p))
                text, code = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
                order = np.lexsort((code, text))
                text, code = text[order], code[order].astype(np.uint64).view(np.int64)
                new = np.ones(len(code), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(code[new]), pa.array(labels[at + text[new]].astype(np.int32))], ["code", "label"])

    return run


def _by_label(df: DataFrame) -> DataFrame:
    """(code, t, c): toxic and clean texts with each code."""
    return df.groupBy("code").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))


def _columns(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, t and c of collected rows, in order of code."""
    codes = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(codes)
    return codes[order], np.array([r[1] for r in rows], dtype=float)[order], np.array([r[2] for r in rows], dtype=float)[order]


def _counted_over_all(docs: DataFrame, labels: DataFrame, codes: np.ndarray, p: Toxicity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, t, c) of ``codes`` over all labelled rows; only numbers are shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(codes)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Vocabulary(held.value)
        for batch in batches:
            got = [g[0] for g in words.counts(batch.column("text").to_pylist(), p)]
            flat = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_list_array(flat, np.array([len(g) for g in got], dtype=np.int64), pa.int32())], ["doc_id", "spots"])

    spots = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, spots array<int>").where("size(spots) > 0")
    counts = _by_label(spots.join(labels, "doc_id").select("label", F.explode("spots").alias("code"))).collect()
    t, c = np.zeros(len(codes)), np.zeros(len(codes))
    for k, n, m in counts:
        t[k], c[k] = n, m
    return codes, t, c


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, label of 0 or 1).

    Rows with another label, or a null doc_id, take no part; of several labels of a
    document the larger holds. What reaches the driver grows with the sample, which is
    bounded, and not with the tables.
    """
    one = labels.where("label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    ids = sample_ids(one, "label", p.per_label, 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    rows, path = save(rows, "examples")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("label").agg(F.count("*"), F.max("rows_of_label")).collect()}
    toxic, clean = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    df = _by_label(rows.select("text", "label").mapInArrow(_distinct_codes(p), "code long, label int"))
    # The same test as below, in the JVM: features of the sample that lean neither way stay there.
    cells = [F.col("t") + 0.5, toxic[0] + 0.5 - F.col("t"), F.col("c") + 0.5, clean[0] + 0.5 - F.col("c")]
    leaning = F.abs(F.log(cells[0] * cells[3] / (cells[1] * cells[2]))) >= p.loose * F.sqrt(sum((1 / x for x in cells), F.lit(0.0)))
    codes, _, _ = _columns(df.where(leaning).collect())
    codes, t, c = _counted_over_all(docs, one, codes, p)
    ratio, error = log_odds(t, c, toxic[1], clean[1])
    sure = np.maximum(0.0, np.abs(ratio) - p.z * error)
    keep = (sure > 0) & (np.abs(ratio) >= p.lean)
    n = toxic[1] + clean[1]
    weight = (np.log((1 + n) / (1 + t + c)) + 1)[keep] * sure[keep]
    words = Vocabulary(codes[keep])
    held = docs.sparkSession.sparkContext.broadcast(codes[keep])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(held.value)
        for batch in batches:
            got = known.counts(batch.column("text").to_pylist(), p)
            many = np.array([len(g[0]) for g in got], dtype=np.int64)
            flat = [np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), as_list_array(flat[0], many, pa.int32()), as_list_array(flat[1], many, pa.float64())], ["doc_id", "label", "features", "counts"])

    got = sorted(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(vectors, "doc_id long, label int, features array<int>, counts array<double>").collect())
    forget(docs.sparkSession, path)
    each = {k: sizes[k][1] / max(1, sizes[k][0]) for k in sizes}
    bare = {k: sum(r[1] == k and not r[2] for r in got) * each.get(k, 0) for k in (0, 1)}
    plain = (bare[1] + 0.1) / (bare[0] + bare[1] + 1)
    kept = [r for r in got if r[2]]
    model = Model(words, weight, BlockMaxIndex([], 0, p.block), [r[0] for r in kept], np.array([float(r[1]) for r in kept]), np.array([each[r[1]] for r in kept]), plain)
    vec = [(np.array(r[2]), model.vector(np.array(r[2]), np.array(r[3]))) for r in kept]
    model.index = BlockMaxIndex(vec, len(words.codes), p.block)
    odds = []
    for i, (features, weights) in enumerate(vec):
        near, cos = model.index.search(features, weights, p.k + 1)
        other = near != i
        odds.append(model.vote(near[other][: p.k], cos[other][: p.k], p))
    model.line = calibrate(np.array(odds), model.labels, model.stands_for)
    return model


def score_toxicity(docs: DataFrame, model: Model, p: Toxicity = Toxicity(), evidence: bool = False) -> DataFrame:
    """``docs`` with score, predicted and, if asked for, evidence.

    ``docs`` needs text and nothing else; whole texts count. A null or empty text, like
    any without a feature, gets the rate of such texts among the examples; without
    examples the score is below 0.5. ``predicted`` is 1 from ``reject`` on. Other
    columns stay; those named score, predicted or evidence are replaced. Empty tables
    give empty tables; equal texts get equal scores.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("score", "predicted", "evidence")]
    proof = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                got = [known.judge(f, n, p) for f, n in known.words.counts(part.column("text").to_pylist(), p)]
                score = np.array([g[0] for g in got])
                cols = [*[part.column(n) for n in names], pa.array(score), pa.array((score >= p.reject).astype(np.int32))]
                if evidence:
                    cols.append(pa.array([[{"doc_id": i, "cosine": c, "label": y} for i, c, y in g[1]] for g in got], proof))
                yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"] + ["evidence"] * evidence)

    plain = docs.select(*[F.col(f"`{n}`") for n in names])
    extra = T._parse_datatype_string("score double, predicted int" + ", evidence array<struct<doc_id:long,cosine:double,label:int>>" * evidence)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *extra.fields]))
