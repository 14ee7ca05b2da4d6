"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte trigrams of its letters; document
frequencies are counted over all rows to fit on. Each language has several centroids,
clustered on a bounded sample of labelled rows, in one task a language. A text takes the
language of the nearest centroid by cosine, or none where even that is too far or the
text has no letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_list_array
from .sampling import fold, sample_ids

_LETTER = regex.compile(r"\p{L}")
_KEEP = np.full(256, 0x20, dtype=np.uint8)
_KEEP[0x61:0x7B] = np.arange(0x61, 0x7B)
_KEEP[0x80:] = np.arange(0x80, 0x100)
_ROWS = 128


@dataclass(frozen=True)
class LangId:
    """Fit on at most ``per_lang`` rows of each of the ``langs`` commonest languages.

    ``least`` is the cosine below which a text is of no language; by default half of what
    all but one in a hundred of the sampled rows have, in the language where that is least.
    """

    per_lang: int = 600
    langs: int = 256
    centroids: int = 4
    bits: int = 13
    least: float | None = None
    seed: int = 5
    none: str = "und"


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    least: float = 0.0


def trigram_counts(texts: list[str], bits: int) -> np.ndarray:
    """A row of hashed trigram counts for each text."""
    out = np.zeros((len(texts), 1 << bits), dtype=np.float32)
    for i, t in enumerate(texts):
        b = _KEEP[np.frombuffer(b" " + t.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
        blank = b == 0x20
        b = b[~(blank & np.concatenate([[False], blank[:-1]]))].astype(np.uint32)
        if len(b) < 3:
            continue
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        slot = (code * np.uint32(2654435761)) >> np.uint32(32 - bits)
        out[i] = np.bincount(slot, minlength=1 << bits)
    return out


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _sparse(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                counts = trigram_counts(part.column("text").to_pylist(), bits)
                held = [np.flatnonzero(c) for c in counts]
                flat = np.concatenate([c[k] for c, k in zip(counts, held, strict=True)])
                sizes = np.array([len(k) for k in held])
                yield pa.RecordBatch.from_arrays([part.column("label"), as_list_array(np.concatenate(held), sizes, pa.int32()), as_list_array(flat, sizes, pa.float32())], ["label", "slots", "counts"])

    return run


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means."""
    k = min(k, len(x))
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = (x @ centre.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else centre[j] for j in range(k)])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def _slots_held(bits: int):
    """Texts with each slot, one row a slot and task; slot -1 counts all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                counts = trigram_counts(batch.slice(a, _ROWS).column("text").to_pylist(), bits)
                held += (counts > 0).sum(axis=0)
                n += len(counts)
        slots = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, -1).astype(np.int32)), pa.array(np.append(held[slots], n))], ["slot", "n"])

    return run


def _centroids_of(idf: np.ndarray, p: LangId):
    def run(rows: pa.Table) -> pa.Table:
        got = sorted(zip(rows.column("slots").to_pylist(), rows.column("counts").to_pylist(), strict=True))
        counts = np.zeros((len(got), 1 << p.bits), dtype=np.float32)
        for i, (slots, n) in enumerate(got):
            counts[i, slots] = n
        x = _vectors(counts, idf)
        centre = _cluster(x, p.centroids, np.random.default_rng(p.seed)).astype(np.float32)
        low = float(np.quantile((x @ centre.T).max(axis=1), 0.01))
        return pa.table({"label": [rows.column("label")[0].as_py()] * len(centre), "centre": [c.tobytes() for c in centre], "low": [low] * len(centre)})

    return run


def fit(docs: DataFrame, p: LangId = LangId()) -> Model:
    """Fit on rows of ``docs`` (doc_id, text, lang) with a text and a language.

    Centroids reach the driver, and one count a slot, never rows.
    """
    docs = docs.where("text is not null and lang is not null")
    held = dict(docs.select("text").mapInArrow(_slots_held(p.bits), "slot int, n long").groupBy("slot").agg(F.sum("n")).collect())
    df = np.zeros(1 << p.bits)
    for slot, n in held.items():
        if slot >= 0:
            df[slot] = n
    idf = (np.log((1 + held.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)
    ids = sample_ids(docs, "lang", p.per_lang, p.langs)
    # At most per_lang * langs ids, and as many rows a language in a task.
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    sparse = rows.select("label", "text").mapInArrow(_sparse(p.bits), "label string, slots array<int>, counts array<float>").where("size(slots) > 0")
    got = sorted(sparse.groupBy("label").applyInArrow(_centroids_of(idf, p), "label string, centre binary, low double").collect())
    centroids = np.array([np.frombuffer(r[1], np.float32) for r in got]).reshape(len(got), 1 << p.bits)
    return Model(idf, centroids, [r[0] for r in got], 0.5 * min((r[2] for r in got), default=0.0))


def predict(model: Model, texts: list[str | None], p: LangId) -> tuple[list[str], np.ndarray]:
    lang, score = [p.none] * len(texts), np.zeros(len(texts))
    live = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    least = model.least if p.least is None else p.least
    if live and model.langs:
        x = _vectors(trigram_counts([texts[i] for i in live], p.bits), model.idf) @ model.centroids.T
        best = x.argmax(axis=1)
        for i, k, s in zip(live, best.tolist(), x[np.arange(len(live)), best].tolist(), strict=True):
            if s >= least:
                lang[i], score[i] = model.langs[k], min(1.0, max(0.0, s))
    return lang, score


def identify(docs: DataFrame, model: Model, p: LangId = LangId()) -> DataFrame:
    """``docs`` with lang_pred and score, the cosine to the nearest centroid.

    ``docs`` needs text and nothing else. A null text, one without a letter, or one
    farther than ``least`` from all centroids is ``none`` with score 0; so is every
    text where no labelled row was there to fit on. Whole texts count. Other columns
    stay; those named lang_pred or score are replaced. Ties go to the language first
    in order. Empty tables give empty tables.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                lang, score = predict(held.value, part.column("text").to_pylist(), p)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    plain = docs.select(*[F.col(f"`{n}`") for n in names])
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *T._parse_datatype_string("lang_pred string, score double").fields]))


def held_out(parts: int, which: int):
    return F.coalesce(fold(F.col("doc_id"), parts) == which, F.lit(False))
