"""Ranked document search by BM25."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..semantics import settled

#: Queries go to the workers up to so many (query, term) rows, bytes of terms, and results of a task; larger sets are joined.
MOST_ASKED, MOST_BYTES = 1 << 20, 1 << 25
#: (document, query) cells, and hits, that a worker scores at once.
CELLS = 1 << 21


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75
    length_norm: bool = True
    stopwords: frozenset[str] = field(default_factory=frozenset)

    def valid(self) -> tuple[float, float]:
        k1 = self.k1 if 0 <= self.k1 < float("inf") else 1.2
        b = self.b if 0 <= self.b <= 1 else 0.75
        return k1, b if self.length_norm else 0.0


def tokens(text: Column) -> Column:
    """Runs of letters and decimal digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1))


@dataclass
class Index:
    """postings (term, doc_id, tf), documents (doc_id, length), terms (term, idf), totals (n, avg), words (doc_id, w)."""

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    totals: DataFrame
    p: Bm25
    words: DataFrame


def _idf(n: Column) -> Column:
    return F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))


def build(docs: DataFrame, p: Bm25 = Bm25()) -> Index:
    """Index over (doc_id, text). Empty documents count; stopwords count for nothing."""
    words = tokens(F.col("text"))
    if p.stopwords:
        words = F.filter(words, lambda w: ~w.isin(*p.stopwords))
    flat = docs.select("doc_id", words.alias("w"))
    documents = flat.select("doc_id", F.size("w").cast("long").alias("length"))
    postings = flat.select("doc_id", F.explode("w").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    totals = documents.agg(F.count("*").alias("n"), F.avg("length").alias("avg"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.crossJoin(F.broadcast(totals)).select("term", "df", _idf(F.col("n")).alias("idf"))
    return Index(postings, documents, terms, totals, p, flat)


def search(index: Index, queries: DataFrame, k: int, explain: bool = False) -> DataFrame:
    """The ``k`` best documents of each (query_id, text), all matches where k <= 0; scores
    are rounded to six digits, and ties go by doc_id.

    A term that a query repeats counts as often. With ``explain``, ``terms`` maps each
    term to what it adds. Where k > 0, a set of queries of bounded size is scored in the
    workers, each document against all queries, and only a task's best leave it.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    found = None
    if k > 0 and not explain:
        size = asked.agg(F.count("*").alias("rows"), F.sum(F.octet_length("term")).alias("bytes"), F.count_distinct(F.struct("query_id")).alias("queries")).first()
        if 0 < size.rows <= MOST_ASKED and (size.bytes or 0) <= MOST_BYTES and size.queries * k <= MOST_ASKED:
            found = _best(index, asked, k)
    if found is None:
        found = _joined(index, asked, explain)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return ranked.where(F.col("rank") <= k) if k > 0 else ranked


def _joined(index: Index, asked: DataFrame, explain: bool) -> DataFrame:
    """Scores of all pairs of a query and a document that share a term."""
    k1, b = index.p.valid()
    hits = index.postings.join(asked, "term").join(index.terms, "term").join(index.documents, "doc_id").crossJoin(F.broadcast(index.totals))
    norm = F.when(F.col("avg") > 0, 1 - b + b * F.col("length") / F.nullif(F.col("avg"), F.lit(0.0))).otherwise(1.0)
    gain = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
    rows = hits.select("query_id", "doc_id", "term", gain.alias("gain"))
    agg = [F.round(F.sum("gain"), 6).alias("score")]
    if explain:
        agg.append(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "gain")))).alias("terms"))
    return rows.groupBy("query_id", "doc_id").agg(*agg)


def _best(index: Index, asked: DataFrame, k: int) -> DataFrame | None:
    """Scores that hold the ``k`` best of each query; none where document ids are null or repeat.

    Texts are read once, into a table of the asked terms of each document.
    """
    vocabulary, (query_ids, owner, term_of, times) = _asked(asked)
    kind, asker = (f.schema[c].dataType.simpleString() for f, c in ((index.words, "doc_id"), (asked, "query_id")))
    count = lambda batches: (_counted(batch.slice(at, 1000), vocabulary) for batch in batches for at in range(0, batch.num_rows, 1000))
    table = settled(index.words.mapInArrow(count, f"doc_id {kind}, length bigint, terms array<int>, tfs array<int>"))
    totals = table.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), F.count_distinct("doc_id").alias("ids")).first()
    if totals.ids != totals.n:
        return None
    found = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", _idf(F.lit(totals.n)).alias("idf")).toArrow()
    idf = np.zeros(len(vocabulary))
    idf[found["term"].to_numpy()] = found["idf"].to_numpy()
    # Questions by term: those of term t are start[t] to start[t + 1].
    by_term = np.argsort(term_of, kind="stable")
    start = np.searchsorted(term_of[by_term], np.arange(len(vocabulary) + 1))
    owner, worth = owner[by_term], (times * idf[term_of])[by_term]
    k1, b = index.p.valid()
    avg = totals.avg

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Top(len(query_ids), k)
        for batch in batches:
            ids, lengths, terms, tfs = batch.column(0), batch.column(1).to_numpy(), batch.column(2), batch.column(3).flatten().to_numpy()
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(terms).to_numpy())))
            terms = terms.flatten().to_numpy()
            norm = 1 - b + b * lengths / avg if avg else np.ones(len(lengths))
            hits = np.concatenate(([0], np.cumsum(start[terms + 1] - start[terms])))[ends]
            at = 0
            while at < len(lengths):
                to = max(at + 1, min(at + max(1, CELLS // len(query_ids)), int(np.searchsorted(hits, hits[at] + CELLS, "right")) - 1))
                lo, hi = ends[at], ends[to]
                t, tf = terms[lo:hi], tfs[lo:hi].astype(float)
                many = start[t + 1] - start[t]
                posting = np.repeat(np.arange(len(t)), many)
                question = np.arange(len(posting)) - np.repeat(np.cumsum(many) - many, many) + start[t][posting]
                doc = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
                below = tf + k1 * norm[at:to][doc]
                gain = worth[question] * tf[posting] * (k1 + 1) / below[posting]
                scores = np.bincount(doc[posting] * len(query_ids) + owner[question], gain, (to - at) * len(query_ids)).reshape(-1, len(query_ids))
                top.meet(scores, ids.slice(at, to - at))
                at = to
        yield from top.rows(query_ids)

    return table.where("size(terms) > 0").sortWithinPartitions("doc_id").mapInArrow(run, f"query_id {asker}, doc_id {kind}, score double")


def _asked(asked: DataFrame) -> tuple[pa.Array, tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Different terms; different queries, and for each (query, term) the number of each and how often it is asked."""
    query = F.dense_rank().over(Window.orderBy("query_id")) - 1
    rows = asked.withColumn("__q", query).toArrow().combine_chunks()
    terms = pc.dictionary_encode(rows["term"].combine_chunks())
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    owner = rows["__q"].to_numpy()
    _, first = np.unique(owner, return_index=True)
    return terms.dictionary, (rows["query_id"].combine_chunks().take(pa.array(first)), owner, terms.indices.to_numpy(), rows["times"].to_numpy())


def _counted(batch: pa.RecordBatch, vocabulary: pa.Array) -> pa.RecordBatch:
    """Of (doc_id, words): length, and the asked terms with how often each is there."""
    words = batch.column(1)
    lengths = pc.list_value_length(words).to_numpy().astype(np.int64)
    number = pc.index_in(words.flatten().cast(vocabulary.type), value_set=vocabulary)
    here = pc.is_valid(number).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lengths)), lengths)[here]
    pairs, tfs = np.unique(doc * max(1, len(vocabulary)) + number.drop_null().to_numpy(), return_counts=True)
    doc, terms = np.divmod(pairs, max(1, len(vocabulary)))
    offsets = pa.array(np.searchsorted(doc, np.arange(len(lengths) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (terms, tfs)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), *lists], ["doc_id", "length", "terms", "tfs"])


class _Top:
    """The ``k`` best of each query among the documents met so far, in millionths; of equal ones those met first."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -1, dtype=np.int64)
        self.query, self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None

    def meet(self, scores: np.ndarray, ids: pa.Array) -> None:
        whole = np.where(scores > 0, np.floor(scores * 1e6 + 0.5), -1).astype(np.int64)
        doc, query = np.nonzero(whole > self.least)
        if not len(doc):
            return
        came = ids.take(pa.array(doc))
        query, score = np.concatenate((self.query, query)), np.concatenate((self.score, whole[doc, query]))
        order = np.lexsort((-score, query))  # stable: who came first stays first
        first = np.searchsorted(query[order], query[order])
        place = np.arange(len(order)) - first
        order = order[place < self.k]
        self.ids = (came if self.ids is None else pa.concat_arrays([self.ids, came])).take(pa.array(order))
        self.query, self.score = query[order], score[order]
        last = place[place < self.k] == self.k - 1
        self.least[self.query[last]] = self.score[last]

    def rows(self, query_ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.ids is not None:
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.query)), self.ids, pa.array(self.score / 1e6)], ["query_id", "doc_id", "score"])
