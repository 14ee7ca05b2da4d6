from collections import defaultdict

import corpus_pipeline
from lodestar.llm import toxicity
from lodestar.llm.queries.packed import packing

from ..conftest import SF
from . import brute


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept; the classifier's own decisions are taken as given."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "toxic as label")
    gone = {r.doc_id for r in toxicity.score_toxicity(raw, toxicity.fit(raw, labels)).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in raw.collect()}
    want = {i: t for i, t in texts.items() if i not in gone}
    assert kept["toxicity"] == want
    want = {i: t for i, (_, _, t) in brute.line_dedup(list(want.items())).items()}
    assert kept["line dedup"] == want
    part = brute.near_duplicates(list(want.items()), 5)
    want = {i: t for i, t in want.items() if part[i][1] == i}
    assert kept["near-duplicates"] == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit, share = brute.contamination(list(want.items()), items), brute.largest_share(list(want.items()), items)
    want = {i: t for i, t in want.items() if len(hit[i][2]) < 2 and share[i] < 0.5}
    assert kept["decontamination"] == want
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(want)
    room = defaultdict(int)
    for r in packed:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= packing().length and len(room) <= -(-sum(room.values()) // packing().length) + 1


def test_run_returns_the_packed_rows(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


def test_a_document_with_one_whole_item_leaves(spark):
    """The decontamination stage on the raw documents against windows counted in plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def windows(text):
        w = brute.bench_words(text)
        return {tuple(w[k : k + 8]) for k in range(len(w) - 7)}

    items = {r.item_id: windows(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert all(items.values())
    shares = {r.doc_id: [len(w & windows(r.text)) / len(w) for w in items.values()] for r in docs.collect()}
    gone = {i for i, s in shares.items() if max(s) >= 0.5 or sum(x > 0 for x in s) >= 2}
    assert any(sum(x > 0 for x in shares[i]) == 1 for i in gone)
    assert {r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()} == set(shares) - gone
