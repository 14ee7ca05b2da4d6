import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontam, linededup
from lodestar.llm.wordhash import ALNUM, SPACED, hash_words

from . import brute


def _docs(seed):
    rng = random.Random(seed)
    lines = [f"line number {k} of the corpus" for k in range(30)] + ["short", "", "  Line Number 3 of the corpus\t", "ein längerer Satz mit ä"]
    return [(i, "\n".join(rng.choices(lines, k=rng.choice([1, 2, 6, 20])))) for i in range(80)]


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup_equals_brute_force(spark, seed):
    docs = _docs(seed) + [(900, None), (901, ""), (902, "one common line here\n" * 500), (903, "one common line here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bitmap", F.lit(1)).withColumn("row_key", F.lit("x")).repartition(5)
    got = {r.doc_id: (r.n_dropped, r.text or "") for r in linededup.dedup_lines(df).collect()}
    assert got == {i: (d, t) for i, (_, d, t) in brute.line_dedup(docs).items()}


def test_one_line_over_many_partitions(spark):
    docs = [(i, "the very same line everywhere\nown line of document %d" % i) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = linededup.dedup_lines(df, linededup.LineDedup(rows=150)).where("n_dropped = 0")
    assert [r.doc_id for r in got.collect()] == [0]


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "the same long line"), (4, "the same long line"), (4, "the same long line"), (4, "other long line\nthe same long line"), (5, "the same long line\nx")]
    got = sorted((r.doc_id or -1, r.n_dropped, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, "the same long line"), (4, 0, "other long line\nthe same long line"), (4, 0, "the same long line"), (4, 0, "the same long line"), (5, 1, "x")]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bitmaps_round_trip():
    bits = linededup.unpack_bits(linededup.pack_bits(21, [0, 3, 20]), 21)
    assert [k for k in range(21) if not bits[k]] == [0, 3, 20]


def _bench(seed):
    rng = random.Random(seed)
    w = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(w, k=rng.choice([2, 5, 8, 9, 30])))) for k in range(12)] + [(50, ""), (51, None), (None, "w1 w2 w3"), (52, "!!"), (3, "W1, w2. w3 w4 w5 w6 w7 w8 w9")]
    docs = []
    for i in range(60):
        t = rng.choices(w, k=rng.choice([0, 3, 40, 200]))
        if rng.random() < 0.6:
            src = (rng.choice(items)[1] or "").split()
            a = rng.randrange(max(1, len(src)))
            t[len(t) // 2 : len(t) // 2] = src[a : a + rng.choice([7, 8, 9, 30])]
        docs.append((i, " ".join(t).replace("w3 ", "W3, ")))
    return docs + [(90, None), (91, "é " * 5)], [x for x in items if x[0] is not None], items


@pytest.mark.parametrize("seed,block", [(0, 1 << 24), (1, 1 << 24), (2, 300)])
def test_contamination_equals_brute_force(spark, seed, block):
    docs, items, rows = _bench(seed)
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), decontam.Decontaminate(block_bytes=block))
    got = {r.row.doc_id: (r.n_words, len(r.spots), r["items"]) for r in got.collect()}
    assert got == brute.contamination(docs, items)


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, items string")
    assert [r.contaminated for r in decontam.contamination(docs, none).collect()] == [False]
    assert decontam.drop_contaminated(docs, none).collect() == docs.collect()
    assert decontam.contamination(docs.limit(0), none).collect() == []


def test_winnowing_keeps_a_print_of_every_shared_span():
    rng = random.Random(9)
    p = decontam.Decontaminate()
    for _ in range(100):
        item = [rng.choice("abc") for _ in range(8)]
        text = [rng.choice("abc") for _ in range(20)] + item + [rng.choice("abc") for _ in range(20)]
        index = decontam.Index(["1"], [" ".join(item).encode()], p)
        (hit,) = list(index.hits(*hash_words([" ".join(text).encode()], ALNUM)))
        assert set(range(20, 28)) <= set(hit[1].tolist())


def test_word_hashes_tell_words_apart():
    texts = ["Ab cd\x0bé", "", "x" * 300 + " ab", "cd"]
    words, counts = hash_words([t.encode() for t in texts], SPACED)
    assert counts.tolist() == [3, 0, 2, 1]
    assert words[0] == words[4] and words[1] == words[5] and len(set(words.tolist())) == 4


def test_one_item_contaminates_by_share(spark):
    words = [f"v{k}" for k in range(30)]
    items = spark.createDataFrame([(1, " ".join(words)), (1, "a whole other wording of item one with ten words"), (2, "x y z x y z x y z x y z")], "item_id long, text string")
    docs = [(1, "before " + " ".join(words) + " after"), (2, " ".join(words[:19])), (3, " ".join(words[:18])), (4, "a whole other wording of item one with ten words"), (5, "nothing of it"), (6, None), (7, "x y z x y z x y z x y z")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    p = decontam.Decontaminate(share=0.5)
    for q in (p, replace(p, block_bytes=60)):
        got = {r.row.doc_id: (r.covered, r.contaminated) for r in decontam.contamination(rows, items, q).collect()}
        assert got == {1: (1.0, True), 2: (12 / 23, True), 3: (11 / 23, False), 4: (1.0, True), 5: (0.0, False), 6: (0.0, False), 7: (1.0, True)}
        assert sorted(r.doc_id for r in decontam.drop_contaminated(rows, items, q).collect()) == [3, 5, 6]
    assert not any(r.contaminated for r in decontam.contamination(rows, items).collect())


def test_contamination_of_long_and_repeated_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "pad " * 400_000 + item, 5), (2, item, 6), (2, item, 6), (3, None, 7)], "doc_id long, text string, n_words int").withColumn("s", F.expr("named_struct('a b', 1)"))
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (None, item)], "item_id long, text string")
    got = decontam.contamination(docs, bench).orderBy("row.doc_id").collect()
    assert [(r.row.doc_id, r.n_words, len(r.spots), r["items"], r.covered) for r in got] == [(1, 400_010, 10, ["1"], 1.0), (2, 10, 10, ["1"], 1.0), (2, 10, 10, ["1"], 1.0), (3, 0, 0, [], 0.0)]
    assert decontam.drop_contaminated(docs, bench, decontam.Decontaminate(share=0.5)).select("doc_id", "n_words").collect() == [(3, 7)]
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
