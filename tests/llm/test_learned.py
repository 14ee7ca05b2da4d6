import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, registry, toxicity

from ..conftest import SF
from ..oracle import rows_of_frame, rows_of_sql
from . import brute

WIDE = "/root/testdata/sf0.1"
EN, DE = "the of and that with over under this when people river house".split(), "der die und nicht mit unter über dies wenn leute fluß haus".split()


def _docs(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        t = rng.choices(EN if lang == "en" else DE, k=rng.choice([8, 30, 200]))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(max(2, len(t) // 8)):
                t[rng.randrange(len(t))] = rng.choice(["zumblefrax", "grobnik", "vexolite"])
        rows.append((i, " ".join(t), lang, int(toxic)))
    return rows


def test_language(spark):
    rows = _docs(1)
    docs = spark.createDataFrame([(i, t, y) for i, t, y, _ in rows] + [(900, None, "en"), (901, "", None), (902, "123 !", "de"), (903, "Haus", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out(4, 2)))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [(i, y) for i, _, y, _ in rows if brute.crc_fold(i, 4) == 2]
    assert sum(got[i].lang_pred == y for i, y in held) >= 0.97 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3 and got[903].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    far = langid.LangId(least=0.999)
    assert {r.lang_pred for r in langid.identify(docs.limit(20), model, far).collect()} <= {"und", "en", "de"}
    strange = spark.createDataFrame([(1, "ქართული ენა საქართველოში"), (2, "when people under this river")], "doc_id long, text string").withColumn("s", F.expr("named_struct('a b', 1)")).withColumn("score", F.lit("old"))
    got = langid.identify(strange, model)
    assert got.columns == ["doc_id", "text", "s", "lang_pred", "score"]
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "und", 2: "en"} and 0 < model.least < 1
    forced = langid.identify(strange.union(strange), model, langid.LangId(least=0.0)).where("doc_id = 1").collect()
    assert len(forced) == 2 and {r.lang_pred for r in forced} <= {"en", "de"} and len({r.score for r in forced}) == 1
    long = spark.createDataFrame([(1, "der fluß und die leute " * 100_000)], "doc_id long, text string")
    assert langid.identify(long, model).first().lang_pred == "de"
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_toxicity(spark):
    rows = _docs(2, 500)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _, _ in rows] + [(900, None, None), (901, "", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if brute.crc_fold(i, 5)] + [(3000, 1), (None, 1), (5, None)], "doc_id long, label int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, evidence=True).collect()}
    held = [(i, y) for i, _, _, y in rows if not brute.crc_fold(i, 5)]
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[900].predicted == 0 and got[901].score == got[900].score
    assert all(len(r.evidence) == 0 or r.evidence[0].cosine > 0 for r in got.values())
    empty = toxicity.fit(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(docs, empty).collect()} == {0}


@pytest.mark.skipif(not os.path.isdir(WIDE), reason="needs the larger tables")
def test_toxicity_of_held_out_rows(spark):
    """Recall and false alarms over all held-out rows of the registered query."""
    labels = spark.read.parquet(f"{WIDE}/labels.parquet").select("doc_id", "toxic")
    got = registry.queries()["op9_toxicity"](spark, WIDE).where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r[0], r[1]): r[2] for r in got}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * n[0, 0]


def test_toxicity_of_ties_repeats_and_long_texts(spark):
    rows = [(i, "quiet words here today" if i % 2 else "vile grumbaking here", i) for i in range(60)]
    extra = "doc_id long, text string, `a b` long, predicted string"
    docs = spark.createDataFrame([(i, t, i, "old") for i, t, _ in rows] + [(7, "vile grumbaking here", 7, "old"), (61, "plain " * 300_000 + "vile grumbaker", 61, None), (None, None, None, None), (62, "\u4f60\u597d \u4e16\u754c", 1, "x")], extra)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, label int")
    p = toxicity.Toxicity(z=2.0)
    model = toxicity.fit(docs.limit(60), labels, p)
    got = toxicity.score_toxicity(docs.withColumn("s", F.expr("named_struct('c d', 1)")), model, p)
    assert got.columns == ["doc_id", "text", "a b", "s", "score", "predicted"] and got.count() == 64
    found = {(r["doc_id"], r["a b"]): r for r in got.collect()}
    assert found[61, 61].predicted == 1 and found[62, 1].predicted == 0 and found[None, None].predicted == 0
    assert len({r.score for r in got.where("text = 'vile grumbaking here'").collect()}) == 1
    assert toxicity.score_toxicity(docs.limit(0), model, p).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(300):
        f = np.unique(rng.integers(0, 40, rng.integers(1, 8)))
        w = rng.random(len(f))
        rows.append((f, w / np.linalg.norm(w)))
    index = toxicity.BlockMaxIndex(rows, 40, 16)
    dense = np.zeros((300, 40))
    for k, (f, w) in enumerate(rows):
        dense[k, f] = w
    for f, w in rows[:40]:
        near, cos = index.search(f, w, 5)
        q = np.zeros(40)
        q[f] = w
        assert np.allclose(np.sort(cos)[::-1], np.sort(dense @ q)[::-1][:5])
        assert np.allclose((dense @ q)[near], cos)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert rows_of_frame(registry.queries()[name](spark, SF)) == rows_of_sql(registry.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_other_queries_return_every_row(spark, name):
    table = "pages" if name.startswith("op4") else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert registry.queries()[name](spark, SF).count() >= n
