import datetime as dt
import hashlib
import threading
import time
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from lodestar.control import Budget, Lazy, Memo, Phase, Plan, cache_key
from lodestar.functions import jsonfind
from lodestar.operators import hierarchy as H
from lodestar.operators import search as Q
from lodestar.operators import series as S
from lodestar.plans import basics
from lodestar.sources import config, ocf, toon
from lodestar.sources.versioned import Conflict, Corrupt, TableError, VersionedTable


@pytest.fixture
def edges(spark):
    rows = [("a", "a", 1.0), ("b", "a", 5.0), ("c", "a", 2.0), ("d", "b", 3.5), ("e", "b", 3.0), ("f", "d", 0.0), ("z", "z", -1.0)]
    return spark.createDataFrame(rows, "id string, parent string, own double")


def test_tree(edges):
    assert {r.id: r.total for r in H.subtree_sums(edges).collect()} == {"a": 14.5, "b": 11.5, "c": 2, "d": 3.5, "e": 3, "f": 0, "z": -1}
    assert {r.id: (r.largest, r.holder) for r in H.subtree_max(edges).collect()}["a"] == (5.0, "b")
    assert [(r.id, r.weight) for r in H.top_k(edges, 2, by_total=True).where("root = 'a'").orderBy("rank").collect()] == [("b", 11.5), ("d", 3.5)]
    assert {r.id: r.path for r in H.paths(edges).collect()}["f"] == ["a", "b", "d", "f"]
    with pytest.raises(H.TreeError):
        H.move(edges, "b", "f")
    with pytest.raises(H.TreeError):
        H.remove(edges, "b")
    moved = H.move(edges, "d", "c")
    assert {(r.id, r.change) for r in H.diff(edges, H.remove(moved, "e")).collect()} == {("d", "moved"), ("e", "removed")}
    assert {r.id for r in H.remove(edges, "b", subtree=True).collect()} == {"a", "c", "z"}


def test_tree_check(spark):
    rows = [("a", "a", 0.0), ("a", "a", 0.0), ("b", "x", 0.0), ("p", "q", 0.0), ("q", "p", 0.0)]
    got = {(r.id, r.problem.split()[0]) for r in H.check(spark.createDataFrame(rows, "id string, parent string, own double")).collect()}
    assert got == {("a", "exists"), ("b", "unknown"), ("p", "cycle"), ("q", "cycle")}


def test_deep_tree(spark):
    """Nothing is cut at any depth."""
    n = 100
    deep = spark.createDataFrame([(k, max(0, k - 1), float(k)) for k in range(n)], "id long, parent long, own double").cache()
    assert {r.id: r.total for r in H.subtree_sums(deep).collect()} == {k: sum(range(k, n)) for k in range(n)}
    assert {(r.largest, r.holder) for r in H.subtree_max(deep).collect()} == {(n - 1.0, n - 1)}
    assert {r.id: r.path for r in H.paths(deep).collect()} == {k: list(range(k + 1)) for k in range(n)}
    assert [r.id for r in H.top_k(deep, 1).where("root = 0").collect()] == [n - 1]
    with pytest.raises(H.TreeError):
        H.move(deep, 1, n - 1)
    assert [r.id for r in H.remove(deep, 1, subtree=True).collect()] == [0]


def test_very_deep_tree(spark):
    n = 5000
    deep = spark.range(n).select("id", F.greatest(F.lit(0), F.col("id") - 1).alias("parent"), F.lit(1.0).alias("own"))
    totals = H.subtree_sums(deep)
    assert totals.agg(F.sum("total")).first()[0] == n * (n + 1) / 2 and totals.where("id = 0").first().total == n


def test_guarded_edits(spark, edges):
    def refused(f, *args):
        with pytest.raises(H.TreeError):
            f(*args)

    def new(*rows):
        return spark.createDataFrame(rows, "id string, parent string, own double")

    refused(H.add, edges, new(("b", "a", 1.0)))
    refused(H.add, edges, new(("n", "nowhere", 1.0)))
    refused(H.add, edges, new(("n", "a", 1.0), ("n", "b", 1.0)))
    refused(H.add, edges, new(("n", "m", 1.0), ("m", "n", 1.0)))
    refused(H.add, edges, new(("n", "a", float("inf"))))
    grown = H.add_root(H.add(edges, new(("m", "n", 2.0), ("n", "f", 1.0))), "r2", 4.0)
    assert {r.id: r.total for r in H.subtree_sums(grown).collect()}["a"] == 17.5 and H.own_value(grown, "r2") == 4.0
    assert {r.id for r in H.children(grown, "a").collect()} == {"b", "c"} and {r.id for r in H.below(grown, "d").collect()} == {"d", "f", "n", "m"}
    refused(H.own_value, edges, "nowhere")
    refused(H.set_own, edges, spark.createDataFrame([("nowhere", 1.0)], "id string, own double"))
    refused(H.set_own, edges, spark.createDataFrame([("a", float("nan"))], "id string, own double"))
    refused(H.move, edges, "nowhere", "a")
    refused(H.remove, edges, "nowhere")
    assert H.own_value(H.set_own(edges, spark.createDataFrame([("a", 9.0)], "id string, own double")), "a") == 9.0


def test_cycles_raise_and_are_found(spark):
    rows = [(0, 0, 1.0), (1, 0, 1.0)] + [(k, k - 1 if k > 10 else 89, 1.0) for k in range(10, 90)] + [(100, 50, 1.0), (101, 100, 1.0)]
    edges = spark.createDataFrame(rows, "id long, parent long, own double")
    with pytest.raises(H.TreeError):
        H.subtree_sums(edges)
    got = {(r.id, r.problem.split()[0]) for r in H.check(edges).collect()}
    assert got == {(k, "cycle") for k in [*range(10, 90), 100, 101]}


def test_search_explains_itself(spark):
    docs = spark.createDataFrame([("a", "red fox red"), ("b", "Red dog"), ("c", ""), ("d", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "red red fox"), (2, "nothing")], "query_id int, text string")
    got = Q.search(Q.build(docs), asked, 0, explain=True).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["a", "b"] and set(got[0].terms) == {"red", "fox"}
    assert sum(got[0].terms.values()) == pytest.approx(got[0].score, abs=1e-6)
    stop = Q.build(docs, Q.Bm25(stopwords=frozenset({"red"}), b=9))
    assert {r.doc_id: r.length for r in stop.documents.collect()} == {"a": 1, "b": 1, "c": 0, "d": 0}


@pytest.fixture
def corpus(spark):
    """Copies that tie, in id order across partitions, empty and null texts, and accents; queries that repeat words, find nothing or have no id."""
    texts = ["red fox red", "Red dog", "", None, "blue fox jumps", "ÉTÉ été fox", "dog dog dog fox", "nothing here"]
    docs = spark.createDataFrame([(f"d{i:03d}", texts[i * 7 % 8] if i < 400 else f"w{i % 50} fox w{i % 7} dog") for i in range(600)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "red red fox"), (2, "absent"), (3, "w3 w4 dog fox"), (None, "été"), (5, ""), (6, None)], "query_id int, text string")
    return docs.repartition(7), asked


@pytest.mark.parametrize("k", [5, 250])
def test_search_in_workers_equals_the_join(spark, corpus, k, monkeypatch):
    docs, asked = corpus
    monkeypatch.setattr(Q, "CELLS", 64)
    for p in (Q.Bm25(), Q.Bm25(length_norm=False, stopwords=frozenset({"red"}))):
        index = Q.build(docs, p)
        got = sorted(map(tuple, Q.search(index, asked, k).select("query_id", "rank", "doc_id", "score").collect()), key=repr)
        want = sorted((tuple(r)[:4] for r in Q.search(index, asked, 0).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score").collect()), key=repr)
        assert got == want and got


def test_search_joins_where_ids_repeat_or_queries_are_many(spark, corpus, monkeypatch):
    docs, asked = corpus
    twice = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "red fox")], docs.schema))
    for k, found in ((3, twice), (3, docs)):
        index = Q.build(found)
        if found is docs:
            monkeypatch.setattr(Q, "MOST_ASKED", 2)
        got = sorted(map(tuple, Q.search(index, asked, k).select("query_id", "rank", "score").collect()), key=repr)
        want = sorted(map(tuple, Q.search(index, asked, 0).where(F.col("rank") <= k).select("query_id", "rank", "score").collect()), key=repr)
        assert got == want and got
    assert Q.search(Q.build(docs), asked.where("query_id > 4"), 5).collect() == []


def test_search_does_not_join_postings(spark, corpus):
    docs, asked = corpus
    plan = Q.search(Q.build(docs), asked, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "regexp_extract_all" not in plan


def test_chain(spark):
    rows = spark.createDataFrame([(1, k, f"body {k}") for k in range(6)], "c int, seq long, body string")
    sealed = S.chain_seal(rows, ["c"], "seq", "body", "d").cache()
    assert S.chain_faults(sealed, ["c"], "seq", "d").collect() == []
    swapped = sealed.withColumn("seq", F.when(F.col("seq") == 2, 3).when(F.col("seq") == 3, 2).otherwise(F.col("seq")))
    assert [(r.seq, r.fault) for r in S.chain_faults(swapped, ["c"], "seq", "d").collect()] == [(2, "reordered")]


def test_ocf_round_trip(spark, tmp_path):
    spark.dataSource.register(ocf.OcfSource)
    rows = [(-(2**63), "😀", -0.0, None, [1e308, 1.5], True), (2**63 - 1, "", 1.0, "", [], False)] * 3000
    df = spark.createDataFrame(rows, "id long, name string, score double, note string, vec array<double>, ok boolean").repartition(3)
    for codec in ("null", "deflate"):
        path = str(tmp_path / codec)
        df.write.format("ocf").option("codec", codec).mode("append").save(path)
        got = spark.read.format("ocf").load(path)
        assert got.schema.simpleString() == df.schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


def test_ocf_refuses_damage():
    from pyspark.sql import types as T

    data = ocf.write_file(iter([(k,) for k in range(10)]), T.StructType([T.StructField("k", T.LongType(), False)]))
    assert [r[0] for r in ocf.read_file(data)] == list(range(10))
    for bad in (b"", data[:-1], b"X" + data[1:], data[:-3] + b"abc"):
        with pytest.raises(ocf.CorruptFile):
            list(ocf.read_file(bad))


REPLIES = ['{"title":"Reroute lane 4","impact":1200}', '```json\n{"title":"Reroute lane 4","impact":1200}\n```', 'Sure! {"title":"Reroute lane 4","impact":1200}', '{"title":"Reroute lane 4","impact":1200}\nHope it helps', 'a {brace} in prose {"title":"Reroute lane 4","impact":1200}', '  {"title":"Reroute lane 4","impact":1200}  ']


@pytest.mark.parametrize("reply", REPLIES)
def test_json_in_replies(reply):
    import json

    assert json.loads(jsonfind.decode(reply, {"title": str, "impact": float}, strict=True)) == {"title": "Reroute lane 4", "impact": 1200}


def test_json_scan():
    assert jsonfind.scan('x {"a": "}\\"{"} y [1]') == ([('{"a": "}\\"{"}', 2, 15), ("[1]", 18, 21)], False)
    assert jsonfind.scan("é {}")[0] == [("{}", 3, 5)] and jsonfind.scan('{"a": 1')[1] and jsonfind.scan("(])")[0] == []
    assert jsonfind.decode_one('[{"k": 1}]', {"k": int}) == ("ok", '{"k": 1}')
    assert jsonfind.decode('{"k": 1, "z": 2}', {"k": int}, strict=True) is None and jsonfind.decode('{"k": NaN}', {"k": float}) is None


def test_toon_round_trip():
    v = {"name": "a b", "tags": ["x", "y,z", "true", "1", ""], "parts": [{"sku": "A", "qty": 1}, {"sku": "B", "qty": 2.5}], "steps": [{"label": "s", "n": [1, 2]}, 5, [1, [2]]], "nested": {"d": {"x": None}, "f": False}, "e": [], "o": {}, "w": 'a: b\n"q"'}
    for d in ",\t|":
        assert toon.decode(toon.encode(v, d), strict=True) == v
    assert toon.decode("```\nk: 1\n```") == {"k": 1} and toon.decode("[2]: 1,2") == [1, 2] and toon.encode([1]) == "items[1]: 1"
    for bad in ("a: 1\na: 2", "t[2]{a,b}:\n  1", "\ta: 1", "a:\n  b: 1\n   c: 2"):
        with pytest.raises(toon.ToonError):
            toon.decode(bad)
    with pytest.raises(toon.ToonError):
        toon.decode("t[3]: 1,2", strict=True)
    assert [toon._number(x) for x in (1e21, 1e-7, 0.00001, -0.0, 5.0)] == ["1e+21", "1e-07", "0.00001", "0", "5"]


@dataclass
class _Model:
    name: str
    rate: float = 0.0
    since: dt.datetime | None = None


@dataclass
class _Config:
    models: list[_Model] = field(default_factory=list)
    limit: int = 1


def test_toml_binder():
    got = config.bind(config.parse(b'\xef\xbb\xbflimit = 0x10\n[[models]]\nname = "m"\nrate = 3\nsince = 2024-01-02\n'), _Config)
    assert got == _Config([_Model("m", 3.0, dt.datetime(2024, 1, 2, tzinfo=dt.UTC))], 16)
    with pytest.raises(config.ConfigError) as e:
        config.bind(config.parse('limit = 1.5\nextra = 1\n[[models]]\nnam = "x"'), _Config)
    assert {p.split(":")[0] for p in e.value.problems} == {"limit", "extra", "models[0].nam", "models[0].name"}
    for bad in ("a = 9223372036854775808", "a = 1\na = 2", b"a = '\xff'"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def _put(spark, t, **kv):
    return t.put(spark.createDataFrame([(k, v.encode()) for k, v in kv.items()], "key string, payload binary"))


def test_versioned_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}", "t")
    assert t.version() == 0 and t.scan().collect() == []
    _put(spark, t, k="v1", other="x")
    _put(spark, t, k="v2")
    t.delete(spark.createDataFrame([("k",)], "key string"))
    assert [t.get("k", v) for v in (1, 2, 3)] == [b"v1", b"v2", None]
    with pytest.raises(TableError):
        t.state(99)
    assert [(r.key, r.op, r.ver) for r in t.changes(1).orderBy("ver").collect()] == [("k", "put", 2), ("k", "del", 3)] and t.changes(3).collect() == []
    for n in range(9):
        _put(spark, t, **{f"user:{n}": str(n)})
    assert t.version() == 12 and t.scan("user:").count() == 9
    assert t.compact() == 13 and len(t.state().files) == 1
    assert {r.key: bytes(r.payload).decode() for r in t.scan().collect()} == {"other": "x"} | {f"user:{n}": str(n) for n in range(9)}
    assert [r.ver for r in t.changes(11).collect()] == [12] and t.get("k", 2) == b"v2" and t.vacuum() == []
    with pytest.raises(TableError):
        VersionedTable(spark, str(tmp_path), "../x")


def test_two_writers_and_a_gap(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}", "t")
    got = []
    threads = [threading.Thread(target=lambda k=k: got.append(_put(spark, t, **{f"k{k}": "v"}))) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(got) == [1, 2, 3, 4] and t.scan().count() == 4
    (tmp_path / "t/_log/00000000000000000002.json").unlink()
    with pytest.raises(Corrupt):
        t.state()
    assert issubclass(Conflict, TableError)


def test_memo_runs_once_and_forgets():
    gone, m, runs = [], Memo(2, ttl=10, drop=lambda v: gone.append(v)), []

    def work():
        runs.append(1)
        time.sleep(0.05)
        return len(runs)

    out = []
    threads = [threading.Thread(target=lambda: out.append(m.do("k", work))) for _ in range(8)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert out == [1] * 8 and len(runs) == 1
    assert m.do("k", work, now=11) == 2 and gone == [1]
    m.set("a", 5), m.set("b", 6)
    assert m.get("k") is None and m.stats()["evicted"] == 1
    with pytest.raises(ZeroDivisionError):
        m.do("bad", lambda: 1 / 0)
    assert m.do("bad", lambda: 3) == 3
    assert cache_key("ab", "c") != cache_key("a", "bc") and cache_key(1) != cache_key(1.0) and cache_key({"a": 1, "b": 2}) == cache_key({"b": 2, "a": 1})


def test_lazy():
    runs = []
    v = Lazy(lambda: runs.append(1) or 20)
    w = v.map(lambda x: x + 1).then(lambda x: Lazy.of(x * 2))
    assert w.get() == 42 and v.get() == 20 and len(runs) == 1
    assert Lazy.all([Lazy(lambda k=k: k) for k in range(3)]).get() == [0, 1, 2]
    with pytest.raises(TimeoutError):
        Lazy(lambda: time.sleep(0.5)).get(timeout=0.01)
    with pytest.raises(ZeroDivisionError):
        Lazy(lambda: 1 / 0).get()


def test_budget():
    p = Plan((Phase("a", 0, 60, 10), Phase("b", 1, 50, 20), Phase("c", 1, 30, 5), Phase("d", 2, 40, 15)), margin_ns=5)
    p.validate()
    assert p.critical_path() == 155 and p.scaled(80).critical_path() <= 80
    b = Budget(p, 100, 0)
    assert b.begin("a", 0) == 60
    b.end("a", 61)
    assert b.begin("b", 61) == 19 and b.allowance("d", 99) == 0
    assert {r["phase"]: r["status"] for r in b.finalize(90)} == {"a": "overrun", "b": "abandoned", "c": "missing", "d": "missing"}
    with pytest.raises(ValueError):
        Plan((Phase("a", 1, 1), Phase("b", 0, 1))).validate()


def test_chain_is_a_streaming_fold(spark):
    """A long chain, a null key and a null body against hashlib; the plan collects no chain."""
    rows = [(k % 3 or None, k, None if k == 7 else f"body {k}".encode()) for k in range(30_000)]
    sealed = S.chain_seal(spark.createDataFrame(rows, "c int, seq long, body binary").repartition(5), ["c"], "seq", "body", "d", "r")
    assert "collect_list" not in sealed._jdf.queryExecution().toString()
    want, last = [], {}
    for c, seq, body in rows:
        prev = last.get(c) or "r"
        last[c] = None if body is None else hashlib.sha256(b"d" + prev.encode() + b"\0" + body).hexdigest()
        want.append((c, seq, prev, last[c], body))
    got = sealed.collect()
    assert sealed.columns == ["c", "seq", "prev", "hash", "body"]
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_whole_of_events_is_sealed(spark, tmp_path):
    rows = [(k, "t", 1.5) for k in range(2500)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.chain, r.seq): (r.prev, r.hash) for r in basics.QUERIES["chain_seal"](spark, str(tmp_path)).collect()}
    assert len(got) == 2500
    for c in range(20):
        prev = ""
        for seq in range(c, 2500, 20):
            own = hashlib.sha256(b"lodestar-chain-1" + prev.encode() + f"\0{seq}|t|1".encode()).hexdigest()
            assert got[c, seq] == (prev, own)
            prev = own
