import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import steps
from lodestar.operators import folds
from lodestar.operators import series as S
from lodestar.streaming.detect import detect

SEC = 10**9


def run(kernel, readings):
    state, out = kernel.start(), []
    for x, at in readings:
        state, got = kernel.step(state, x, at)
        out.append(got)
    return out


def test_cusum_known_answer():
    got = run(steps.Cusum(10, 1, 3), [(x, None) for x in (12, 13, 11, 12, 12, 4, 9, 10, 14)])
    assert [g[0] for g in got] == [1, 3, 3, 4, 5, 0, 0, 0, 3]
    assert [g[1] for g in got] == [0, 0, 0, 0, 0, 5, 5, 4, 0]
    assert [g[2] for g in got] == ["none"] * 3 + ["up"] * 2 + ["down"] * 3 + ["none"]
    assert [g[3] for g in got] == [1, 2, 3, 4, 5, 1, 2, 3, 1]


@pytest.mark.parametrize("low,on,off,xs,want", [(False, 90, 80, [85, 89.9, 90, 85, 80.1, 80, 85, 95], "FFTTTFFT"), (True, 10, 20, [15, 10.1, 10, 19.9, 20, 15, 5], "FFTTFFT")])
def test_hysteresis_known_answer(low, on, off, xs, want):
    got = run(steps.Hysteresis(on, off, low), [(x, k) for k, x in enumerate(xs)])
    assert "".join("T" if g[0] else "F" for g in got) == want


def test_bucket_known_answer():
    got = run(steps.Bucket(SEC, 3), [(1, 0)] * 4 + [(1, SEC - 1), (1, SEC), (1, SEC)])
    assert [g[0] for g in got] == [True, True, True, False, False, True, False]


def test_breaker():
    b = steps.Breaker(2, 10, 1)
    got = run(b, [(None, 0), (0, 1), (0, 2), (None, 3), (1, 4), (None, 12), (None, 12), (1, 13), (None, 14), (0, 15), (0, 16), (None, 26), (0, 27), (None, 28)])
    assert [g[0] for g in got] == ["closed", "closed", "open", "open", "open", "half-open", "half-open", "closed", "closed", "closed", "open", "half-open", "open", "open"]
    assert [g[1] for g in got if g[1] is not None] == [True, False, True, False, True, True, False]


def test_cooldown_on_a_shared_clock(spark):
    rows = [(0, "a", 0), (1, "b", SEC), (2, "a", 5 * SEC), (3, "a", 10 * SEC - 1), (4, "a", 10 * SEC), (5, "b", 2 * SEC)]
    got = folds.cooldown(spark.createDataFrame(rows, "seq long, key string, at long"), ["key"], "seq", "at", 10 * SEC)
    assert [r.allowed for r in got.orderBy("seq").collect()] == [True, True, False, False, True, False]


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_cooldown_keeps_every_row_at_size(spark, adaptive):
    """Many wide rows over many partitions, against a plain replay."""
    n, period = 300_000, 50_000
    rows = spark.range(n).select(F.col("id").alias("seq"), (F.xxhash64("id") % 97).alias("key"), (F.col("id") * 10 + F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4000))).alias("at"), F.repeat(F.lit("wide "), 20).alias("note"))
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = folds.cooldown(rows, ["key"], "seq", "at", period).select("seq", "allowed").toPandas().set_index("seq")["allowed"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    clock, last, want = None, {}, {}
    for r in rows.select("seq", "key", "at").toPandas().sort_values("seq").itertuples():
        clock = r.at if clock is None else max(clock, r.at)
        want[r.seq] = r.key not in last or clock - last[r.key] >= period
        if want[r.seq]:
            last[r.key] = clock
    assert len(got) == n and got.to_dict() == want


def _rows(seed, n=200):
    rng = random.Random(seed)
    return [(i, rng.choice("abc"), rng.choice([rng.uniform(-5, 5), float("nan")] + [rng.uniform(-5, 5)] * 8), int(rng.uniform(0, 40)) * SEC + i * SEC // 4) for i in range(n)]


SCHEMA = "seq long, key string, x double, at long"


@pytest.mark.parametrize("seed", [0, 1])
def test_windows_equal_kernels(spark, seed):
    df = spark.createDataFrame(_rows(seed), SCHEMA).repartition(3)
    pairs = [
        (S.cusum(df, ["key"], ["seq"], "x", 0.0, 0.5, 3.0), folds.fold(df, ["key"], ["seq"], steps.Cusum(0.0, 0.5, 3.0), "x"), ["s_up", "s_down", "signal", "since"]),
        (S.page_hinkley(df, ["key"], ["seq"], "x", 0.2, 4.0), folds.fold(df, ["key"], ["seq"], steps.PageHinkley(0.2, 4.0), "x"), ["up", "down", "signal"]),
        (S.hysteresis(df, ["key"], ["seq"], "at", "x", 2.0, -2.0), folds.fold(df, ["key"], ["seq"], steps.Hysteresis(2.0, -2.0), "x", "at"), ["active", "transitions"]),
    ]
    for a, b, names in pairs:
        a = {r.seq: [r[n] for n in names] for r in a.collect()}
        b = {r.seq: [r[n] for n in names] for r in b.where(F.col(names[0]).isNotNull()).collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == pytest.approx(b[k]) if not isinstance(a[k][0], bool) else a[k] == b[k]


def test_stream_equals_batch(spark, tmp_path):
    rows = _rows(3, 120)
    src = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : (k + 1) * 40], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    kernel = steps.Hysteresis(2.0, -2.0, dwell_ns=5 * SEC)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = detect(stream, ["key"], ["seq"], kernel, "x", "at").writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r.seq: (r.active, r.transitions, r.held) for r in spark.table("held").collect()}
    want = {r.seq: (r.active, r.transitions, r.held) for r in folds.fold(spark.createDataFrame(rows, SCHEMA), ["key"], ["seq"], kernel, "x", "at").collect()}
    assert got == want


def test_counter_known_answer(spark):
    rows = [(0, 0, "1000"), (1, 2 * SEC, "1500"), (2, 3 * SEC, "1500"), (3, 4 * SEC, str(2**64 - 1)), (4, 5 * SEC, "5")]
    df = spark.createDataFrame(rows, "seq long, at long, t string").withColumn("k", F.lit(1)).withColumn("total", F.col("t").cast("decimal(20,0)"))
    got = S.counter_rate(df, ["k"], ["seq"], "at", "total").orderBy("seq").collect()
    assert [None if r.increase is None else int(r.increase) for r in got] == [None, 500, 0, 2**64 - 1501, None]
    assert [r.rate for r in got][1:3] == [250.0, 0.0]


def test_n_of_m_known_answer(spark):
    rows = [(k, k * SEC, float(x)) for k, x in enumerate((12, 5, 10, 3, 4, 11, 2, 15))]
    df = spark.createDataFrame(rows, "seq long, at long, x double").withColumn("k", F.lit(1))
    assert "".join("T" if r.active else "F" for r in S.n_of_m(df, ["k"], ["seq"], "at", "x", 10.0, 2, 3).orderBy("seq").collect()) == "FFTFFFFT"
