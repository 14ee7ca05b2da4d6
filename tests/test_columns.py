import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions.pvalues import incomplete_beta, student_two_sided
from lodestar.operators import columns as C

NAN = float("nan")


def _one(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double").withColumn("k", F.lit("a"))


def test_quantiles(spark):
    at = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = _one(spark, range(1, 11)).agg(C.quantiles(F.col("x"), [float(a) for a in at])).first()[0]
    assert got == pytest.approx([1, 1.9, 3.25, 5.5, 7.75, 9.1, 10])


def test_missing_values_show(spark):
    df = _one(spark, [1, 2, NAN])
    got = df.agg(C.quantiles(F.col("x"), [0.5]).alias("q"), C.extreme(F.col("x"), False).alias("a"), C.extreme(F.col("x"), True).alias("b")).first()
    assert math.isnan(got.q[0]) and math.isnan(got.a) and math.isnan(got.b)
    assert math.isnan(_one(spark, [3]).agg(C.variance(F.col("x"))).first()[0])
    r = C.describe(df, ["k"], "x").first()
    assert (r.n, r.n_missing, r["mean"], r["median"]) == (2, 1, 1.5, 1.5)


def test_student_tail():
    got = student_two_sided(np.array([1, 0.5, 3, np.inf, 1.0]), np.array([5, 18, 18, 4, 0.0]))
    assert got[:4] == pytest.approx([0.363217467649, 0.623132457297, 0.00768541214031, 0.0], rel=1e-9) and math.isnan(got[4])
    assert incomplete_beta(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)


def test_trend_known_answer(spark):
    y = [2, 4, 5, 4, 5, 7, 8, 9, 8, 10, 12, 11, 13, 14, 13, 16, 17, 16, 19, 20]
    r = C.trend(_one(spark, y), ["k"], ["i"], "x").first()
    assert (r.slope, r.se, r.t) == pytest.approx((0.886466165414, 0.034172635934, 25.9408190555), rel=1e-10)
    assert r.p == pytest.approx(1.0375193824e-15, rel=1e-6)
    exact = C.trend(_one(spark, [1, 3, 5, 7]), ["k"], ["i"], "x").first()
    assert exact.t == math.inf and exact.p == 0.0


def test_benjamini_hochberg_known_answer(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    got = {r.i: (r.q, r.rejected) for r in C.benjamini_hochberg(_one(spark, ps), ["k"], "x").collect()}
    assert [got[i][0] for i in range(10)] == pytest.approx([0.01, 0.04, 0.084, 0.084, 0.084, 0.1, 0.105714285714, 0.216, 0.216, 0.216])
    assert [got[i][1] for i in range(10)] == [True, True] + [False] * 8


ODD = [None, NAN, -0.0, 0.0, float("-inf"), float("inf"), 1.5, 2.0]


def _odd(spark, n=4000):
    """Few keys, one of them null and one of a single row; missing, tied and signed-zero values; dealt over ranges."""
    rows = [("s" if i == 0 else [None, "a", "b"][i % 3], ODD[i * i % 8] if i % 5 == 0 else float(i * 7919 % 997), ODD[i % 8] if i % 11 == 0 else i * 104729 % 1009 / 1009, i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, x double, y double, i int")


@pytest.fixture
def narrow_ranges(spark):
    """Adaptive execution off, so that values stay in as many ranges as there are shuffle partitions."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _sort_key(x):
    return (x is not None, x is not None and x != x, 0.0 if x is None or x != x else x)


def test_spearman_of_missing_and_tied_values_across_ranges(spark, narrow_ranges):
    def ranks(xs):
        keys = sorted(map(_sort_key, xs))
        first, times = {}, {}
        for at, v in enumerate(keys):
            first.setdefault(v, at)
            times[v] = times.get(v, 0) + 1
        return [first[v] + (times[v] + 1) / 2 for v in map(_sort_key, xs)]

    df = _odd(spark)
    got = {r.k: (r.n, r.rho) for r in C.spearman(df, ["k"], "x", "y").collect()}
    held = {}
    for r in df.collect():
        held.setdefault(r.k, []).append((r.x, r.y))
    assert got.keys() == held.keys() and got["s"][0] == 1 and math.isnan(got["s"][1])
    for k in (None, "a", "b"):
        want = np.corrcoef(ranks([x for x, _ in held[k]]), ranks([y for _, y in held[k]]))[0, 1]
        assert got[k] == (len(held[k]), pytest.approx(want, abs=1e-12))
    assert math.isnan(C.spearman(df.withColumn("y", F.lit(1.0)), [], "x", "y").first().rho)


@pytest.mark.parametrize("query", ["spearman", "benjamini_hochberg"])
def test_no_task_sorts_a_whole_key(spark, query, narrow_ranges):
    df = spark.range(40_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 40_009 / 40_009.0).alias("x"), (F.col("id") * 104_729 % 40_013 / 40_013.0).alias("y"))
    if query == "spearman":
        values = C._placed(df.groupBy("k", "x").agg(F.count("*").alias("__n")), ["k"], "x")
        plan = C.spearman(df, ["k"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    else:
        values = C._placed(df.groupBy("k", "y").agg(F.count("*").alias("__n")), ["k"], "y")
        plan = C.benjamini_hochberg(df, ["k"], "y")._jdf.queryExecution().executedPlan().toString()
    sizes = [r["count"] for r in values.groupBy("k", "__part").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 20_000
    # Windows over a whole key see one row for each range, with its sum or its least q.
    assert not [line for line in plan.splitlines() if "Window [" in line and not any(c in line for c in ("__part#", "(__s#", "(__least#"))]


def test_benjamini_hochberg_across_ranges(spark, narrow_ranges):
    df = _odd(spark).withColumn("z", F.lit(1))
    got = C.benjamini_hochberg(df, ["k"], "y", 0.5)
    assert got.columns == [*df.columns, "q", "rejected"]
    held = {}
    for r in got.collect():
        held.setdefault(r.k, []).append(r)
    assert sum(map(len, held.values())) == 4000
    for rows in held.values():
        keys, m = [_sort_key(r.y) for r in rows], len(rows)
        upto, own = {}, {}
        for at, v in enumerate(sorted(keys), 1):
            upto[v] = at
        for r, v in zip(rows, keys):
            own[v] = math.inf if r.y is None or r.y != r.y else r.y * m / upto[v]
        least, q = math.inf, {}
        for v in sorted(own, reverse=True):
            least = min(least, own[v])
            q[v] = min(1.0, least)
        assert all(r.q == q[v] and r.rejected == (r.q <= 0.5) for r, v in zip(rows, keys))


def test_pearson_of_a_constant(spark):
    df = _one(spark, range(30)).withColumn("y", F.lit(2.0))
    assert math.isnan(df.agg(C.pearson(F.col("x"), F.col("y"))).first()[0])
    short = C.correlate(df.where("i < 19").withColumn("y", -F.col("x")), ["k"], "x", "y").first()
    assert short.r is None and short.p is None
    full = C.correlate(df.withColumn("y", -F.col("x")), ["k"], "x", "y").first()
    assert full.r == pytest.approx(-1) and full.p == pytest.approx(0, abs=1e-12)


def test_scaler_of_a_constant_and_folds(spark):
    df = _one(spark, [5, 5, 5, 5, 5])
    r = C.min_max(C.standardise(df, df, "x"), df, "x").first()
    assert (r.z, r.scaled) == (0.0, 0.0)
    folds = C.rolling_folds(df, ["k"], ["i"], 2).groupBy("fold", "role").count().collect()
    assert {(r.fold, r.role): r["count"] for r in folds} == {(1, "train"): 1, (1, "test"): 1, (2, "train"): 2, (2, "test"): 3}


def test_forward_fill(spark):
    got = C.forward_fill(_one(spark, [NAN, 2, NAN, 3, NAN]), ["k"], ["i"], "x").orderBy("i").collect()
    assert [r.filled for r in got] == [2, 2, 2, 3, 3]
