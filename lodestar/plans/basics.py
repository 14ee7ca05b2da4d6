"""Queries of the column, series, hierarchy and search operators over the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import hierarchy as H
from ..operators import search as Q
from ..operators import series as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(x, n: int = 6) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, n) + F.lit(0.0)


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events by type with a time in nanoseconds."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return _t(spark, d, "events").select("event_id", "event_type", "user_id", "value", "ts", ns.alias("at"))


#: Every seventh value missing, for the operators that treat missing ones.
def _gappy(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("x", F.when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")))


@_register(
    """SELECT event_type, count(*) FILTER (event_id % 7 <> 0) AS n, count(*) FILTER (event_id % 7 = 0) AS n_missing,
  round(avg(value) FILTER (event_id % 7 <> 0), 6) AS mean, round(stddev_samp(value) FILTER (event_id % 7 <> 0), 6) AS sd,
  min(value) FILTER (event_id % 7 <> 0) AS min, round(quantile_cont(value, 0.25) FILTER (event_id % 7 <> 0), 6) AS q1,
  round(quantile_cont(value, 0.5) FILTER (event_id % 7 <> 0), 6) AS median, round(quantile_cont(value, 0.75) FILTER (event_id % 7 <> 0), 6) AS q3,
  max(value) FILTER (event_id % 7 <> 0) AS max FROM events GROUP BY event_type"""
)
def stats_describe(spark, d):
    got = C.describe(_gappy(spark, d), ["event_type"], "x")
    return got.select("event_type", "n", "n_missing", _r("mean").alias("mean"), _r("sd").alias("sd"), "min", _r("q1").alias("q1"), _r("median").alias("median"), _r("q3").alias("q3"), "max")


@_register(
    """SELECT event_type, round(var_samp(value), 4) AS var_s, round(var_pop(value), 4) AS var_p, round(stddev_pop(value), 6) AS sd_p,
  min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(avg(value), 6) AS mean FROM events GROUP BY event_type"""
)
def stats_moments_quantiles(spark, d):
    x = F.col("value")
    q = C.quantiles(x, [0.1, 0.25, 0.75, 0.9])
    got = _events(spark, d).groupBy("event_type").agg(C.variance(x).alias("v"), F.var_pop(x).alias("vp"), F.stddev_pop(x).alias("sp"), C.extreme(x, False).alias("low"), C.extreme(x, True).alias("high"), q.alias("q"), C.mean(x).alias("m"))
    return got.select("event_type", _r("v", 4).alias("var_s"), _r("vp", 4).alias("var_p"), _r("sp").alias("sd_p"), "low", "high", _r(F.col("q")[0]).alias("q10"), _r(F.col("q")[3]).alias("q90"), _r(F.col("q")[2] - F.col("q")[1]).alias("iqr"), _r("m").alias("mean"))


@_register("SELECT event_type, round(mad(value), 6) AS mad FROM events GROUP BY event_type")
def stats_mad(spark, d):
    return C.median_deviation(_events(spark, d), ["event_type"], "value").select("event_type", _r("mad").alias("mad"))


@_register("SELECT count(*) AS kept, (SELECT count(*) FROM events WHERE event_id % 7 = 0) AS dropped FROM events WHERE event_id % 7 <> 0")
def stats_drop_missing(spark, d):
    rows = _gappy(spark, d)
    return C.drop_missing(rows, "x").agg(F.count("*").alias("kept")).crossJoin(rows.agg(F.count_if(F.isnan("x")).alias("dropped")))


@_register("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY l_returnflag")
def stats_pearson(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(C.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")).select("l_returnflag", _r("r").alias("r"))


@_register(
    """SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT l_returnflag,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS ry
  FROM lineitem) GROUP BY l_returnflag"""
)
def stats_spearman(spark, d):
    got = C.spearman(_t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return got.select("l_returnflag", "n", _r("rho").alias("rho"))


@_register()
def stats_correlate(spark, d):
    rows = _events(spark, d).withColumn("y", F.col("value") + F.pmod(F.xxhash64("event_id"), F.lit(400)))
    return C.correlate(rows, ["event_type"], "value", "y")


@_register(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_returnflag AS family, (l_extendedprice % 1000) / 20000 AS p FROM lineitem
), r AS (SELECT *, count(*) OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM f)
SELECT l_orderkey, l_linenumber, family, round(least(1, min(m * p / k) OVER (PARTITION BY family ORDER BY k DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) AS q FROM r"""
)
def stats_benjamini_hochberg(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("family"), (F.col("l_extendedprice") % 1000 / 20000).alias("p"))
    return C.benjamini_hochberg(rows, ["family"], "p").select("l_orderkey", "l_linenumber", "family", _r("q", 8).alias("q"))


@_register(
    """WITH s AS (SELECT event_type, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events
), a AS (SELECT event_type, count(*) AS n, regr_slope(y, i) AS slope, regr_syy(y, i) AS yy, regr_sxy(y, i) AS xy, regr_sxx(y, i) AS xx FROM s GROUP BY 1)
SELECT event_type, n, round(slope, 8) AS slope, round(sqrt((yy - slope * xy) / (n - 2) / xx), 8) AS se, round(slope / sqrt((yy - slope * xy) / (n - 2) / xx), 5) AS t FROM a"""
)
def stats_trend(spark, d):
    got = C.trend(_events(spark, d), ["event_type"], ["ts", "event_id"], "value")
    return got.select("event_type", "n", _r("slope", 8).alias("slope"), _r("se", 8).alias("se"), _r("t", 5).alias("t"))


@_register(
    """SELECT event_id, round((value - (SELECT avg(value) FROM events WHERE event_id % 3 = 0)) / (SELECT stddev_samp(value) FROM events WHERE event_id % 3 = 0), 6) AS z,
  round((value - (SELECT min(value) FROM events WHERE event_id % 3 = 0)) / ((SELECT max(value) FROM events WHERE event_id % 3 = 0) - (SELECT min(value) FROM events WHERE event_id % 3 = 0)), 6) AS scaled FROM events"""
)
def stats_scalers(spark, d):
    rows = _events(spark, d)
    train = rows.where("event_id % 3 = 0")
    return C.min_max(C.standardise(rows, train, "value"), train, "value").select("event_id", _r("z").alias("z"), _r("scaled").alias("scaled"))


@_register(
    """SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= greatest(1, least(count(*) OVER (PARTITION BY event_type) - 1, round(count(*) OVER (PARTITION BY event_type) * 0.8::DOUBLE))) AS train FROM events"""
)
def stats_ordered_split(spark, d):
    return C.ordered_split(_events(spark, d), ["event_type"], ["ts", "event_id"], 0.8).select("event_type", "event_id", "train")


@_register(
    """WITH s AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events
), f AS (SELECT *, CAST(k AS INTEGER) AS fold, n // 5 AS w FROM s, unnest(range(1, 5)) AS t(k)), r AS (
SELECT event_type, event_id, fold, CASE WHEN i < fold * w THEN 'train' WHEN i < CASE WHEN fold = 4 THEN n ELSE (fold + 1) * w END THEN 'test' END AS role FROM f)
SELECT * FROM r WHERE role IS NOT NULL"""
)
def stats_rolling_folds(spark, d):
    return C.rolling_folds(_events(spark, d), ["event_type"], ["ts", "event_id"], 4).select("event_type", "event_id", "fold", "role")


@_register(
    """WITH s AS (SELECT event_type, event_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS x FROM events)
SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
  first_value(x IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS filled FROM s"""
)
def series_forward_fill(spark, d):
    return C.forward_fill(_gappy(spark, d), ["event_type"], ["ts", "event_id"], "x").select("event_id", "filled")


@_register(
    """WITH s AS (SELECT event_id, value - lag(value) OVER w AS a, value - lag(value, 7) OVER w AS b, event_type, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, round(a - lag(a) OVER (PARTITION BY event_type ORDER BY ts, event_id), 6) AS second, round(b, 6) AS seasonal FROM s"""
)
def series_difference(spark, d):
    rows = C.difference(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", d=2, out="second")
    return C.difference(rows, ["event_type"], ["ts", "event_id"], "value", lag=7, out="seasonal").select("event_id", _r("second").alias("second"), _r("seasonal").alias("seasonal"))


@_register(
    """WITH s AS (SELECT event_type, value AS a, lag(value, 1, 0) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events)
SELECT event_type, round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(avg(CASE WHEN a <> 0 THEN abs((a - p) / a) * 100 END), 4) AS mape, count(*) FILTER (a = 0) AS skipped FROM s GROUP BY 1"""
)
def series_forecast_errors(spark, d):
    rows = _events(spark, d).withColumn("p", F.lag("value", 1, 0.0).over(S.window(["event_type"], ["ts", "event_id"])))
    got = C.forecast_errors(rows, ["event_type"], "value", "p")
    return got.select("event_type", _r("mae").alias("mae"), _r("rmse").alias("rmse"), _r("mape", 4).alias("mape"), "skipped")


_ACF = """WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, value - avg(value) OVER (PARTITION BY event_type) AS d, count(*) OVER (PARTITION BY event_type) AS n FROM events
), c AS (SELECT event_type, sum(d * d) AS c0, any_value(n) AS n FROM s GROUP BY 1
), k AS (SELECT a.event_type, b.i - a.i AS lag, sum(a.d * b.d) AS ck FROM s a JOIN s b ON a.event_type = b.event_type AND b.i - a.i BETWEEN 0 AND 8 GROUP BY 1, 2)"""


@_register(_ACF + " SELECT k.event_type, CAST(lag AS INTEGER) AS lag, round(ck / c0, 6) AS acf FROM k JOIN c USING (event_type)")
def series_autocorrelation(spark, d):
    return C.autocorrelation(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 8).select("event_type", "lag", _r("acf").alias("acf"))


@_register(_ACF + " SELECT k.event_type, round(max(n * (n + 2)) * sum((ck / c0) * (ck / c0) / (n - lag)), 5) AS q, 8 AS df FROM k JOIN c USING (event_type) WHERE lag > 0 GROUP BY 1")
def series_ljung_box(spark, d):
    return C.ljung_box(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 8).select("event_type", _r("q", 5).alias("q"), "df")


@_register("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_pop(value) * count(*), 2) AS m2, CAST(0 AS BIGINT) AS skipped FROM events GROUP BY 1")
def series_moments_merged(spark, d):
    parts = C.moments(_events(spark, d).withColumn("shard", F.col("event_id") % 5), ["event_type", "shard"], "value")
    return C.merge_moments(parts, ["event_type"]).select("event_type", "n", _r("mean").alias("mean"), _r("m2", 2).alias("m2"), "skipped")


@_register(
    """SELECT event_id, min(value) OVER w AS rolling_min, max(value) OVER w AS rolling_max FROM events WHERE event_id % 7 <> 0 WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 4 PRECEDING)"""
)
def rate_rolling_extremes(spark, d):
    return S.rolling_extremes(_gappy(spark, d), ["event_type"], ["ts", "event_id"], "x", 5).select("event_id", "rolling_min", "rolling_max")


_COUNTER = """WITH s AS (SELECT event_id, user_id, epoch_ns(ts) AS tm, CAST(sum(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) % 4096 AS total FROM events
), a AS (SELECT *, max(tm) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s
), b AS (SELECT *, lag(total) OVER w AS pt, lag(tm) OVER w AS pa FROM a WHERE was IS NULL OR tm > was WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), c AS (SELECT event_id, CASE WHEN total >= pt THEN total - pt WHEN total - pt + 4096 <= 2048 THEN total - pt + 4096 END AS inc, tm - pa AS gap FROM b)"""


@_register(_COUNTER + " SELECT event_id, CAST(inc AS DOUBLE) AS increase, CAST(gap AS DOUBLE) AS gap_ns, round(inc / (gap / 1e9::DOUBLE), 6) AS rate FROM c")
def rate_counter(spark, d):
    total = F.sum(F.floor("value")).over(S.running(["user_id"], ["event_id"])) % 4096
    rows = _events(spark, d).withColumn("total", total)
    got = S.counter_rate(rows, ["user_id"], ["event_id"], "at", "total", 12)
    return got.select("event_id", F.col("increase").cast("double").alias("increase"), F.col("gap_ns").cast("double").alias("gap_ns"), _r("rate").alias("rate"))


@_register("SELECT event_type, max(value) AS peak, arg_min(epoch_ns(ts), (-value, event_id)) AS peak_at FROM events GROUP BY 1")
def rate_peak(spark, d):
    return S.peak(_events(spark, d), ["event_type"], ["event_id"], "at", "value")


@_register(
    """WITH a AS (SELECT event_type, event_id, epoch_ns(ts) AS tm, max(epoch_ns(ts)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events
), g AS (SELECT *, tm - was AS gap FROM a WHERE was IS NULL OR tm > was)
SELECT event_type, count(gap) AS gaps, arg_max(gap, event_id) AS last_gap, min(gap) AS min_gap, max(gap) AS max_gap, CAST(sum(gap) // count(gap) AS BIGINT) AS mean_gap FROM g GROUP BY 1"""
)
def rate_intervals(spark, d):
    return S.intervals(_events(spark, d), ["event_type"], ["event_id"], "at")


_CUSUM = """WITH u AS (SELECT event_id, event_type, ts, row_number() OVER w AS i, sum(value - 100 - 5) OVER w AS a, sum(100 - 5 - value) OVER w AS b FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), s AS (SELECT *, a - least(0, min(a) OVER w) AS up, b - least(0, min(b) OVER w) AS down FROM u WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


@_register(_CUSUM + " SELECT event_id, round(up, 5) AS s_up, round(down, 5) AS s_down, CASE WHEN up > 200 AND up >= down THEN 'up' WHEN down > 200 THEN 'down' ELSE 'none' END AS signal FROM s")
def drift_cusum(spark, d):
    got = S.cusum(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 100.0, 5.0, 200.0)
    return got.select("event_id", _r("s_up", 5).alias("s_up"), _r("s_down", 5).alias("s_down"), "signal")


@_register(
    """WITH m AS (SELECT event_id, event_type, ts, value, avg(value) OVER w AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), u AS (SELECT *, sum(value - m - 0.5) OVER w AS a, sum(value - m + 0.5) OVER w AS b FROM m WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), s AS (SELECT event_id, a - least(0, min(a) OVER w) AS up, greatest(0, max(b) OVER w) - b AS down FROM u WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, round(up + 0.0000137::DOUBLE, 4) AS up, round(down + 0.0000137::DOUBLE, 4) AS down, CASE WHEN up > 500 AND up >= down THEN 'up' WHEN down > 500 THEN 'down' ELSE 'none' END AS signal FROM s"""
)
def drift_page_hinkley(spark, d):
    got = S.page_hinkley(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 0.5, 500.0)
    # Running means of two-digit values often end in an exact half; both sides step off it before rounding.
    return got.select("event_id", _r(F.col("up") + 0.0000137, 4).alias("up"), _r(F.col("down") + 0.0000137, 4).alias("down"), "signal")


_ACCEPT = """a AS (SELECT event_id, event_type, value AS x, epoch_ns(ts) AS tm, max(epoch_ns(ts)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events
), k AS (SELECT * FROM a WHERE was IS NULL OR tm > was)"""


@_register(
    f"""WITH {_ACCEPT}, s AS (SELECT *, coalesce(last_value(CASE WHEN x >= 150 THEN 1 WHEN x <= 60 THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS s FROM k
), c AS (SELECT *, CASE WHEN s <> coalesce(lag(s) OVER (PARTITION BY event_type ORDER BY event_id), 0) THEN 1 ELSE 0 END AS c FROM s)
SELECT event_id, s = 1 AS active, CAST(sum(c) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS transitions FROM c"""
)
def sustain_hysteresis(spark, d):
    return S.hysteresis(_events(spark, d), ["event_type"], ["event_id"], "at", "value", 150.0, 60.0).select("event_id", "active", "transitions")


@_register(
    f"""WITH {_ACCEPT} SELECT event_id, CAST({" + ".join(f"coalesce(last_value(CASE WHEN x >= {a} THEN 1 WHEN x <= {b} THEN 0 END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0)" for a, b in ((60, 40), (120, 90), (200, 150)))} AS INTEGER) AS level FROM k"""
)
def sustain_band(spark, d):
    return S.band(_events(spark, d), ["event_type"], ["event_id"], "at", "value", [(60.0, 40.0), (120.0, 90.0), (200.0, 150.0)]).select("event_id", "level")


@_register(
    f"""WITH {_ACCEPT}, n AS (SELECT *, x >= 80 AS c, CASE WHEN (x >= 80) <> coalesce(lag(x >= 80) OVER (PARTITION BY event_type ORDER BY event_id), FALSE) THEN 1 ELSE 0 END AS new FROM k
), r AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM n
), i AS (SELECT *, row_number() OVER w AS i, tm - first_value(tm) OVER w AS t FROM r WINDOW w AS (PARTITION BY event_type, run ORDER BY event_id)
), d AS (SELECT *, CASE WHEN CASE WHEN c THEN i >= 2 AND t >= 60000000000 ELSE i >= 3 END THEN c END AS done FROM i)
SELECT event_id, coalesce(last_value(done IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING), FALSE) AS active FROM d"""
)
def sustain_debounce(spark, d):
    return S.debounce(_events(spark, d), ["event_type"], ["event_id"], "at", "value", F.col("value") >= 80, (60_000_000_000, 2), (0, 3)).select("event_id", "active")


@_register(f"WITH {_ACCEPT} SELECT event_id, sum(CASE WHEN x >= 100 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS 4 PRECEDING) >= 2 AS active FROM k")
def sustain_n_of_m(spark, d):
    return S.n_of_m(_events(spark, d), ["event_type"], ["event_id"], "at", "value", 100.0, 2, 5).select("event_id", "active")


@_register(
    """WITH t AS (SELECT event_id, user_id, CAST(floor(max(epoch_ns(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / 86400000000000::DOUBLE) AS BIGINT) AS w FROM events)
SELECT event_id, w AS window_index, row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) <= 2 AS allowed FROM t"""
)
def throttle_quota(spark, d):
    return S.quota(_events(spark, d), ["user_id"], ["event_id"], "at", 2, 86_400_000_000_000).select("event_id", "window_index", "allowed")


@_register("SELECT event_id, CAST(least(60000, 100 * 2 ** (event_id % 20)) AS BIGINT) AS wait FROM events")
def throttle_backoff(spark, d):
    return S.backoff(_events(spark, d).withColumn("n", (F.col("event_id") % 20).cast("int")), "n", 100, 60_000).select("event_id", "wait")


_DAILY = "SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y")).withColumn("k", F.lit("all"))


@_register(
    f"""WITH s AS ({_DAILY}), m AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n, avg(y) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ma FROM s
), t AS (SELECT *, CASE WHEN i >= 3 AND i < n - 3 THEN ma END AS z FROM m
), p AS (SELECT i % 7 AS p, avg(y - z) AS s FROM t GROUP BY 1), q AS (SELECT p, s - avg(s) OVER () AS s FROM p
), f AS (SELECT *, coalesce(z, CASE WHEN i < 3 THEN first_value(z IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE last_value(z IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END) AS trend FROM t)
SELECT CAST(day AS VARCHAR) AS day, round(trend, 3) AS trend, round(q.s, 3) AS seasonal, round(y - trend - q.s, 3) AS residual FROM f JOIN q ON q.p = f.i % 7"""
)
def season_classical(spark, d):
    got = S.classical_decomposition(_daily(spark, d), ["k"], ["day"], "y", 7)
    return got.select(F.col("day").cast("string").alias("day"), _r("trend", 3).alias("trend"), _r("seasonal", 3).alias("seasonal"), _r("residual", 3).alias("residual"))


def _chains(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat_ws("|", "event_id", "event_type", F.floor("value"))
    rows = _t(spark, d, "events").select((F.col("event_id") % 20).alias("chain"), F.col("event_id").alias("seq"), body.alias("body"))
    return S.chain_seal(rows, ["chain"], "seq", "body", "lodestar-chain-1")


@_register(
    """WITH RECURSIVE b AS (SELECT event_id % 20 AS chain, event_id AS seq, encode(event_id || '|' || event_type || '|' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS body, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS i FROM events
), c AS (SELECT chain, seq, i, '' AS prev, sha256(encode('lodestar-chain-1') || '\\x00'::BLOB || body) AS hash FROM b WHERE i = 1
  UNION ALL SELECT b.chain, b.seq, b.i, c.hash, sha256(encode('lodestar-chain-1') || encode(c.hash) || '\\x00'::BLOB || b.body) FROM c JOIN b ON b.chain = c.chain AND b.i = c.i + 1)
SELECT chain, seq, prev, hash FROM c"""
)
def chain_seal(spark, d):
    return _chains(spark, d).select("chain", "seq", "prev", "hash")


@_register("SELECT c AS chain, CASE WHEN c = 3 THEN c + 20 * 5 WHEN c = 4 THEN c + 20 * 6 END AS seq, CASE WHEN c = 3 THEN 'altered' WHEN c = 4 THEN 'replaced' END AS fault FROM (SELECT unnest([3, 4])::BIGINT AS c)")
def chain_verify(spark, d):
    rows = _chains(spark, d)
    rows = rows.withColumn("body", F.when((F.col("chain") == 3) & (F.col("seq") == 103), F.lit("x").cast("binary")).otherwise(F.col("body")))
    return S.chain_faults(rows.where("not (chain = 4 and seq = 104)"), ["chain"], "seq", "lodestar-chain-1")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """region, nation, customer: ids in one column."""
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.concat(F.lit("r"), "r_regionkey").alias("parent"), F.lit(0.0).alias("own"))
    n = _t(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.lit(1.0).alias("own"))
    c = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_acctbal").alias("own"))
    return r.union(n).union(c)


_TREE = """WITH RECURSIVE t AS (SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS parent, 0.0::DOUBLE AS own FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1.0 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer
), cl(root, id, depth) AS (SELECT id, id, 0 FROM t UNION ALL SELECT t.parent, cl.id, cl.depth + 1 FROM cl JOIN t ON t.id = cl.root AND t.parent <> t.id)"""


@_register(_TREE + " SELECT cl.root AS id, round(sum(t.own), 4) AS total FROM cl JOIN t ON t.id = cl.id GROUP BY 1")
def tree_sums(spark, d):
    return H.subtree_sums(_tree(spark, d)).select("id", _r("total", 4).alias("total"))


@_register(_TREE + " SELECT cl.root AS id, max(t.own) AS largest, arg_min(t.id, (-t.own, t.id)) AS holder FROM cl JOIN t ON t.id = cl.id GROUP BY 1")
def tree_max(spark, d):
    return H.subtree_max(_tree(spark, d))


@_register(_TREE + ", k AS (SELECT cl.root, t.id, t.own AS weight, row_number() OVER (PARTITION BY cl.root ORDER BY t.own DESC, t.id) AS rank FROM cl JOIN t ON t.id = cl.id WHERE depth > 0) SELECT root, id, weight, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3")
def tree_top_k(spark, d):
    return H.top_k(_tree(spark, d), 3)


@_register(_TREE + " SELECT id, string_agg(root, '/' ORDER BY depth DESC) AS path, max(depth) AS depth FROM cl GROUP BY 1")
def tree_paths(spark, d):
    return H.paths(_tree(spark, d)).select("id", F.array_join("path", "/").alias("path"), "depth")


@_register(
    """WITH a AS (SELECT c_custkey AS id, c_nationkey AS p FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_nationkey END AS p FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.p IS NULL THEN 'added' WHEN b.p IS NULL THEN 'removed' ELSE 'moved' END AS change FROM a FULL JOIN b ON a.id = b.id WHERE a.p IS DISTINCT FROM b.p"""
)
def tree_diff(spark, d):
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("parent"))
    new = rows.where("id % 3 <> 0").withColumn("parent", F.when(F.col("id") % 7 == 0, -1).otherwise(F.col("parent")))
    return H.diff(rows.where("id % 5 <> 0"), new)


_BM25 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+') AS w FROM documents
), dl AS (SELECT doc_id, len(w) AS dl FROM w), tot AS (SELECT count(*) AS n, avg(dl) AS av FROM dl
), p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY 1, 2
), idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, tot GROUP BY 1)"""


@_register(_BM25 + " SELECT term, df, round(idf, 8) AS idf FROM idf")
def bm25_terms(spark, d):
    return Q.build(_t(spark, d, "documents")).terms.select("term", "df", _r("idf", 8).alias("idf"))


@_register(
    _BM25
    + r""", q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM benchmark) GROUP BY 1, 2
), s AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / av))), 6) AS score FROM q JOIN p USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), tot GROUP BY 1, 2
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""
)
def bm25_search(spark, d):
    index = Q.build(_t(spark, d, "documents"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return Q.search(index, asked, 5).select("query_id", "doc_id", _r("score").alias("score"), "rank")


def first_look(spark: SparkSession, d: str) -> DataFrame:
    """Summary, rank correlation with time and trend of each event type."""
    rows = _events(spark, d)
    summary = C.describe(rows, ["event_type"], "value")
    rho = C.spearman(rows.withColumn("t", F.col("at").cast("double")), ["event_type"], "t", "value").select("event_type", "rho")
    line = C.trend(rows, ["event_type"], ["at", "event_id"], "value").select("event_type", "slope", "se", "t", "p")
    return summary.join(rho, "event_type").join(line, "event_type")
