"""Queries of folds, per-series models, codecs, JSON extraction and the versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonfind, steps
from ..operators import columns as C
from ..operators import folds, models
from ..sources.ocf import OcfSource
from ..sources.versioned import VersionedTable
from ..semantics import shared_folder
from .basics import _events, _r, _t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


_S = "s AS (SELECT user_id AS k, event_id, value AS x, epoch_ns(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)"
#: Readings that move their user's time forward.
_A = """s0 AS (SELECT user_id AS k, event_id, value AS x, epoch_ns(ts) AS t, max(epoch_ns(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events
), s AS (SELECT k, event_id, x, t, row_number() OVER (PARTITION BY k ORDER BY event_id) AS i FROM s0 WHERE was IS NULL OR t > was)"""


@_register(
    f"""WITH RECURSIVE {_S}, r AS (SELECT k, event_id, i, x AS v FROM s WHERE i = 1 UNION ALL SELECT s.k, s.event_id, s.i, r.v + 0.3::DOUBLE * (s.x - r.v) FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, round(v, 6) AS ewma FROM r"""
)
def drift_ewma(spark, d):
    got = folds.fold(_events(spark, d), ["user_id"], ["event_id"], steps.Ewma(0.3), "value")
    return got.select("event_id", _r("ewma").alias("ewma"))


@_register(
    f"""WITH RECURSIVE {_S}, r AS (SELECT k, event_id, i, 0.2::DOUBLE * x + 0.8::DOUBLE * 100 AS z FROM s WHERE i = 1 UNION ALL SELECT s.k, s.event_id, s.i, 0.2::DOUBLE * s.x + 0.8::DOUBLE * r.z FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1
), w AS (SELECT *, 3 * 40 * sqrt(0.2::DOUBLE / 1.8::DOUBLE * (1 - 0.8::DOUBLE ** (2 * i))) AS w FROM r)
SELECT event_id, round(z, 6) AS z, round(100 - w, 6) AS lower, round(100 + w, 6) AS upper, CASE WHEN z > 100 + w THEN 'up' WHEN z < 100 - w THEN 'down' ELSE 'none' END AS signal FROM w"""
)
def drift_ewma_chart(spark, d):
    got = folds.fold(_events(spark, d), ["user_id"], ["event_id"], steps.EwmaChart(100.0, 40.0), "value")
    return got.select("event_id", _r("z").alias("z"), _r("lower").alias("lower"), _r("upper").alias("upper"), "signal")


@_register(
    f"""WITH RECURSIVE {_A.replace("value AS x", "CAST(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS x")}
, r AS (SELECT k, event_id, i, x, t, NULL::DOUBLE AS a FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.event_id, s.i, s.x, s.t, CASE WHEN r.a IS NULL THEN (s.x - r.x) / ((s.t - r.t) / 1e9::DOUBLE) ELSE r.a + ((s.x - r.x) / ((s.t - r.t) / 1e9::DOUBLE) - r.a) * (1 - exp(-(s.t - r.t) / 86400e9::DOUBLE)) END FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, round(a * 1000, 5) AS rate FROM r"""
)
def drift_decayed_rate(spark, d):
    from ..semantics import running

    rows = _events(spark, d).withColumn("total", F.sum("value").over(running(["user_id"], ["event_id"])))
    got = folds.fold(rows, ["user_id"], ["event_id"], steps.DecayedRate(86_400_000_000_000), "total", "at")
    seen = _accepted(rows)
    return got.join(seen, "event_id", "left_semi").select("event_id", _r(F.col("rate") * 1000, 5).alias("rate"))


def _accepted(rows: DataFrame) -> DataFrame:
    from ..semantics import accepted

    return accepted(rows, ["user_id"], ["event_id"], "at", "value").select("event_id")


@_register(
    f"""WITH RECURSIVE {_A}, r AS (SELECT k, event_id, i, t, x AS o FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.event_id, s.i, s.t, least(greatest(s.x, r.o - 0.0005::DOUBLE * ((s.t - r.t) / 1e9::DOUBLE)), r.o + 0.001::DOUBLE * ((s.t - r.t) / 1e9::DOUBLE)) FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, round(o, 6) AS slewed FROM r"""
)
def sustain_slew(spark, d):
    got = folds.fold(_events(spark, d), ["user_id"], ["event_id"], steps.Slew(0.001, 0.0005), "value", "at")
    return got.where("slewed is not null").select("event_id", _r("slewed").alias("slewed"))


_DWELL = 86_400_000_000_000 * 3


@_register(
    f"""WITH RECURSIVE {_A}, w AS (SELECT *, CASE WHEN x >= 100 THEN 1 WHEN x <= 50 THEN 0 END AS want FROM s
), r AS (SELECT k, event_id, i, coalesce(want, 0) AS a, t AS since, CASE WHEN want = 1 THEN 1 ELSE 0 END AS c, 0 AS h FROM w WHERE i = 1
  UNION ALL SELECT w.k, w.event_id, w.i, CASE WHEN coalesce(want, a) <> a AND NOT (c > 0 AND t - since < {_DWELL}) THEN want ELSE a END,
    CASE WHEN coalesce(want, a) <> a AND NOT (c > 0 AND t - since < {_DWELL}) THEN t ELSE since END, c + CASE WHEN coalesce(want, a) <> a AND NOT (c > 0 AND t - since < {_DWELL}) THEN 1 ELSE 0 END,
    h + CASE WHEN coalesce(want, a) <> a AND c > 0 AND t - since < {_DWELL} THEN 1 ELSE 0 END FROM r JOIN w ON w.k = r.k AND w.i = r.i + 1)
SELECT event_id, a = 1 AS active, CAST(c AS BIGINT) AS transitions, CAST(h AS BIGINT) AS held FROM r"""
)
def sustain_hysteresis_dwell(spark, d):
    got = folds.fold(_events(spark, d), ["user_id"], ["event_id"], steps.Hysteresis(100.0, 50.0, dwell_ns=_DWELL), "value", "at")
    return got.where("active is not null").select("event_id", F.col("active").cast("boolean").alias("active"), F.col("transitions").cast("long").alias("transitions"), F.col("held").cast("long").alias("held"))


_PER = 86_400_000_000_000


@_register(
    f"""WITH RECURSIVE s AS (SELECT user_id AS k, event_id, 1 + event_id % 3 AS n, CAST(max(epoch_ns(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), r AS (SELECT k, event_id, i, t, TRUE AS ok, CAST(n * {_PER} AS HUGEINT) AS debt FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.event_id, s.i, s.t, greatest(debt - (s.t - r.t), 0) <= (4 - n) * {_PER}::HUGEINT, greatest(debt - (s.t - r.t), 0) + CASE WHEN greatest(debt - (s.t - r.t), 0) <= (4 - n) * {_PER}::HUGEINT THEN n * {_PER}::HUGEINT ELSE 0 END FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, ok AS allowed FROM r"""
)
def throttle_bucket(spark, d):
    rows = _events(spark, d).withColumn("n", 1 + F.col("event_id") % 3)
    return folds.fold(rows, ["user_id"], ["event_id"], steps.Bucket(_PER, 4), "n", "at").select("event_id", "allowed")


@_register(
    f"""WITH RECURSIVE s AS (SELECT user_id AS k, event_id, max(epoch_ns(ts)) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events
), r AS (SELECT k, event_id, i, t AS last, TRUE AS ok FROM s WHERE i = 1 UNION ALL SELECT s.k, s.event_id, s.i, CASE WHEN s.t - r.last >= {_PER} THEN s.t ELSE r.last END, s.t - r.last >= {_PER} FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, ok AS allowed FROM r"""
)
def throttle_cooldown(spark, d):
    return folds.cooldown(_events(spark, d), ["user_id"], "event_id", "at", _PER).select("event_id", "allowed")


@_register(
    f"""WITH RECURSIVE s0 AS (SELECT user_id AS k, event_id, 1 + event_id % 3 AS n, CAST(floor(max(epoch_ns(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) / ({_PER}::DOUBLE * 7)) AS BIGINT) AS w FROM events
), s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS i FROM s0
), r AS (SELECT k, event_id, i, w, TRUE AS ok, n AS used FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.event_id, s.i, s.w, n <= 4 - CASE WHEN s.w = r.w THEN used ELSE 0 END, CASE WHEN s.w = r.w THEN used ELSE 0 END + CASE WHEN n <= 4 - CASE WHEN s.w = r.w THEN used ELSE 0 END THEN n ELSE 0 END FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT event_id, ok AS allowed, CAST(4 - used AS BIGINT) AS remaining FROM r"""
)
def throttle_quota_units(spark, d):
    rows = _events(spark, d).withColumn("n", 1 + F.col("event_id") % 3)
    got = folds.fold(rows, ["user_id"], ["event_id"], steps.Quota(4, 7 * _PER), "n", "at")
    return got.select("event_id", "allowed", F.col("remaining").cast("long").alias("remaining"))


@_register()
def throttle_breaker(spark, d):
    """Every third event is a question, the others are results; a result is a failure below 80."""
    x = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise((F.col("value") >= 80).cast("double"))
    rows = _events(spark, d).withColumn("x", x)
    return folds.fold(rows, ["user_id"], ["event_id"], steps.Breaker(2, _PER), "x", "at").select("event_id", "state", "allowed")


@_register()
def season_decompose(spark, d):
    got = models.decompose(_daily(spark, d), ["k"], ["day"], "y")
    return got.select("day", _r("trend", 3).alias("trend"), _r("seasonal", 3).alias("seasonal"), _r("residual", 3).alias("residual"), "period", "new_line")


@_register()
def season_periods(spark, d):
    return models.periods(_daily(spark, d), ["k"], ["day"], "y")


@_register()
def season_forecast(spark, d):
    return models.seasonal_forecast(_daily(spark, d), ["k"], ["day"], "y", 14, 7)


@_register()
def season_fourier(spark, d):
    return models.fourier_season(_daily(spark, d), F.datediff("day", F.lit("1970-01-01")), ["k"], "y", 7, 3)


@_register()
def arimax_forecast(spark, d):
    """Daily revenue of each order status on the day's orders; the last week is forecast."""
    rows = _t(spark, d, "orders").groupBy("o_orderstatus", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("n"))
    last = rows.groupBy("o_orderstatus").agg(F.date_sub(F.max("day"), 7).alias("cut"))
    rows = rows.join(last, "o_orderstatus")
    return models.arimax_forecast(rows.where("day <= cut"), rows.where("day > cut"), ["o_orderstatus"], ["day"], "y", ["n"], (1, 0, 1))


@_register()
def series_partial_autocorrelation(spark, d):
    return models.partial_autocorrelation(C.autocorrelation(_events(spark, d), ["event_type"], ["ts", "event_id"], "value", 8), ["event_type"])


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y")).withColumn("k", F.lit("all"))


@_register("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS t FROM events")
def salvage_decode(spark, d):
    """JSON put into prose in several ways, and found again."""
    inner = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": "'), F.col("event_type"), F.lit('"}'))
    text = F.element_at(F.array(inner, F.concat(F.lit("Sure {ok: "), F.lit("here}:\n```json\n"), inner, F.lit("\n```\nDone.")), F.concat(F.lit("a \" quote ["), F.lit("1] "), inner, F.lit(" {tail"))), (F.col("event_id") % 3 + 1).cast("int"))
    rows = _t(spark, d, "events").select("event_id", jsonfind.decoded(text, {"k": int, "t": str}, strict=True).alias("j"))
    return rows.select("event_id", F.from_json("j", "k bigint, t string").alias("v")).select("event_id", "v.k", "v.t")


@_register("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'truncated' ELSE 'no_json' END AS status FROM events")
def salvage_status(spark, d):
    one = F.concat(F.lit('{"k": '), F.col("event_id"), F.lit("}"))
    text = F.element_at(F.array(F.concat(F.lit("see [")  , one, F.lit("]")), F.concat(one, F.lit(" or "), one), F.lit('{"k": 1'), F.lit("none at all")), (F.col("event_id") % 4 + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", jsonfind.judged(text, {"k": int}).getField("status").alias("status"))


@_register("SELECT event_id, CAST(1 + event_id % 2 AS BIGINT) AS n, CAST(8 AS BIGINT) AS first_start FROM events")
def salvage_candidates(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('é said {"a": 1}')).otherwise(F.lit('é said {"a": [1, "}"]} [2]'))
    found = jsonfind.candidates(_t(spark, d, "events").select("event_id", text.alias("text")), "text")
    return found.groupBy("event_id").agg(F.count_if("valid").alias("n"), F.min("start").alias("first_start"))


@_register("SELECT vec_id, label, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def avro_round_trip(spark, d):
    spark.dataSource.register(OcfSource)
    path = f"{shared_folder(spark)}.ocf"
    _t(spark, d, "embeddings").write.format("ocf").mode("append").save(path)
    got = spark.read.format("ocf").load(path)
    return got.select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def _versions(spark: SparkSession, d: str) -> VersionedTable:
    """Three upserts and a delete of customers."""
    t = VersionedTable(spark, shared_folder(spark), "customers")
    rows = _t(spark, d, "customer").select(F.format_string("c%08d", "c_custkey").alias("key"), F.col("c_custkey").alias("n"))

    def put(where: str, tag: str) -> None:
        t.put(rows.where(where).select("key", F.concat(F.lit(f"{tag}:"), "n").cast("binary").alias("payload")))

    put("true", "first")
    put("n % 3 = 0", "second")
    t.delete(rows.where("n % 5 = 0").select("key"))
    put("n % 10 = 0", "third")
    return t


_KEY = "'c' || lpad(c_custkey::VARCHAR, 8, '0')"
_LIVE = f"""SELECT {_KEY} AS key, CASE WHEN c_custkey % 10 = 0 THEN 'third:' WHEN c_custkey % 3 = 0 THEN 'second:' ELSE 'first:' END || c_custkey AS payload,
  CAST(CASE WHEN c_custkey % 10 = 0 THEN 4 WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS ver FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0"""


@_register(_LIVE)
def table_scan(spark, d):
    return _versions(spark, d).scan().select("key", F.col("payload").cast("string").alias("payload"), "ver")


@_register(f"SELECT {_KEY} AS key, CASE WHEN c_custkey % 3 = 0 THEN 'second:' ELSE 'first:' END || c_custkey AS payload FROM customer")
def table_time_travel(spark, d):
    return _versions(spark, d).scan(version=2).select("key", F.col("payload").cast("string").alias("payload"))


@_register(
    f"""SELECT {_KEY} AS key, 'del' AS op, CAST(3 AS BIGINT) AS ver FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT {_KEY}, 'put', 4 FROM customer WHERE c_custkey % 10 = 0"""
)
def table_changes(spark, d):
    return _versions(spark, d).changes(2).select("key", "op", "ver")


@_register(_LIVE)
def table_compacted(spark, d):
    t = _versions(spark, d)
    t.compact()
    return t.scan().select("key", F.col("payload").cast("string").alias("payload"), "ver")


@_register(r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS spaced FROM documents")
def text_normalize_space(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("spaced"))
