"""Column statistics: aggregates, correlation, trend, false-discovery control, scalers, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import two_sided_p
from ..semantics import before, finite, missing, nan, running, settled, window


def _if_any_missing(x: Column, value: Column) -> Column:
    return F.when(F.max(missing(x).cast("int")) == 1, nan()).otherwise(value)


def mean(x: Column) -> Column:
    return F.avg(x)


def variance(x: Column) -> Column:
    """Sample variance; NaN of fewer than two values."""
    return F.coalesce(F.var_samp(x), nan())


def extreme(x: Column, largest: bool) -> Column:
    """Smallest or largest value; NaN if any value is missing."""
    return _if_any_missing(x, F.max(x) if largest else F.min(x))


def quantiles(x: Column, at: list[float]) -> Column:
    """Linear-interpolation quantiles, one sort for all; all NaN if any value is missing."""
    none = F.array(*[nan() for _ in at])
    return F.when(F.max(missing(x).cast("int")) == 1, none).otherwise(F.percentile(x, F.array(*[F.lit(q) for q in at])))


def median_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of absolute deviations from the median, for each key."""
    mid = df.groupBy(*by).agg(F.median(value).alias("__m"))
    return df.join(mid, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("mad"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, missing count, mean, sd, minimum, quartiles and maximum of the values that are there."""
    x = F.when(~missing(F.col(value)), F.col(value))
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(missing(F.col(value))).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"), q.alias("q")).select(*by, "n", "n_missing", "mean", "sd", "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "max")


def drop_missing(df: DataFrame, value: str) -> DataFrame:
    return df.where(~missing(F.col(value)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; NaN where a column is constant or has fewer than two values."""
    dx, dy = F.covar_pop(x, x), F.covar_pop(y, y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (F.count(x) < 2)
    r = F.covar_pop(x, y) / F.nullif(F.sqrt(dx) * F.sqrt(dy), F.lit(0.0))
    return F.when(flat, nan()).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _match(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """``rows`` with the other columns of ``table``, which has one row for each ``by``; nulls match nulls."""
    if not by:
        return rows.crossJoin(F.broadcast(table))
    keys = table.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(by)})
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    return rows.join(keys, on, "left").drop(*[f"__k{i}" for i in range(len(by))])


def _placed(values: DataFrame, by: list[str], x: str) -> DataFrame:
    """Of one row for each value ``x`` of a key, found ``__n`` times: ``__upto``, the key's rows up to that value, and ``__m``, all its rows.

    Values are dealt by range and written once, and a range adds the rows of the ranges
    before it to its own running sums, so that a key with many values is in many tasks.
    """
    dealt = settled(values.repartitionByRange(*[F.col(c) for c in [*by, x]]).withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*by, "__part").agg(F.sum("__n").alias("__s"))
    parts = parts.withColumn("__before", F.coalesce(F.sum("__s").over(before(by, ["__part"])), F.lit(0))).withColumn("__m", F.sum("__s").over(Window.partitionBy(*by))).drop("__s")
    return _match(dealt, [*by, "__part"], parts).withColumn("__upto", F.col("__before") + F.sum("__n").over(running([*by, "__part"], [x]))).drop("__before")


def _off_centre() -> Column:
    """Twice a value's average rank less twice the mean rank, a whole number."""
    return 2 * F.col("__upto") - F.col("__n") - F.col("__m")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson of average ranks, for each key. Ranks are found over different values, and rows meet those of ``x`` only."""
    at_x = settled(_placed(df.groupBy(*by, x).agg(F.count("*").alias("__n")), by, x).select(*by, x, "__n", _off_centre().alias("__dx")))
    sums_x = at_x.groupBy(*by).agg(F.sum(F.col("__n") * F.col("__dx").cast("double") * F.col("__dx")).alias("__xx"))
    rows = _match(df.select(*by, x, F.col(y).alias("__y")), [*by, x], at_x.drop("__n"))
    at_y = _placed(rows.groupBy(*by, "__y").agg(F.count("*").alias("__n"), F.sum("__dx").alias("__sx")), by, "__y").withColumn("__dy", _off_centre().cast("double"))
    sums = at_y.groupBy(*by).agg(F.sum("__n").alias("n"), F.sum(F.col("__sx") * F.col("__dy")).alias("__xy"), F.sum(F.col("__n") * F.col("__dy") * F.col("__dy")).alias("__yy"))
    r = F.col("__xy") / F.nullif(F.sqrt("__xx") * F.sqrt("__yy"), F.lit(0.0))
    rho = F.when((F.col("__xx") == 0) | (F.col("__yy") == 0), nan()).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return _match(sums, by, sums_x).select(*by, "n", rho.alias("rho"))


def correlate(df: DataFrame, by: list[str], x: str, y: str, least: int = 20) -> DataFrame:
    """Correlation with its two-sided p-value; null where fewer than ``least`` pairs."""
    pairs = df.where(~missing(F.col(x)) & ~missing(F.col(y)))
    got = pairs.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col(x), F.col(y)).alias("r")).withColumn("r", F.when(F.col("n") >= least, F.col("r")))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    p = F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(two_sided_p(t, (F.col("n") - 2).cast("double")))
    return got.withColumn("p", F.when(F.col("r").isNotNull(), p))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, alpha: float = 0.05) -> DataFrame:
    """q-value of each p-value within its family, and whether it is rejected at ``alpha``. Found over different p-values, which rows then meet."""
    alpha = alpha if 0 < alpha <= 1 else 0.05
    placed = _placed(df.groupBy(*by, p).agg(F.count("*").alias("__n")), by, p).withColumn("__q", F.col(p) * F.col("__m") / F.col("__upto"))
    later = Window.partitionBy(*by, "__part").orderBy(F.desc("__upto")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = settled(placed.withColumn("__q", F.min("__q").over(later)).select(*by, p, "__part", "__q"))
    after = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*by, "__part").agg(F.min("__q").alias("__least")).withColumn("__after", F.min("__least").over(after)).drop("__least")
    table = _match(placed, [*by, "__part"], parts).withColumn("q", F.least(F.lit(1.0), "__q", "__after")).select(*by, p, "q")
    return _match(df, [*by, p], table).withColumn("rejected", F.col("q") <= alpha)


def trend(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Least-squares line on the position, with t and two-sided p; an exact line has p = 0."""
    i = (F.row_number().over(window(by, order)) - 1).cast("double")
    s = df.withColumn("__i", i).groupBy(*by).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col("__i")).alias("slope"), F.regr_syy(F.col(value), F.col("__i")).alias("__yy"), F.regr_sxy(F.col(value), F.col("__i")).alias("__xy"))
    n = F.col("n").cast("double")
    sxx = n * (n * n - 1) / 12
    sse = F.col("__yy") - F.col("slope") * F.col("__xy")
    sse = F.when(sse <= 1e-12 * F.col("__yy"), 0.0).otherwise(sse)
    s = s.withColumn("se", F.when(F.col("n") >= 3, F.sqrt(sse / F.greatest(n - 2, F.lit(1.0)) / sxx)))
    t = F.when(F.col("se") > 0, F.col("slope") / F.nullif(F.col("se"), F.lit(0.0))).when((F.col("se") == 0) & (F.col("slope") != 0), F.signum("slope") * float("inf"))
    s = s.withColumn("t", t).withColumn("p", F.when(F.abs("t") == float("inf"), 0.0).otherwise(two_sided_p(F.col("t"), F.col("n").cast("double") - 2)))
    return s.drop("__yy", "__xy")


def standardise(df: DataFrame, fit_on: DataFrame, value: str, out: str = "z") -> DataFrame:
    """(x - mean) / sd with the parameters of ``fit_on``; a missing or zero sd counts as 1."""
    par = fit_on.agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s")).withColumn("__s", F.when((F.col("__s") > 0) & ~F.isnan("__s"), F.col("__s")).otherwise(1.0))
    return df.crossJoin(F.broadcast(par)).withColumn(out, (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")


def min_max(df: DataFrame, fit_on: DataFrame, value: str, out: str = "scaled") -> DataFrame:
    """Onto [0, 1] by the range of ``fit_on``, unclipped; a constant gives 0."""
    par = fit_on.agg(F.min(value).alias("__a"), F.max(value).alias("__b"))
    scaled = F.when(F.col("__a") == F.col("__b"), 0.0).otherwise((F.col(value) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(par)).withColumn(out, scaled).drop("__a", "__b")


def ordered_split(df: DataFrame, by: list[str], order: list[str], share: float) -> DataFrame:
    """``train`` for the first round(share * n) rows of each key, at least 1 and at most n - 1; else none."""
    n = F.count("*").over(Window.partitionBy(*by))
    cut = F.when(n < 2, 0).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.round(n * share))))
    return df.withColumn("train", F.row_number().over(window(by, order)) <= cut)


def rolling_folds(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Each row once for each of ``k`` expanding folds it is in, as ``train`` or ``test``."""
    n = F.count("*").over(Window.partitionBy(*by))
    rows = df.withColumn("__i", F.row_number().over(window(by, order)) - 1).withColumn("__n", n).withColumn("__w", F.floor(F.col("__n") / (k + 1)))
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).where("__w > 0")
    end = F.when(F.col("fold") == k, F.col("__n")).otherwise((F.col("fold") + 1) * F.col("__w"))
    role = F.when(F.col("__i") < F.col("fold") * F.col("__w"), "train").when(F.col("__i") < end, "test")
    return rows.withColumn("role", role).where("role is not null").drop("__i", "__n", "__w")


def forward_fill(df: DataFrame, by: list[str], order: list[str], value: str, out: str = "filled") -> DataFrame:
    """Missing values take the last one before, leading ones the first; all missing gives 0."""
    x = F.when(~missing(F.col(value)), F.col(value))
    first = F.first(x, ignorenulls=True).over(window(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.coalesce(F.last(x, ignorenulls=True).over(running(by, order)), first, F.lit(0.0)))


def difference(df: DataFrame, by: list[str], order: list[str], value: str, d: int = 1, lag: int = 1, out: str = "diff") -> DataFrame:
    """``d`` times the change over ``lag`` rows; rows without one are null."""
    df = df.withColumn(out, F.col(value))
    for _ in range(d):
        df = df.withColumn(out, F.col(out) - F.lag(out, lag).over(window(by, order)))
    return df


def forecast_errors(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """Mean absolute, root mean square and mean absolute percentage error; zero actuals are skipped and counted."""
    e = F.col(actual) - F.col(predicted)
    pct = F.when(F.col(actual) != 0, F.abs(e / F.nullif(F.col(actual), F.lit(0.0))) * 100)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(pct).alias("mape"), F.count_if(F.col(actual) == 0).alias("skipped"))


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """(by, lag, acf) for lags 0 to ``lags``; a constant series has 1, then 0."""
    w = window(by, order)
    rows = df.withColumn("__d", F.col(value) - F.avg(value).over(Window.partitionBy(*by)))
    sums = [F.sum(f"__p{k}").alias(f"__s{k}") for k in range(1, lags + 1)]
    for k in range(1, lags + 1):
        rows = rows.withColumn(f"__p{k}", F.col("__d") * F.lag("__d", k).over(w))
    c = rows.groupBy(*by).agg(F.sum(F.col("__d") * F.col("__d")).alias("__c0"), *sums)
    items = F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf")), *[F.struct(F.lit(k).alias("lag"), F.when(F.col("__c0") > 0, F.coalesce(F.col(f"__s{k}"), F.lit(0.0)) / F.nullif(F.col("__c0"), F.lit(0.0))).otherwise(0.0).alias("acf")) for k in range(1, lags + 1)])
    return c.select(*by, F.explode(items).alias("__x")).select(*by, "__x.lag", "__x.acf")


def ljung_box(df: DataFrame, by: list[str], order: list[str], value: str, lags: int) -> DataFrame:
    """Portmanteau Q over ``lags`` autocorrelations and its degrees of freedom."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    acf = autocorrelation(df, by, order, value, lags).where("lag > 0").join(n, by)
    return acf.groupBy(*by).agg((F.max(F.col("n") * (F.col("n") + 2)) * F.sum(F.col("acf") * F.col("acf") / (F.col("n") - F.col("lag")))).alias("q")).withColumn("df", F.lit(lags))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(n, mean, m2, skipped): a summary that :func:`merge_moments` adds up; non-finite values are counted."""
    x = F.when(finite(F.col(value)), F.col(value))
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.count_if(~finite(F.col(value))).alias("skipped"))


def merge_moments(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds up summaries of parts, of any number."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    m = parts.groupBy(*by).agg(n.alias("__n"), (total / F.nullif(n, F.lit(0))).alias("__mean"), F.sum("skipped").alias("__skipped"))
    rows = parts.join(m, by)
    return rows.groupBy(*by).agg(F.max("__n").alias("n"), F.max("__mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2.0))).alias("m2"), F.max("__skipped").alias("skipped"))
