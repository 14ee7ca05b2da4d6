"""Models of each series: one group, one numpy fit, any number of series in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arimax, seasonal


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def decompose(df: DataFrame, by: list[str], order: list[str], value: str, period: int = 0, harmonics: int = 3, breaks: int = 3) -> DataFrame:
    """trend, seasonal, residual, period and ``new_line`` for each row; series too short or without values give none."""
    keep = [*by, *order, value]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        x = pdf[value].to_numpy(float, na_value=np.nan)
        if len(x) < 4 or np.isnan(x).all():
            return pdf.iloc[:0].assign(trend=0.0, seasonal=0.0, residual=0.0, period=0, new_line=False)
        d = seasonal.decompose(x, period, harmonics, breaks)
        return pdf.assign(trend=d.trend, seasonal=d.seasonal, residual=d.residual, period=d.period, new_line=np.isin(np.arange(len(x)), d.breaks))

    return df.select(*keep).groupBy(*by).applyInPandas(run, _kinds(df, keep) + ", trend double, seasonal double, residual double, period int, new_line boolean")


def seasonal_forecast(df: DataFrame, by: list[str], order: list[str], value: str, h: int, period: int = 0) -> DataFrame:
    """(by, step, forecast) for ``h`` steps after the end of each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")[value].to_numpy(float, na_value=np.nan)
        if len(x) < 4 or np.isnan(x).all():
            return pd.DataFrame({**{b: [] for b in by}, "step": [], "forecast": []})
        out = seasonal.decompose(x, period).forecast(h)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] * h for b in by}, "step": np.arange(1, h + 1), "forecast": out})

    return df.select(*by, *order, value).groupBy(*by).applyInPandas(run, _kinds(df, by) + ", step long, forecast double")


def periods(df: DataFrame, by: list[str], order: list[str], value: str, longest: int = 0) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order, kind="stable")[value].to_numpy(float, na_value=np.nan)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "period": [seasonal.period_of(x, longest)]})

    return df.select(*by, *order, value).groupBy(*by).applyInPandas(run, _kinds(df, by) + ", period int")


def arimax_forecast(history: DataFrame, future: DataFrame, by: list[str], order: list[str], value: str, regressors: list[str], pdq: tuple[int, int, int], alpha: float = 0.05) -> DataFrame:
    """Fit on each key's history and forecast the rows of ``future``: forecast, lower, upper."""

    def run(past: pd.DataFrame, ahead: pd.DataFrame) -> pd.DataFrame:
        past, ahead = past.sort_values(order, kind="stable"), ahead.sort_values(order, kind="stable")
        try:
            model = arimax.fit(past[value].to_numpy(float), past[regressors].to_numpy(float) if regressors else None, pdq)
        except ValueError:
            return ahead.iloc[:0].assign(forecast=0.0, lower=0.0, upper=0.0)
        mean, low, high = model.forecast(len(ahead), ahead[regressors].to_numpy(float) if regressors else None, alpha)
        return ahead.assign(forecast=mean, lower=low, upper=high)

    keep = [*by, *order, *regressors]
    # Aliases keep the two sides apart where both come from one table.
    left = history.select(*[F.col(c).alias(c) for c in (*keep, value)]).groupBy(*by)
    return left.cogroup(future.select(*[F.col(c).alias(c) for c in keep]).groupBy(*by)).applyInPandas(run, _kinds(future, keep) + ", forecast double, lower double, upper double")


def partial_autocorrelation(acf: DataFrame, by: list[str]) -> DataFrame:
    """(by, lag, pacf) from a table of (by, lag, acf)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        return pdf[[*by, "lag"]].assign(pacf=arimax.partial_autocorrelation(pdf["acf"].to_numpy(float)))

    return acf.select(*by, "lag", "acf").groupBy(*by).applyInPandas(run, _kinds(acf, [*by, "lag"]) + ", pacf double")


def fourier_season(df: DataFrame, phase_of, by: list[str], value: str, period: int, harmonics: int) -> DataFrame:
    """Mean and coefficients of each key's season; only one sum a phase leaves the JVM."""
    sums = df.withColumn("phase", F.pmod(phase_of, F.lit(period)).cast("int")).groupBy(*by, "phase").agg(F.sum(value).alias("total"), F.count(value).alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = min(harmonics, period // 2)
        t = pdf["phase"].to_numpy()
        turn = 2 * np.pi * np.outer(t, np.arange(1, h + 1)) / period
        sines = np.sin(turn)[:, : h - 1] if 2 * h == period else np.sin(turn)
        x = np.column_stack([np.ones(len(t)), np.cos(turn), sines])
        n, s = pdf["n"].to_numpy(float), pdf["total"].to_numpy(float)
        coef = np.linalg.lstsq((x * n[:, None]).T @ x, x.T @ s, rcond=None)[0]
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "mean": [coef[0]], "cos": [coef[1 : 1 + h].tolist()], "sin": [coef[1 + h :].tolist()]})

    return sums.groupBy(*by).applyInPandas(run, _kinds(df, by) + ", mean double, cos array<double>, sin array<double>")
