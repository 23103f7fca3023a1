"""Diagnostics of keyed series: autocorrelation, unit roots, decomposition."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.series import as_arrays, ordered, rolling


def acf(df: DataFrame, key: Sequence[str], nlags: int, y: str = "y") -> DataFrame:
    """(key, lag, r, n, limit): biased autocorrelation and 1.96 / sqrt(n); null for a constant series."""
    w = ordered(key)
    d = df.withColumn("__d", F.col(y) - F.avg(y).over(W.partitionBy(*key)))
    d = d.withColumns({f"__p{k}": F.col("__d") * F.lag("__d", k).over(w) for k in range(1, nlags + 1)})
    sums = d.groupBy(*key).agg(F.count(y).alias("n"), F.sum(F.col("__d") * F.col("__d")).alias("__v"), *[F.coalesce(F.sum(f"__p{k}"), F.lit(0.0)).alias(f"__p{k}") for k in range(1, nlags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), F.expr(f"try_divide(__p{k}, __v)").alias("r")) for k in range(1, nlags + 1)])
    return sums.select(*key, "n", F.explode(rows).alias("x")).select(*key, "x.lag", "x.r", "n", (1.96 / F.sqrt("n")).alias("limit"))


def _acf_arrays(df: DataFrame, key: Sequence[str], nlags: int) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("lag", "r")))
    return acf(df, key, nlags).groupBy(*key).agg(F.transform(rows, lambda x: x["r"]).alias("r"), F.first("n").alias("n"))


def durbin_levinson(r: Sequence[float]) -> list[float]:
    """Partial autocorrelations from autocorrelations at lags 1, 2, ..."""
    phi, out, v = np.zeros(0), [], 1.0
    for k in range(len(r)):
        if v <= 1e-12:
            out.append(float("nan"))
            continue
        last = (r[k] - phi @ np.array(r[:k])[::-1]) / v if k else r[0]
        phi = np.append(phi - last * phi[::-1], last)
        v *= 1 - last * last
        out.append(float(last))
    return out


def pacf(df: DataFrame, key: Sequence[str], nlags: int) -> DataFrame:
    """(key, lag, pacf) by Yule-Walker with biased autocorrelations."""

    @F.pandas_udf("array<double>")
    def solve(r: pd.Series) -> pd.Series:
        return pd.Series([durbin_levinson([float("nan") if v is None else v for v in x]) for x in r], dtype=object)

    return _acf_arrays(df, key, nlags).select(*key, F.posexplode(solve("r")).alias("k", "pacf")).select(*key, (F.col("k") + 1).alias("lag"), "pacf")


#: 5 % critical value of the unit-root test with a constant, by MacKinnon's response surface (2010).
ADF_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.04)
#: MacKinnon's (1994) approximation of the p-value for the same case. The normal quantile of p is a polynomial of the statistic, one up to ADF_BEND and
#: one beyond; below ADF_RANGE p is 0, above it 1.
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_BEND, ADF_RANGE = -1.61, (-18.83, 2.74)


def adf_p_value(statistic: float) -> float:
    """The p-value of a unit-root statistic with a constant, for a long series."""
    if not ADF_RANGE[0] <= statistic <= ADF_RANGE[1]:
        return float("nan") if statistic != statistic else float(statistic > 0)
    surface = ADF_SMALL_P if statistic <= ADF_BEND else ADF_LARGE_P
    return 0.5 * math.erfc(-sum(c * statistic**i for i, c in enumerate(surface)) / math.sqrt(2))


def adf_statistic(y: np.ndarray) -> tuple[float, int, int]:
    """(t statistic, lags by AIC, observations) of the augmented Dickey-Fuller regression with a constant; NaN for a constant or too short series."""
    y = np.asarray(y, float)
    most = min(int(np.ceil(12 * (len(y) / 100) ** 0.25)), len(y) // 2 - 2)
    if most < 0 or len(y) < 6 or np.ptp(y) == 0:
        return float("nan"), 0, 0
    dy = np.diff(y)

    def fit(lags: int, start: int) -> tuple[float, float, int]:
        target = dy[start:]
        x = np.column_stack([y[start:-1], *[dy[start - k : len(dy) - k] for k in range(1, lags + 1)], np.ones(len(target))])
        b, _, rank, _ = np.linalg.lstsq(x, target, rcond=None)
        sse, n = float(((target - x @ b) ** 2).sum()), len(target)
        if rank < x.shape[1] or n <= x.shape[1]:
            return float("nan"), float("inf"), n
        error = np.sqrt(sse / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
        return (b[0] / error if error > 0 else float("-inf")), n * np.log(max(sse, 1e-300) / n) + 2 * x.shape[1], n

    lags = min(range(most + 1), key=lambda k: fit(k, most)[1])
    t, _, n = fit(lags, lags)
    return float(t), lags, n


def adf_table(df: DataFrame, key: Sequence[str], max_d: int = 2) -> DataFrame:
    """(key, d, statistic, lags, n_obs, critical, p_value, stationary) for each difference, and chosen: the least d that is stationary, with a p-value below 0.05.

    The critical value is that of as many observations, at 5 %.
    """

    @F.pandas_udf("array<struct<d:int,statistic:double,lags:int,n_obs:int,critical:double,p_value:double,stationary:boolean>>")
    def test(ys: pd.Series) -> pd.Series:
        out = []
        for y in ys:
            rows, y = [], np.array([np.nan if v is None else v for v in y], float)
            for d in range(max_d + 1):
                t, lags, n = adf_statistic(np.diff(y, d) if d else y)
                critical = float(sum(c / max(n, 1) ** i for i, c in enumerate(ADF_5_PERCENT)))
                p = adf_p_value(t)
                rows.append((d, t, lags, n, critical, p, bool(p < 0.05)))
            out.append(rows)
        return pd.Series(out, dtype=object)

    rows = as_arrays(df, key).select(*key, F.explode(test("ys")).alias("x")).select(*key, "x.*")
    chosen = F.min(F.when(F.col("stationary"), F.col("d"))).over(W.partitionBy(*key))
    return rows.withColumn("chosen", F.coalesce(F.col("d") == chosen, F.lit(False)))


def ljung_box(df: DataFrame, key: Sequence[str], lags: int = 12, y: str = "y") -> DataFrame:
    """(key, q, p): the chi-square tail has a closed form for the even number of ``lags``."""
    term = F.col("r") * F.col("r") / (F.col("n") - F.col("lag"))
    q = acf(df, key, lags, y).groupBy(*key).agg((F.first("n") * (F.first("n") + 2) * F.sum(term)).alias("q"))
    half = F.col("q") / 2
    tail = reduce(lambda a, i: a + F.pow(half, F.lit(float(i))) / float(np.prod(range(1, i + 1))), range(1, lags // 2), F.lit(1.0))
    return q.withColumn("p", F.exp(-half) * tail)


def decompose_additive(df: DataFrame, key: Sequence[str], period: int = 12, y: str = "y") -> DataFrame:
    """Columns trend, seasonal and residual: a centred moving average, and the centred mean of what is left by month."""
    w, half = ordered(key), period // 2
    inner, outer = w.rowsBetween(-(half - 1), half - 1), w.rowsBetween(-half, half)
    total = F.sum(y).over(inner) + (F.lag(y, half).over(w) + F.lead(y, half).over(w)) / 2
    trend = F.when(F.count(y).over(outer) == period + 1, total / period)
    out = df.withColumn("trend", trend).withColumn("__m", F.month("ds") if period == 12 else (F.row_number().over(w) - 1) % period)
    by_month = W.partitionBy(*key, "__m")
    out = out.withColumn("__s", F.avg(F.col(y) - F.col("trend")).over(by_month))
    months = out.select(*key, "__m", "__s").distinct().groupBy(*key).agg(F.avg("__s").alias("__c"))
    out = out.join(months, list(key)) if key else out.crossJoin(F.broadcast(months))
    return out.withColumn("seasonal", F.col("__s") - F.col("__c")).withColumn("residual", F.col(y) - F.col("trend") - F.col("seasonal")).drop("__m", "__s", "__c")


def seasonal_strength(df: DataFrame, key: Sequence[str], period: int = 12) -> DataFrame:
    """max(0, 1 - Var(residual) / Var(seasonal + residual)) over rows with a trend."""
    parts = decompose_additive(df, key, period).where("residual is not null")
    return parts.groupBy(*key).agg(F.expr("greatest(0D, 1 - try_divide(var_pop(residual), var_pop(seasonal + residual)))").alias("strength"))


def loess(y: np.ndarray, at: np.ndarray, width: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines through y at 0, 1, 2, ..., evaluated at the places ``at``: the ``width`` nearest values count by the tricube of their distance, and by ``weights``.

    With a width beyond the series the neighbourhood grows by half of what is missing.
    """
    n = len(y)
    q = min(width, n)
    left = np.clip(np.floor(at - (q - 1) / 2 + 1e-9).astype(int), 0, n - q)
    index = left[:, None] + np.arange(q)
    apart = np.abs(index - at[:, None])
    reach = apart.max(1) + max(width - n, 0) / 2
    w = np.clip(1 - (apart / np.maximum(reach, 1e-300)[:, None]) ** 3, 0, None) ** 3
    w = np.where(apart <= 0.001 * reach[:, None], 1.0, np.where(apart >= 0.999 * reach[:, None], 0.0, w))
    if weights is not None:
        w = w * weights[index]
    total = w.sum(1)
    w = w / np.where(total > 0, total, 1)[:, None]
    mean = (w * index).sum(1)
    off = index - mean[:, None]
    spread = (w * off * off).sum(1)
    own = y[index]
    level = (w * own).sum(1)
    line = np.where(np.sqrt(spread) > 0.001 * max(n - 1, 1), (w * off * own).sum(1) / np.where(spread > 0, spread, 1) * (at - mean), 0.0)
    # Where no value counts, the one at hand stands for itself.
    return np.where(total > 0, level + line, y[np.clip(np.rint(at).astype(int), 0, n - 1)])


def _odd(x: float) -> int:
    n = math.ceil(x)
    return n + 1 - n % 2


def stl_parts(y: np.ndarray, period: int = 12, seasonal: int = 7, robust: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(trend, seasonal part) of a series by local regression (Cleveland et al. 1990).

    An inner loop smooths each month of the detrended series by itself, takes a low-pass of that away and smooths what is left as the trend. Robust outer loops weigh values down
    by the bisquare of their residual over six median residuals.
    """
    n, trend, weights = len(y), np.zeros(len(y)), None
    places, low_width, trend_width = np.arange(n, dtype=float), _odd(period + 1 if period % 2 == 0 else period), _odd(1.5 * period / (1 - 1.5 / seasonal))
    average = lambda x, k: np.convolve(x, np.full(k, 1 / k), mode="valid")
    found = np.zeros(n)
    for outer in range(16 if robust else 1):
        for _ in range(2 if robust else 5):
            cycles = np.zeros(n + 2 * period)
            for m in range(period):
                own = (y - trend)[m::period]
                cycles[m::period] = loess(own, np.arange(-1.0, len(own) + 1), seasonal, None if weights is None else weights[m::period])[: len(cycles[m::period])]
            low = loess(average(average(average(cycles, period), period), 3), places, low_width)
            found = cycles[period : period + n] - low
            trend = loess(y - found, places, trend_width, weights)
        if robust:
            apart = np.abs(y - found - trend)
            six = 6 * float(np.median(apart))
            u = apart / six if six > 0 else np.zeros(n)
            weights = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - np.minimum(u, 1) ** 2) ** 2))
    return trend, found


def decompose_stl(df: DataFrame, key: Sequence[str], period: int = 12, y: str = "y", robust: bool = True, seasonal: int = 7) -> DataFrame:
    """(key, ds, y, trend, seasonal, residual), which add up: every series by local regression. The parts are null for series with gaps in y or shorter than two periods."""

    @F.pandas_udf("array<struct<trend:double,seasonal:double,residual:double>>")
    def parts(ys: pd.Series) -> pd.Series:
        out = []
        for x in ys:
            x = np.array([np.nan if v is None else v for v in x], float)
            if len(x) < 2 * period or not np.isfinite(x).all():
                out.append([(None, None, None)] * len(x))
                continue
            trend, own = stl_parts(x, period, seasonal, robust)
            out.append(list(zip(trend.tolist(), own.tolist(), (x - trend - own).tolist())))
        return pd.Series(out, dtype=object)

    pairs = F.array_sort(F.collect_list(F.struct(F.col("ds").alias("ds"), F.col(y).alias("y"))))
    arrays = df.groupBy(*key).agg(pairs.alias("p")).withColumn("x", parts.asNondeterministic()(F.transform("p", lambda p: p["y"].cast("double"))))
    rows = arrays.select(*key, F.explode(F.arrays_zip("p", "x")).alias("r"))
    return rows.select(*key, "r.p.ds", F.col("r.p.y").alias(y), "r.x.trend", "r.x.seasonal", "r.x.residual")


def stl_strength(df: DataFrame, key: Sequence[str], period: int = 12) -> DataFrame:
    """As seasonal_strength, of the robust decomposition of log1p data."""
    parts = decompose_stl(df.withColumn("y", F.log1p("y")), key, period).where("residual is not null")
    return parts.groupBy(*key).agg(F.expr("greatest(0D, 1 - try_divide(var_pop(residual), var_pop(seasonal + residual)))").alias("strength"))


def needs_transform(df: DataFrame, key: Sequence[str], n: int = 12, least: float = 0.5) -> DataFrame:
    """(key, r, transform): whether rolling means and variances go together."""
    both = rolling(rolling(df, key, n, "avg", name="__m"), key, n, "variance", name="__v")
    return both.groupBy(*key).agg(F.corr("__m", "__v").alias("r")).withColumn("transform", F.coalesce(F.col("r") > least, F.lit(False)))
