"""Forecasts of every key in one job. Series are (key, ds, y) by month; forecasts (key, model, ds, yhat)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.arma import fit_orders
from tidemark.operators.networks import Recurrent, predicted, prepared
from tidemark.operators.networks import train as train_network
from tidemark.operators.profile import forecast_errors, mean_over_runs
from tidemark.operators.series import align_actual_forecast, as_arrays, best_per_group, lag_windows, last_n, series_by_config


def _dated(df: DataFrame, key: Sequence[str], model: str, values: str = "yhats") -> DataFrame:
    """One row a step from arrays of forecasts that follow last_ds."""
    rows = df.select(*key, "last_ds", F.posexplode(values).alias("h", "yhat"))
    return rows.select(*key, F.lit(model).alias("model"), F.add_months("last_ds", F.col("h") + 1).alias("ds"), "yhat")


def seasonal_naive(train: DataFrame, key: Sequence[str], h: int, period: int = 12) -> DataFrame:
    """The last ``period`` values, repeated."""
    last = as_arrays(last_n(train, key, period), key)
    values = F.transform(F.sequence(F.lit(0), F.lit(h - 1)), lambda i: F.element_at("ys", (i % F.size("ys") + 1).cast("int")))
    return _dated(last.withColumn("yhats", values), key, "seasonal_naive")


def grid(start: float, stop: float, n: int) -> list[float]:
    return [round(start + (stop - start) * i / (n - 1), 10) for i in range(n)]


def ses_fits(train: DataFrame, key: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """(key, alpha, level, sse, last_ds): simple smoothing of every series with every alpha, started at the first value."""
    configs = train.sparkSession.createDataFrame([(a,) for a in alphas], "alpha double")
    both = series_by_config(as_arrays(train, key), configs)
    run = F.expr(
        """aggregate(slice(ys, 2, size(ys)), struct(ys[0] as level, 0D as sse),
            (s, y) -> struct(s.level + alpha * (y - s.level) as level, s.sse + (y - s.level) * (y - s.level) as sse))"""
    )
    return both.withColumn("s", run).select(*key, "alpha", "s.level", "s.sse", "last_ds")


def ses(train: DataFrame, key: Sequence[str], h: int, alphas: Sequence[float] = tuple(grid(0.05, 1.0, 20))) -> DataFrame:
    best = best_per_group(ses_fits(train, key, alphas), key, ["sse", "alpha"])
    flat = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda i: F.greatest(F.lit(0.0), F.col("level")))
    return _dated(best.withColumn("yhats", flat), key, "ses")


#: Smoothing of level, trend and season, and damping, that are tried.
HOLT_WINTERS_GRID = [(a, b, g, p) for a in (0.1, 0.3, 0.6, 0.9) for b in (0.0, 0.05, 0.2) for g in (0.05, 0.2, 0.5) for p in (0.9, 0.98)]


def holt_winters(train: DataFrame, key: Sequence[str], h: int, configs: Sequence[tuple] = tuple(HOLT_WINTERS_GRID), period: int = 12) -> DataFrame:
    """Additive season and damped trend; series shorter than two periods have no forecast."""
    configs = train.sparkSession.createDataFrame(list(configs), "a double, b double, g double, phi double")
    arrays = as_arrays(train, key).where(f"n >= {2 * period}").withColumns({
        "m1": F.expr(f"aggregate(slice(ys, 1, {period}), 0D, (s, y) -> s + y) / {period}"), "m2": F.expr(f"aggregate(slice(ys, {period + 1}, {period}), 0D, (s, y) -> s + y) / {period}"),
    })
    start = f"struct(m1 as level, (m2 - m1) / {period} as trend, transform(slice(ys, 1, {period}), y -> y - m1) as season, 0D as sse)"
    # season[0] is that of the value at hand; it moves to the end once updated.
    step = f"""(s, y) -> element_at(transform(array(s.level + phi * s.trend), e -> element_at(transform(array(e + a * (y - s.season[0] - e)), l -> struct(
        l as level, phi * s.trend + b * (l - s.level - phi * s.trend) as trend,
        concat(slice(s.season, 2, {period - 1}), array(s.season[0] + g * (y - l - s.season[0]))) as season,
        s.sse + (y - e - s.season[0]) * (y - e - s.season[0]) as sse)), 1)), 1)"""
    fits = series_by_config(arrays, configs).withColumn("s", F.expr(f"aggregate(slice(ys, {period + 1}, size(ys)), {start}, {step})"))
    # After the loop season[0] is that of the first step ahead.
    best = best_per_group(fits.select(*key, "last_ds", "a", "b", "g", "phi", "s.*"), key, ["sse", "a", "b", "g", "phi"])
    ahead = f"transform(sequence(1, {h}), i -> greatest(0D, level + trend * phi * (1 - pow(phi, i)) / (1 - phi) + season[(i - 1) % {period}]))"
    return _dated(best.withColumn("yhats", F.expr(ahead)), key, "holt_winters")


def smoothing_sse(y: np.ndarray, configs: np.ndarray, period: int) -> np.ndarray:
    """Sums of squared one-step errors of Holt-Winters smoothing, as ``holt_winters`` runs it, for rows (a, b, g, phi) side by side; with period 0 of simple smoothing for rows (a,)."""
    if not period:
        level, sse = np.full(len(configs), y[0]), np.zeros(len(configs))
        for v in y[1:]:
            e = v - level
            level, sse = level + configs[:, 0] * e, sse + e * e
        return sse
    a, b, g, phi = configs.T
    level = np.full(len(a), y[:period].mean())
    trend, season, sse = np.full(len(a), (y[period : 2 * period].mean() - y[:period].mean()) / period), np.repeat((y[:period] - y[:period].mean())[:, None], len(a), 1), np.zeros(len(a))
    for i, v in enumerate(y[period:]):
        own, ahead = season[i % period].copy(), level + phi * trend
        e = v - ahead - own
        new = ahead + a * e
        trend, level = phi * trend + b * (new - level - phi * trend), new
        season[i % period], sse = own + g * (v - new - own), sse + e * e
    return sse


def smoothing_search(train: DataFrame, key: Sequence[str], configs: Sequence[tuple], low: Sequence[float], high: Sequence[float], period: int = 12, rounds: int = 40) -> DataFrame:
    """(key, params, sse, grid_sse): the smoothing parameters with the least error within bounds, by a pattern search from the best of ``configs``, so that no series does worse than its grid.

    A round tries a step up and down in every parameter, and goes to the best of them or halves the step. Series shorter than two periods, or of one value, are left out.
    """
    start, lower, upper = np.array(configs, float), np.array(low, float), np.array(high, float)

    @F.pandas_udf("struct<params:array<double>,sse:double,grid_sse:double>")
    def search(ys: pd.Series) -> pd.DataFrame:
        out = []
        for y in ys:
            y = np.asarray(y, float)
            costs = smoothing_sse(y, start, period)
            at, best = start[costs.argmin()], float(costs.min())
            grid_best, step = best, (upper - lower) / 8
            moves = np.concatenate([np.eye(len(at)), -np.eye(len(at))])
            for _ in range(rounds):
                tried = np.clip(at + moves * step, lower, upper)
                costs = smoothing_sse(y, tried, period)
                if costs.min() < best:
                    at, best = tried[costs.argmin()], float(costs.min())
                else:
                    step = step / 2
            out.append((at.tolist(), best, grid_best))
        return pd.DataFrame(out, columns=["params", "sse", "grid_sse"])

    arrays = as_arrays(train, key).where(F.col("n") >= max(2 * period, 2))
    return arrays.withColumn("f", search("ys")).select(*key, "f.*")


def ses_search(train: DataFrame, key: Sequence[str]) -> DataFrame:
    return smoothing_search(train, key, [(a,) for a in grid(0.05, 1.0, 20)], [0.0], [1.0], 0)


def holt_winters_search(train: DataFrame, key: Sequence[str], period: int = 12) -> DataFrame:
    return smoothing_search(train, key, HOLT_WINTERS_GRID, [0.001, 0.0, 0.0, 0.8], [0.999, 0.999, 0.999, 0.995], period)


def arma_grid(train: DataFrame, key: Sequence[str], orders: Sequence[tuple[int, int, int]], h: int = 1) -> DataFrame:
    """(key, p, d, q, loglik, aic, bic, p_value, yhats, last_ds): every series with every order (p, d, q) by exact Gaussian likelihood. yhats are of log1p data, back on the scale.

    Orders of one p and d are a row of the work, and are searched side by side. All fits of a series go by equally many values.
    """
    groups: dict[tuple[int, int], list[int]] = {}
    for p, d, q in orders:
        groups.setdefault((p, d), []).append(q)
    most = max(d for _, d, _ in orders)
    configs = train.sparkSession.createDataFrame([(p, d, sorted(qs)) for (p, d), qs in groups.items()], "p int, d int, qs array<int>")
    # By number, which adaptive execution leaves as it is: few bytes, but much work a row.
    tasks = 4 * train.sparkSession.sparkContext.defaultParallelism
    both = series_by_config(as_arrays(train, key), configs).repartition(tasks, *key, "p", "d")

    @F.pandas_udf("array<struct<q:int,loglik:double,aic:double,bic:double,p_value:double,yhats:array<double>>>")
    def fit(ys: pd.Series, ps: pd.Series, ds: pd.Series, qs: pd.Series) -> pd.Series:
        out = []
        for y, p, d, own in zip(ys, ps, ds, qs):
            fits = fit_orders(np.log1p(np.maximum(np.asarray(y, float), 0)), int(d), [(int(p), int(q)) for q in own], most, h)
            ahead = lambda f: np.maximum(np.expm1(np.minimum(f["ahead"], 700)), 0).tolist()
            out.append([(f["q"], f["loglik"], float(f["aic"]), float(f["bic"]), f["p_value"], ahead(f)) for f in fits])
        return pd.Series(out, dtype=object)

    rows = both.withColumn("f", F.explode(fit.asNondeterministic()("ys", "p", "d", "qs")))
    return rows.select(*key, "p", "d", "f.q", "f.loglik", "f.aic", "f.bic", "f.p_value", "f.yhats", "last_ds")


def select_arma(fits: DataFrame, key: Sequence[str], order: Sequence[str] = ("bic", "aic"), least_p: float = 0.05) -> DataFrame:
    """Of each series the best fit by ``order`` whose residuals pass, or else that with the least AIC."""
    fails = (F.col("p_value") <= least_p).cast("int")
    return best_per_group(fits, key, [fails, *[F.when(fails == 1, F.col("aic")).otherwise(F.col(c)) for c in order], "p", "d", "q"])


def trend_fourier(train: DataFrame, key: Sequence[str], h: int, harmonics: int = 3, knots: int = 5, ridge: float = 1.0) -> DataFrame:
    """A piecewise linear trend and yearly harmonics by ridge regression of log1p data."""

    def columns(t: np.ndarray, n: int) -> np.ndarray:
        s = t / max(n - 1, 1)
        hinges = [np.maximum(s - 0.8 * k / (knots + 1), 0) for k in range(1, knots + 1)]
        waves = [f(2 * np.pi * k * t / 12) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones(len(t)), s, *hinges, *waves])

    @F.pandas_udf("array<double>")
    def ahead(ys: pd.Series) -> pd.Series:
        out = []
        for y in ys:
            y = np.log1p(np.maximum(np.asarray(y, float), 0))
            x = columns(np.arange(len(y)), len(y))
            penalty = np.diag([0.0, 0.0] + [ridge] * (x.shape[1] - 2)) + 1e-9 * np.eye(x.shape[1])
            b = np.linalg.solve(x.T @ x + penalty, x.T @ y)
            out.append(np.maximum(np.expm1(np.minimum(columns(np.arange(len(y), len(y) + h), len(y)) @ b, 700)), 0).tolist())
        return pd.Series(out, dtype=object)

    return _dated(as_arrays(train, key).withColumn("yhats", ahead("ys")), key, "trend_fourier")


def sparse_fit(x: np.ndarray, y: np.ndarray, sparse: np.ndarray, penalty: float, start: np.ndarray | None = None, tolerance: float = 1e-10) -> np.ndarray:
    """The b that minimises |y - x b|^2 / 2 + penalty * sum |b_j| over the ``sparse`` columns, by coordinate descent on the normal equations."""
    g, c = x.T @ x, x.T @ y
    b = np.zeros(x.shape[1]) if start is None else start.copy()
    # All columns without a penalty are solved for at once.
    free, held = np.flatnonzero(~sparse), np.flatnonzero(sparse)
    inverse = np.linalg.pinv(g[np.ix_(free, free)])
    for _ in range(2000):
        before = b.copy()
        b[free] = inverse @ (c[free] - g[np.ix_(free, held)] @ b[held])
        for j in held:
            if g[j, j] > 0:
                slope = c[j] - g[j] @ b + g[j, j] * b[j]
                b[j] = np.sign(slope) * max(abs(slope) - penalty, 0) / g[j, j]
        if np.abs(b - before).max() <= tolerance * max(1.0, float(np.abs(b).max())):
            break
    return b


def trend_columns(t: np.ndarray, n: int, knots: int, harmonics: int, period: int = 12) -> np.ndarray:
    """A constant, a line, hinges that begin within the first 80 % of n steps, and harmonics of the period."""
    s = t / max(n - 1, 1)
    hinges = [np.maximum(s - 0.8 * k / (knots + 1), 0) for k in range(1, knots + 1)]
    waves = [f(2 * np.pi * k * t / period) for k in range(1, harmonics + 1) for f in (np.sin, np.cos)]
    return np.column_stack([np.ones(len(t)), s, *hinges, *waves])


def sparse_trend(y: np.ndarray, knots: int, harmonics: int) -> np.ndarray:
    """Coefficients of ``trend_columns`` with few hinges other than 0: the penalty, out of a falling row of them, whose columns, refitted without one, have the least BIC."""
    x = trend_columns(np.arange(len(y)), len(y), knots, harmonics)
    sparse = np.zeros(x.shape[1], bool)
    sparse[2 : 2 + knots] = True
    n, best, chosen, b = len(y), np.inf, None, None
    if not knots:
        return np.linalg.lstsq(x, y, rcond=None)[0]
    most = max(float(np.abs(x[:, sparse].T @ (y - x[:, ~sparse] @ np.linalg.lstsq(x[:, ~sparse], y, rcond=None)[0])).max()), 1e-12)
    for penalty in most * 0.7 ** np.arange(0, 24):
        b = sparse_fit(x, y, sparse, penalty, b)
        kept = ~sparse | (b != 0)
        refit = np.zeros(len(b))
        refit[kept] = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
        sse = max(float(((y - x @ refit) ** 2).sum()), 1e-300)
        score = n * np.log(sse / n) + (1 + 2 * np.count_nonzero(kept & sparse) + np.count_nonzero(~sparse)) * np.log(n)
        if score < best - 1e-9:
            best, chosen = score, refit
    return chosen


def changepoint_trend(train: DataFrame, key: Sequence[str], h: int, knots: int = 25, harmonics: int = 3) -> DataFrame:
    """A piecewise linear trend with few breaks, which a sparse prior finds, and yearly harmonics, of log1p data."""

    @F.pandas_udf("array<double>")
    def ahead(ys: pd.Series) -> pd.Series:
        out = []
        for y in ys:
            y = np.log1p(np.maximum(np.asarray(y, float), 0))
            n = len(y)
            few = min(knots, max(n // 4, 0)), min(harmonics, max((n - 2) // 4, 0))
            x = trend_columns(np.arange(n, n + h), n, *few)
            out.append(np.maximum(np.expm1(np.minimum(x @ sparse_trend(y, *few), 700)), 0).tolist())
        return pd.Series(out, dtype=object)

    return _dated(as_arrays(train, key).withColumn("yhats", ahead("ys")), key, "changepoint_trend")


def _scaled(train: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """log1p values over each key's training range, and the constants."""
    logs = train.withColumn("y", F.log1p("y"))
    constants = logs.groupBy(*key).agg(F.min("y").alias("low"), F.greatest(F.max("y") - F.min("y"), F.lit(1e-9)).alias("range"))
    return logs.join(constants, list(key)).withColumn("y", (F.col("y") - F.col("low")) / F.col("range")).select(*key, "ds", "y"), constants


def _fit(windows: DataFrame, steps: int, extra: Sequence[str] = (), ridge: float = 1e-3) -> list[tuple[list[float], float]]:
    """(coefficients, intercept) for every step of the target: linear models, over all series, from the window and the extra columns.

    All steps share one pass: each task sums products of columns, the sums over tasks are as many as products, and the driver solves for the
    coefficients with a ridge on columns of unit variance.
    """
    x = F.concat("x", F.array(*extra)) if extra else F.col("x")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in batches:
            if len(frame):
                z = np.column_stack([np.ones(len(frame)), np.stack(frame["x"].to_numpy()), np.stack(frame["target"].to_numpy())]).astype(float)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pd.DataFrame({"place": np.arange(total.size), "value": total.ravel()})

    parts = windows.select(x.alias("x"), F.slice("target", 1, steps).alias("target")).mapInPandas(sums, "place int, value double")
    rows = parts.groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    if not rows:
        raise ValueError("no series is long enough for a window")
    products = np.array([r["value"] for r in rows]).reshape(int(round(len(rows) ** 0.5)), -1)
    products, n = products / products[0, 0], len(products) - steps
    means, spread = products[0], products - np.outer(products[0], products[0])
    left = spread[1:n, 1:n] + np.diag(ridge * np.maximum(np.diag(spread)[1:n], 1e-9))
    weights = np.linalg.solve(left, spread[1:n, n:])
    return [(weights[:, i].tolist(), float(means[n + i] - weights[:, i] @ means[1:n])) for i in range(steps)]


def _last_windows(scaled: DataFrame, key: Sequence[str], lookback: int) -> DataFrame:
    return as_arrays(last_n(scaled, key, lookback), key).where(F.size("ys") == lookback).withColumnRenamed("ys", "x")


def _linear(coefficients, intercept: float, x: str = "x") -> str:
    weights = ", ".join(f"{float(c)!r}D" for c in coefficients)
    return f"aggregate(zip_with({x}, array({weights}), (a, w) -> a * w), {float(intercept)!r}D, (s, v) -> s + v)"


def _unscaled(df: DataFrame, constants: DataFrame, key: Sequence[str], model: str) -> DataFrame:
    rows = df.join(constants, list(key))
    return _dated(rows.withColumn("yhats", F.expr("transform(yhats, v -> greatest(0D, expm1(least(v * range + low, 700D))))")), key, model)


def window_regressor_direct(train: DataFrame, key: Sequence[str], h: int, lookback: int = 12) -> DataFrame:
    """A linear model for every step ahead, all fitted in one pass over all series."""
    scaled, constants = _scaled(train, key)
    models = _fit(lag_windows(scaled, key, lookback, h), h)
    last = _last_windows(scaled, key, lookback)
    values = F.array(*[F.expr(_linear(*m)) for m in models])
    return _unscaled(last.withColumn("yhats", values), constants, key, "window_direct")


def window_regressor_recursive(train: DataFrame, key: Sequence[str], h: int, lookback: int = 12) -> DataFrame:
    """One one-step linear model, fed with its own forecasts."""
    scaled, constants = _scaled(train, key)
    step = _linear(*_fit(lag_windows(scaled, key, lookback, 1), 1)[0], f"slice(w, -{lookback}, {lookback})")
    run = f"slice(aggregate(sequence(1, {h}), x, (w, i) -> concat(w, array({step}))), -{h}, {h})"
    return _unscaled(_last_windows(scaled, key, lookback).withColumn("yhats", F.expr(run)), constants, key, "window_recursive")


def window_regressor_with_features(train: DataFrame, features: DataFrame, columns: Sequence[str], key: Sequence[str], h: int, lookback: int = 12) -> DataFrame:
    """As direct, with the series' features (one row a key) beside the lags."""
    scaled, constants = _scaled(train, key)
    features = features.select(*key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
    models = _fit(lag_windows(scaled, key, lookback, h).join(features, list(key)), h, columns)
    last = _last_windows(scaled, key, lookback).join(features, list(key)).withColumn("x", F.concat("x", F.array(*columns)))
    values = F.array(*[F.expr(_linear(*m)) for m in models])
    return _unscaled(last.withColumn("yhats", values), constants, key, "window_features")


def _recurrent(train: DataFrame, key: Sequence[str], outputs: int, lookback: int, hidden: int, seed: int, features: DataFrame | None = None, columns: Sequence[str] = (), **how) -> tuple:
    """(network, parameters, last windows with x, constants): a recurrent network for windows of all series, begun at the linear model; the last 15 % of every series' windows validate."""
    scaled, constants = _scaled(train, key)
    windows, last = lag_windows(scaled, key, lookback, outputs), _last_windows(scaled, key, lookback)
    if features is not None:
        features = features.select(*key, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
        windows, last = windows.join(features, list(key)), last.join(features, list(key)).withColumn("x", F.concat("x", F.array(*columns)))
    k, n = F.row_number().over(W.partitionBy(*key).orderBy("ds")), F.count(F.lit(1)).over(W.partitionBy(*key))
    windows = windows.withColumn("valid", k > F.floor(n * F.lit(0.85)))
    linear = _fit(windows.where("not valid"), outputs, columns)
    rows = windows.withColumn("x", F.concat("x", F.array(*columns))) if columns else windows
    network = Recurrent(lookback, hidden, outputs, len(columns))
    flat, _ = train_network(prepared(rows, [*key, "ds"], "x", "target", "valid"), network, network.start(seed, linear), seed=seed, **how)
    return network, flat, last, constants


def recurrent_direct(train: DataFrame, key: Sequence[str], h: int, lookback: int = 12, hidden: int = 12, seed: int = 7, **how) -> DataFrame:
    """A recurrent network with an output for every step ahead, one for all series. Series without a full window have no forecast."""
    network, flat, last, constants = _recurrent(train, key, h, lookback, hidden, seed, **how)
    return _unscaled(predicted(last, network, flat), constants, key, "recurrent_direct")


def recurrent_recursive(train: DataFrame, key: Sequence[str], h: int, lookback: int = 12, hidden: int = 12, seed: int = 7, **how) -> DataFrame:
    """A one-step recurrent network, fed with its own forecasts."""
    network, flat, last, constants = _recurrent(train, key, 1, lookback, hidden, seed, **how)

    @F.pandas_udf("array<double>")
    def ahead(windows: pd.Series) -> pd.Series:
        if not len(windows):
            return pd.Series([], dtype=object)
        x = np.stack(windows.to_numpy()).astype(float)
        for _ in range(h):
            # A scaled forecast far outside of what was seen would feed on itself.
            x = np.column_stack([x, np.clip(network.predict(flat, x[:, -lookback:]), -2, 3)])
        return pd.Series(list(x[:, lookback:]), dtype=object)

    return _unscaled(last.withColumn("yhats", ahead(F.col("x").cast("array<double>"))), constants, key, "recurrent_recursive")


def recurrent_with_features(train: DataFrame, features: DataFrame, columns: Sequence[str], key: Sequence[str], h: int, lookback: int = 12, hidden: int = 12, seed: int = 7, **how) -> DataFrame:
    """As recurrent_direct, with the series' features (one row a key) beside the window."""
    network, flat, last, constants = _recurrent(train, key, h, lookback, hidden, seed, features, columns, **how)
    return _unscaled(predicted(last, network, flat), constants, key, "recurrent_features")


def tune_on_validation(series: DataFrame, key: Sequence[str], lookbacks: Sequence[int], months: int = 24, fit=window_regressor_direct) -> DataFrame:
    """(key, lookback, rmse, chosen): models of ``fit``, linear or recurrent ones, fitted before the last ``months`` and scored on them; the least mean RMSE over keys is chosen."""
    last = F.max("ds").over(W.partitionBy(*key))
    marked = series.withColumn("__cut", F.add_months(last, -months))
    train, valid = marked.where("ds <= __cut").drop("__cut"), marked.where("ds > __cut").drop("__cut")
    parts = []
    for lookback in lookbacks:
        forecast = fit(train, key, months, lookback)
        parts.append(forecast_errors(align_actual_forecast(valid, forecast, key), key).select(*key, F.lit(lookback).alias("lookback"), "rmse"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = mean_over_runs(rows, ["lookback"], "rmse").orderBy("mean", "lookback").limit(1).select("lookback").withColumn("chosen", F.lit(True))
    return rows.join(F.broadcast(best), "lookback", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def compare_models(test: DataFrame, forecasts: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, model, mae, rmse, nrmse, best): errors of every model on the held-out months; the best has the least RMSE, then MAE."""
    errors = forecast_errors(align_actual_forecast(test, forecasts, key), [*key, "model"])
    k = F.row_number().over(W.partitionBy(*key).orderBy("rmse", "mae", "model"))
    return errors.withColumn("best", k == 1)
