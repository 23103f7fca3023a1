"""Keyed series (key columns, ds, y): calendars, windows, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def total_by(df: DataFrame, dims: Sequence[str], measure: str, name: str = "y") -> DataFrame:
    """Sum by group; rows with a null group are left out, and a sum of nulls is 0."""
    for d in dims:
        df = df.where(F.col(d).isNotNull())
    return df.groupBy(*dims).agg(F.coalesce(F.sum(measure), F.lit(0.0)).alias(name))


def fill_calendar(df: DataFrame, key: Sequence[str], step: str = "1 month", y: str = "y", ds: str = "ds") -> DataFrame:
    """Every key gets every step between the first and last of the table; gaps are 0. The calendar, a row a step, is broadcast."""
    bounds = df.agg(F.min(ds).alias("lo"), F.max(ds).alias("hi"))
    calendar = bounds.where("lo is not null").select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(ds))
    grid = df.select(*key).distinct().crossJoin(F.broadcast(calendar))
    return grid.join(df.select(*key, ds, y), [*key, ds], "left").withColumn(y, F.coalesce(y, F.lit(0.0)))


def monthly_series(df: DataFrame, key: Sequence[str], measure: str, fill: bool = True) -> DataFrame:
    out = total_by(df, [*key, "ds"], measure)
    return fill_calendar(out, key) if fill else out


def ordered(key: Sequence[str], ds: str = "ds"):
    return W.partitionBy(*key).orderBy(ds)


def rolling(df: DataFrame, key: Sequence[str], n: int, how: str = "avg", y: str = "y", name: str | None = None) -> DataFrame:
    """Mean ("avg"), sample variance or deviation of the last n rows; null before the n-th."""
    w = ordered(key).rowsBetween(-(n - 1), 0)
    value = {"avg": F.avg, "variance": F.variance, "stddev": F.stddev, "sum": F.sum, "min": F.min, "max": F.max}[how](y)
    return df.withColumn(name or f"rolling_{how}", F.when(F.count(y).over(w) == n, value.over(w)))


def difference(df: DataFrame, key: Sequence[str], d: int = 1, y: str = "y", name: str = "diff") -> DataFrame:
    """The d-th difference; null where it reaches before the start."""
    df = df.withColumn(name, F.col(y))
    for _ in range(d):
        df = df.withColumn(name, F.col(name) - F.lag(name).over(ordered(key)))
    return df


def lag_windows(df: DataFrame, key: Sequence[str], lookback: int, horizon: int, y: str = "y") -> DataFrame:
    """Rows with full windows: x, the lookback values before ds, and target, the horizon values from ds on."""
    w = ordered(key)
    x = F.collect_list(y).over(w.rowsBetween(-lookback, -1))
    target = F.collect_list(y).over(w.rowsBetween(0, horizon - 1))
    return df.withColumns({"x": x, "target": target}).where((F.size("x") == lookback) & (F.size("target") == horizon))


def split_temporal(df: DataFrame, key: Sequence[str], fractions: Sequence[tuple[str, float]] = (("train", 0.7), ("test", 0.3)), ds: str = "ds") -> DataFrame:
    """Column split by time within each key: floor(n * share) rows for each name in turn, as double arithmetic has it; the last gets the rest."""
    k, n = F.row_number().over(ordered(key, ds)), F.count(F.lit(1)).over(W.partitionBy(*key))
    out, upto = None, F.lit(0)
    for name, share in fractions[:-1]:
        upto = upto + F.floor(n * F.lit(float(share)))
        out = F.when(k <= upto, name) if out is None else out.when(k <= upto, name)
    return df.withColumn("split", F.lit(fractions[-1][0]) if out is None else out.otherwise(fractions[-1][0]))


def last_n(df: DataFrame, key: Sequence[str], n: int, ds: str = "ds") -> DataFrame:
    k = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(ds)))
    return df.withColumn("__k", k).where(F.col("__k") <= n).drop("__k")


def split_last(df: DataFrame, key: Sequence[str], n: int, ds: str = "ds") -> DataFrame:
    """The last n rows of each key are "test", the others "train"."""
    k = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(ds)))
    return df.withColumn("split", F.when(k <= n, "test").otherwise("train"))


def best_per_group(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__k = 1").drop("__k")


def cumulative_share(df: DataFrame, column: str, tie: str, name: str = "cumulative") -> DataFrame:
    """Percent of the total up to each row, largest first, of an aggregated table."""
    w = W.orderBy(F.desc(column), tie)
    return df.withColumn(name, 100 * F.sum(column).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(column).over(W.partitionBy()))


def rolling_features(df: DataFrame, key: Sequence[str], n: int = 24, y: str = "y") -> DataFrame:
    """Features of the n rows before each row, never of the row itself; null without n rows."""
    w = ordered(key).rowsBetween(-n, -1)
    full = lambda c: F.when(F.count(y).over(w) == n, c.over(w))
    return df.withColumns({
        "f_mean": full(F.avg(y)), "f_std": full(F.stddev(y)), "f_min": full(F.min(y)), "f_max": full(F.max(y)),
        "f_last": F.when(F.count(y).over(w) == n, F.lag(y).over(ordered(key))),
        "f_slope": F.when(F.count(y).over(w) == n, F.regr_slope(F.col(y), F.col("t")).over(w)) if "t" in df.columns else F.lit(None).cast("double"),
    })


def with_index(df: DataFrame, key: Sequence[str], ds: str = "ds") -> DataFrame:
    """Column t: the row's number in its series, from 0."""
    return df.withColumn("t", (F.row_number().over(ordered(key, ds)) - 1).cast("double"))


def top_k(df: DataFrame, measure: str, tie: Sequence[str], k: int) -> DataFrame:
    return df.orderBy(F.desc(measure), *tie).limit(k)


def extremes(df: DataFrame, column: str, tie: Sequence[str], k: int) -> DataFrame:
    """The k least and the k greatest rows, with column side."""
    low = df.orderBy(F.asc(column), *tie).limit(k).withColumn("side", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(column), *tie).limit(k).withColumn("side", F.lit("high")))


def sort_by_order(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows in the order in which ``order`` lists the column's values, others last."""
    place = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(order)], f"`{column}` string, __place int")
    return df.join(F.broadcast(place), column, "left").orderBy(F.col("__place").asc_nulls_last(), column).drop("__place")


def union_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return best_per_group(df, keys, order)


def align_actual_forecast(test: DataFrame, forecast: DataFrame, key: Sequence[str]) -> DataFrame:
    return test.select(*key, "ds", "y").join(forecast, [*key, "ds"])


def attach_baseline(results: DataFrame, baseline: DataFrame, key: Sequence[str]) -> DataFrame:
    return results.join(baseline, list(key), "left")


def series_by_config(series: DataFrame, configs: DataFrame) -> DataFrame:
    """Every series with every configuration; the configurations are a small table that is broadcast."""
    return series.crossJoin(F.broadcast(configs))


def as_arrays(df: DataFrame, key: Sequence[str], y: str = "y", ds: str = "ds") -> DataFrame:
    """One row a key: n and the values ys in order of ds."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ds).alias("d"), F.col(y).alias("v"))))
    return df.groupBy(*key).agg(pairs.alias("p")).select(*key, F.size("p").alias("n"), F.transform("p", lambda x: x["v"]).alias("ys"), F.element_at("p", -1)["d"].alias("last_ds"))
