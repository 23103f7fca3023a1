"""Filters, projections and scalar functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.profile import exact_quantiles
from tidemark.sources.tables import ranged


def filter_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isin(list(values)))


def filter_period(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "ds") -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast("date"))
    return df if end is None else df.where(F.col(column) <= F.lit(end).cast("date"))


def filter_category(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def month_start(year: str, month: str) -> Column:
    return F.make_date(F.col(year).cast("int"), F.col(month).cast("int"), F.lit(1))


def decade(year: str | Column) -> Column:
    return (F.floor((F.col(year) if isinstance(year, str) else year) / 10) * 10).cast("int")


def log_scale(column: str) -> Column:
    return F.log1p(column)


def from_log_scale(column: str) -> Column:
    return F.greatest(F.lit(0.0), F.expm1(column))


def clip_upper_quantile(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """Values above the exact quantile become the quantile; a one-row aggregate is broadcast."""
    top = exact_quantiles(df, column, (q,)).select(F.col("q")[0].alias("__top"))
    return df.join(F.broadcast(top), how="left").withColumn(column, F.least(F.col(column), F.col("__top"))).drop("__top")


def clip_lower(column: str, low: float = 0.0) -> Column:
    return F.greatest(F.col(column), F.lit(low))


def share_of_total(df: DataFrame, column: str, name: str = "share") -> DataFrame:
    """Percent of the sum over all rows, of a table that is already aggregated."""
    total = df.agg(F.sum(column).alias("__total"))
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.expr(f"100 * try_divide({column}, __total)")).drop("__total")


def label_bands(column: str, cuts: Sequence[tuple[float, str]], above: str) -> Column:
    """The label of the first cut that the value is below, else ``above``; null stays null."""
    out = F.when(F.col(column).isNull(), F.lit(None).cast("string"))
    for cut, label in cuts:
        out = out.when(F.col(column) < F.lit(cut), F.lit(label))
    return out.otherwise(F.lit(above))


def frame_number(path: str | Column) -> Column:
    """The digits in a file's stem as a number; null without digits."""
    name = F.element_at(F.split(F.col(path) if isinstance(path, str) else path, "/"), -1)
    digits = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def class_index(df: DataFrame, label: str, classes: Sequence[str], name: str = "y") -> DataFrame:
    """The place of the label in ``classes``, from 0; null for other labels."""
    order = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"`{label}` string, `{name}` int")
    return df.join(F.broadcast(order), label, "left")


def fill_nonfinite(df: DataFrame, key: Sequence[str], columns: Sequence[str], order: str = "ds") -> DataFrame:
    """Infinite and NaN values as null; then the last value before, the first after, 0.

    Ranges of (key, order) are filled by themselves and stitched by the last and first values of the ranges around, a row a key and range, so that
    no task holds a whole key. Rows with a null key are one series. Of rows with one place in the order any may be the last.
    """
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.col(c)) for c in columns}
    rows = ranged(df.withColumns(finite), *key, order)
    near = W.partitionBy(*key, "__part")
    back, ahead = near.orderBy(F.asc(order)), near.orderBy(F.desc(order))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))["v"]
    ends = rows.groupBy(*key, "__part").agg(*[x for i, c in enumerate(columns) for x in (first(c).alias(f"__f{i}"), last(c).alias(f"__l{i}"))])
    # A row a key and range; frames that only grow, since Spark computes a shrinking one anew for every row.
    along, against = (W.partitionBy(*key).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("__part"), F.desc("__part")))
    around = {f"__b{i}": F.last(f"__l{i}", ignorenulls=True).over(along) for i in range(len(columns))} | {f"__a{i}": F.last(f"__f{i}", ignorenulls=True).over(against) for i in range(len(columns))}
    ends = ends.withColumns(around).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("__part").alias("__in"), *around)
    rows = rows.join(ends, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)], F.col("__part") == F.col("__in")))
    before, after = (w.rowsBetween(W.unboundedPreceding, 0) for w in (back, ahead))
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"__b{i}"), F.last(c, ignorenulls=True).over(after), F.col(f"__a{i}"), F.lit(0.0)) for i, c in enumerate(columns)}
    return rows.withColumns(filled).select(*df.columns)


def drop_constant_columns(df: DataFrame, columns: Sequence[str], eps: float = 1e-12) -> DataFrame:
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if spread[c] is None or spread[c] <= eps])


def minmax_constants(train: DataFrame, key: Sequence[str], column: str = "y") -> DataFrame:
    return train.groupBy(*key).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def minmax_scale(df: DataFrame, constants: DataFrame, key: Sequence[str], column: str = "y", name: str = "scaled") -> DataFrame:
    """(x - low) / (high - low) with the constants of each key's training rows; 0 where they are equal."""
    return df.join(constants, list(key)).withColumn(name, F.when(F.col("high") > F.col("low"), (F.col(column) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0))


def minmax_unscale(df: DataFrame, column: str = "scaled", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(column) * (F.col("high") - F.col("low")) + F.col("low"))


def zscore_constants(train: DataFrame, key: Sequence[str], column: str = "y") -> DataFrame:
    return train.groupBy(*key).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def zscore(df: DataFrame, constants: DataFrame, key: Sequence[str], column: str = "y", name: str = "z") -> DataFrame:
    """(x - mean) / population deviation; 0 where the deviation is 0."""
    joined = df.join(constants, list(key)) if key else df.crossJoin(F.broadcast(constants))
    return joined.withColumn(name, F.when(F.col("deviation") > 0, (F.col(column) - F.col("mean")) / F.col("deviation")).otherwise(0.0))


def zscore_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its mean over its population deviation; one aggregate, broadcast."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))
    scaled = {c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.col(f"__s_{c}")).otherwise(0.0) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def unscale_z(df: DataFrame, column: str = "z", name: str = "y") -> DataFrame:
    return df.withColumn(name, F.col(column) * F.col("deviation") + F.col("mean"))


def relative_change(new: str, base: str) -> Column:
    """Percent against a baseline; null for a baseline of 0."""
    return F.expr(f"100 * try_divide({new} - {base}, {base})")


def scale_pixels(pixels: str, means: Sequence[float], deviations: Sequence[float]) -> Column:
    """Interleaved channel values of 0 to 255, over 255, less the channel's mean over its deviation."""
    m, s, n = F.array(*map(F.lit, means)), F.array(*map(F.lit, deviations)), len(means)
    return F.transform(pixels, lambda x, i: (x / 255.0 - F.element_at(m, (i % n + 1).cast("int"))) / F.element_at(s, (i % n + 1).cast("int")))


def unscale_pixels(pixels: str, means: Sequence[float], deviations: Sequence[float]) -> Column:
    m, s, n = F.array(*map(F.lit, means)), F.array(*map(F.lit, deviations)), len(means)
    return F.transform(pixels, lambda x, i: (x * F.element_at(s, (i % n + 1).cast("int")) + F.element_at(m, (i % n + 1).cast("int"))) * 255.0)
