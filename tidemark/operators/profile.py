"""Aggregates and profile statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import kept, ranged


def month_profile(df: DataFrame, y: str = "y") -> DataFrame:
    """Mean by month of the year, in calendar order."""
    return df.groupBy(F.month("ds").alias("month")).agg(F.avg(y).alias("mean")).orderBy("month")


def mean_by_year(df: DataFrame, y: str = "y") -> DataFrame:
    return df.groupBy(F.year("ds").alias("year")).agg(F.avg(y).alias("mean"))


#: Ranks of approximate quantiles are wrong by a group's rows over this at most; smaller groups than twice this many rows are counted by value as a whole.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float], by: Sequence[str] = (), beside: dict | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, q): the quantiles of every group, interpolated between neighbours, in two passes and without a task or buffer that holds a large group; q is of nulls for a group without values.

    The first pass finds two approximate quantiles around each share, between which the wanted ranks surely lie. The second counts the few rows between them by
    value and all others in one row for each stretch outside. Their running sum says which values have the wanted ranks. Only large groups need edges, of which there is at most one
    for every 2 * ``accuracy`` rows; they are broadcast, so that rows don't meet them by group in a task. ``beside``, aggregates of ``__x`` by name, are taken in the first pass and come along as columns.
    """
    beside = beside or {}
    names = [f"__by{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(n) for b, n in zip(by, names)], F.col(column).cast("double").alias("__x"))
    around = F.array(*[F.lit(float(min(max(s + side * 3 / accuracy, 0), 1))) for side in (-1, 1) for s in shares])
    groups = rows.groupBy(*names).agg(F.percentile_approx("__x", around, F.lit(accuracy)).alias("__edges"), F.count("__x").alias("__seen"), *[v.alias(f"__beside{i}") for i, v in enumerate(beside.values())])
    same = lambda suffix: reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"{n}{suffix}")) for n in names], F.lit(True))
    large = groups.where(F.col("__seen") > 2 * accuracy).select(*[F.col(n).alias(f"{n}b") for n in names], "__edges")
    placed = rows.join(F.broadcast(large), same("b"), "left")
    x, edges = F.col("__x"), [(F.col("__edges")[i], F.col("__edges")[i + len(shares)]) for i in range(len(shares))]
    inside = x.isNotNull() & (F.col("__edges").isNull() | reduce(lambda a, b: a | b, [x.between(low, high) for low, high in edges]))
    least = F.lit(float("-inf"))
    passed = F.greatest(least, *[F.when(high < x, high).otherwise(least) for _, high in edges])
    marked = placed.select(*names, "__x", inside.alias("__in"), F.when(inside, x).otherwise(passed).alias("__v"))
    counts = marked.groupBy(*names, "__v", "__in").agg(F.count("__x").alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*names).orderBy("__v", F.desc("__in")).rowsBetween(W.unboundedPreceding, 0))
    counts = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(W.partitionBy(*names))})
    at = lambda s: (F.col("__all") - 1) * F.lit(float(s))
    here = lambda r: F.max(F.when(F.col("__in") & (r >= F.col("__upto") - F.col("__n")) & (r < F.col("__upto")), F.col("__v")))
    found = counts.groupBy(*names).agg(F.max("__all").alias("__all"), *[v for i, s in enumerate(shares) for v in (here(F.floor(at(s))).alias(f"__f{i}"), here(F.ceil(at(s))).alias(f"__c{i}"))])
    if beside:
        few = groups.select(*[F.col(n).alias(f"{n}s") for n in names], *[f"__beside{i}" for i in range(len(beside))])
        found = found.join(few if names else F.broadcast(few), same("s"))  # a row a group on both sides

    def value(i: int, s: float) -> Column:
        low, high = F.col(f"__f{i}"), F.col(f"__c{i}")
        # The edges surely hold the ranks; if they ever didn't, that is an error and no null.
        missed = (F.col("__all") > 0) & (low.isNull() | high.isNull())
        between = low + F.when(high > low, (at(s) - F.floor(at(s))) * (high - low)).otherwise(0.0)
        return F.when(missed, F.raise_error(F.lit("a rank lies outside of its edges")).cast("double")).otherwise(between)

    return found.select(
        *[F.col(n).alias(b) for b, n in zip(by, names)], F.coalesce(F.col("__all"), F.lit(0)).alias("n"), F.array(*[value(i, s) for i, s in enumerate(shares)]).alias("q"),
        *[F.col(f"__beside{i}").alias(k) for i, k in enumerate(beside)],
    )


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """``df`` joined with ``groups``, a row a group with its number of rows in column ``n``, without a task that holds a large group.

    Large groups, of which there is at most one for every 2 * ACCURACY rows, are broadcast; rows of the others are dealt by group.
    """
    large = groups.where(F.col(n) > 2 * ACCURACY)
    others = df.join(F.broadcast(large.select(*by)), list(by), "left_anti").join(groups.where(F.col(n) <= 2 * ACCURACY), list(by))
    return df.join(F.broadcast(large), list(by)).unionByName(others)


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, deviation, least value, quartiles and greatest value; groups without a value have count 0 and nulls."""
    sums = {"mean": F.avg("__x"), "std": F.stddev("__x"), "min": F.min("__x"), "max": F.max("__x")}
    rows = exact_quantiles(df, column, (0.25, 0.5, 0.75), by, sums)
    return rows.select(*by, "n", "mean", "std", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def adjusted_skew(column: str | Column) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(column: str | Column) -> Column:
    n = F.count(column).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6))


def moments(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample variance, bias-adjusted skewness and excess kurtosis."""
    return df.groupBy(*by).agg(F.variance(column).alias("variance"), adjusted_skew(column).alias("skew"), adjusted_kurtosis(column).alias("kurtosis"))


def null_report(df: DataFrame) -> DataFrame:
    """(column, n_null, percent) in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot("__n", df.columns, "column", "n_null")
    return long.select("column", "n_null", F.expr("100 * try_divide(n_null, __n)").alias("percent"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"))


def quartile_fences(df: DataFrame, column: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    spread = F.col("q")[2] - F.col("q")[0]
    return exact_quantiles(df, column, (0.25, 0.5, 0.75), by).where("n > 0").select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
        (F.col("q")[0] - k * spread).alias("low"), (F.col("q")[2] + k * spread).alias("high"), "n",
    )


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """One row: the fences, the rows outside and their percent."""
    fences = quartile_fences(df, column, (), k).drop("n")
    outside = (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))
    return df.crossJoin(F.broadcast(fences)).groupBy("low", "high").agg(
        F.count_if(outside).alias("n_outside"), (100.0 * F.count_if(outside) / F.count(F.lit(1))).alias("percent")
    )


def box_stats(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, and the least and greatest value inside the fences."""
    inside = F.col(column).between(F.col("low"), F.col("high"))
    rows = with_groups(df, kept(quartile_fences(df, column, by), "fences"), by)
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(column))).alias("whisker_low"), F.max(F.when(inside, F.col(column))).alias("whisker_high")
    )


def histogram(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(bin from 0, n) of equal width between least and greatest value, the greatest in the last bin; constant data is in bin 0."""
    bounds = df.groupBy(*by).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    rows = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    place = F.least(F.floor((F.col(column) - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))), F.lit(bins - 1))
    return rows.where(F.col(column).isNotNull()).select(*by, F.when(F.col("__hi") > F.col("__lo"), place).otherwise(0).cast("int").alias("bin")).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def count_distinct_by(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*by).agg(F.countDistinct(column).alias("n_distinct"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def balance_report(df: DataFrame, label: str) -> DataFrame:
    """One row: classes, least, greatest, total and population deviation of class sizes."""
    return value_counts(df, [label]).agg(
        F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.sum("n").alias("total"), F.stddev_pop("n").alias("deviation")
    )


def pivot_metric(df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], value: str, how=F.sum) -> DataFrame:
    return df.groupBy(*index).pivot(column, list(values)).agg(how(value))


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"))


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column, as doubles, as its rank, ties sharing their mean rank and nulls without one.

    Ranks come from counts by column and value: ranges of values are summed first, so that no task sorts a whole column. Rows find their ranks by value, so the table is written
    first: values that are sums may differ in their last bits when they are computed again, and would find none.
    """
    df = kept(df.withColumns({c: F.col(c).cast("double") for c in columns}), "ranked-rows")
    pairs = F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).alias("__v")) for i, c in enumerate(columns)])
    long = df.select(F.explode(pairs).alias("__p")).select("__p.*").where("__v is not null")
    counts = ranged(long.groupBy("__c", "__v").agg(F.count(F.lit(1)).alias("__n")), "__c", "__v")
    parts = counts.groupBy("__c", "__part").agg(F.sum("__n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy("__c").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("__c", "__part", before.alias("__before"))  # a row a column and range
    inside = F.coalesce(F.sum("__n").over(W.partitionBy("__c", "__part").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.join(parts, ["__c", "__part"]).select("__c", "__v", (F.col("__before") + inside + (F.col("__n") + 1) / 2.0).alias("__rank"))
    for i, c in enumerate(columns):
        df = df.join(ranks.where(F.col("__c") == i).select("__v", "__rank"), F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__rank")).drop("__v", "__rank")
    return df


def corr_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) of every two columns, a before b; Spearman is Pearson of average ranks."""
    if method == "spearman":
        df = average_ranks(df.select(*columns), columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def strong_pairs(matrix: DataFrame, limit: float = 0.95) -> DataFrame:
    """The pairs of a correlation matrix whose coefficient is above ``limit`` in absolute value."""
    return matrix.where(F.abs("r") > limit)


def trend_slope(df: DataFrame, key: Sequence[str], y: str | Column = "y", t: str = "t") -> DataFrame:
    y = F.col(y) if isinstance(y, str) else y
    return df.groupBy(*key).agg(F.regr_slope(y, F.col(t)).alias("slope"), F.regr_intercept(y, F.col(t)).alias("intercept"))


def trend_line(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The series with its fitted line."""
    return df.join(trend_slope(df, key), list(key)).withColumn("fitted", F.col("intercept") + F.col("slope") * F.col("t"))


def annual_growth_pct(df: DataFrame, key: Sequence[str], before: str | None = None) -> DataFrame:
    """100 (exp(12 slope) - 1) of log1p(y), of the months before a break if given."""
    if before is not None:
        df = df.where(F.col("ds") < F.lit(before).cast("date"))
    slope = trend_slope(df, key, F.log1p("y"))
    return slope.select(*key, (100 * (F.exp(12 * F.col("slope")) - 1)).alias("growth"))


def period_impact(df: DataFrame, key: Sequence[str], year: int, base: int, y: str = "y") -> DataFrame:
    """Totals of a year and a base year, and the change in percent; null without a base."""
    of = lambda k: F.coalesce(F.sum(F.when(F.year("ds") == k, F.col(y))), F.lit(0.0))
    return df.groupBy(*key).agg(of(base).alias("base"), of(year).alias("total")).withColumn("impact", F.expr("100 * try_divide(total - base, base)"))


def log_volatility(df: DataFrame, key: Sequence[str], y: str = "y") -> DataFrame:
    """100 times the sample deviation of the differences of log1p(y)."""
    w = W.partitionBy(*key).orderBy("ds")
    return df.withColumn("__d", F.log1p(y) - F.lag(F.log1p(y)).over(w)).groupBy(*key).agg((100 * F.stddev("__d")).alias("volatility"))


def forecast_errors(aligned: DataFrame, key: Sequence[str]) -> DataFrame:
    """MAE, RMSE, and RMSE over the mean, of y against yhat."""
    e = F.col("y") - F.col("yhat")
    return aligned.groupBy(*key).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.expr("try_divide(sqrt(avg((y - yhat) * (y - yhat))), avg(y))").alias("nrmse"))


def mean_over_runs(df: DataFrame, config: Sequence[str], column: str) -> DataFrame:
    return df.groupBy(*config).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def percentile_of_pair(pairs: DataFrame, distance: str = "distance") -> DataFrame:
    """Share of the pairs that are closer, of an aggregated table of pairs."""
    w = W.orderBy(distance)
    return pairs.withColumn("closer", (F.rank().over(w) - 1) / F.count(F.lit(1)).over(W.partitionBy()))


def composition(df: DataFrame, key: str, total: str, y: str = "y") -> DataFrame:
    """Mean of every series and its percent of the mean of the series ``total``."""
    means = df.groupBy(key).agg(F.avg(y).alias("mean"))
    whole = means.where(F.col(key) == total).select(F.col("mean").alias("__whole"))
    return means.where(F.col(key) != total).crossJoin(F.broadcast(whole)).select(key, "mean", F.expr("100 * try_divide(mean, __whole)").alias("percent"))
