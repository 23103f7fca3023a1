"""Queries over projections, filters, joins, aggregates and windows, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import profile as P
from tidemark.operators import series as T
from tidemark.sources.tables import coerce_numeric, facts, table

QUERIES, SQL = {}, {}

FACTS = """facts AS (
  SELECT o_orderkey AS order_key, date_trunc('month', o_orderdate)::DATE AS ds, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month,
    n_name AS country, r_name AS region, c_mktsegment AS route, o_orderpriority AS kind, o_totalprice AS measure
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def series_sql(key: str) -> str:
    return f"""{FACTS}, series AS (
  SELECT k.{key}, c.ds, coalesce(t.y, 0) AS y FROM (SELECT DISTINCT {key} FROM facts) k
  CROSS JOIN (SELECT unnest(generate_series((SELECT min(ds) FROM facts), (SELECT max(ds) FROM facts), INTERVAL 1 MONTH))::DATE AS ds) c
  LEFT JOIN (SELECT {key}, ds, sum(measure) AS y FROM facts GROUP BY 1, 2) t ON t.{key} = k.{key} AND t.ds = c.ds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ds) AS k, count(*) OVER (PARTITION BY {key}) AS n FROM series
)"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds columns; dates become text, whole numbers 64-bit."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name in digits:
            c = F.round(c.cast("double"), digits[name])
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("date").cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query_into(queries: dict, texts: dict):
    """A decorator that registers a plan by name, with the SQL that checks it."""

    def query(name: str, sql: str | None = None):
        def register(f):
            queries[name] = f
            if sql is not None:
                texts[name] = sql
            return f

        return register

    return query


query = query_into(QUERIES, SQL)


def monthly(spark, sf, key="region") -> DataFrame:
    return T.monthly_series(facts(spark, sf), [key], "measure")


@query("o02_coerce_numeric", """SELECT o_orderstatus AS status, count(*) AS n, count(x) AS n_numbers, coalesce(round(sum(x), 2), 0) AS total FROM (
  SELECT o_orderstatus, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE o_totalprice::VARCHAR END AS DOUBLE) AS x FROM orders) GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("x", F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")))
    df = coerce_numeric(df, "x").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("n_numbers"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("total"))
    return rounded(df, total=2)


@query("o07_filter_in", f"WITH {FACTS} SELECT order_key, kind, measure FROM facts WHERE kind IN ('1-URGENT', '2-HIGH')")
def _(spark, sf):
    return S.filter_in(facts(spark, sf), "kind", ["1-URGENT", "2-HIGH"]).select("order_key", "kind", "measure")


@query("o08_filter_period", f"WITH {FACTS} SELECT order_key, ds::VARCHAR AS ds FROM facts WHERE ds BETWEEN DATE '1996-01-01' AND DATE '1997-12-01'")
def _(spark, sf):
    return rounded(S.filter_period(facts(spark, sf), "1996-01-01", "1997-12-01").select("order_key", "ds"))


@query("o09_filter_category", f"WITH {FACTS} SELECT order_key, route, measure FROM facts WHERE route = 'BUILDING'")
def _(spark, sf):
    return S.filter_category(facts(spark, sf), "route", "BUILDING").select("order_key", "route", "measure")


@query("o10_month_start", f"WITH {FACTS} SELECT DISTINCT make_date(year, month, 1)::VARCHAR AS ds FROM facts")
def _(spark, sf):
    return rounded(facts(spark, sf).select(S.month_start("year", "month").alias("ds")).distinct())


@query("o11_decade", f"WITH {FACTS} SELECT (year // 10 * 10)::BIGINT AS decade, count(*) AS n FROM facts GROUP BY 1")
def _(spark, sf):
    return rounded(P.value_counts(facts(spark, sf).select(S.decade("year").alias("decade")), ["decade"]))


@query("o12_log_scale", """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS logged, round(greatest(0, exp(ln(1 + o_totalprice)) - 1), 2) AS back FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").withColumn("logged", S.log_scale("o_totalprice"))
    return rounded(df.select("o_orderkey", "logged", S.from_log_scale("logged").alias("back")), logged=6, back=2)


@query("o13_clip_upper_quantile", """SELECT o_orderkey, round(least(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)), 2) AS price FROM orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return rounded(S.clip_upper_quantile(df, "price", 0.99), price=2)


@query("o14_clip_lower", "SELECT c_custkey, greatest(c_acctbal, 0) AS balance FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.clip_lower("c_acctbal", 0.0).alias("balance"))


@query("o15_share_of_total", f"WITH {FACTS} SELECT route, round(sum(measure), 2) AS y, round(100 * sum(measure) / sum(sum(measure)) OVER (), 6) AS share FROM facts GROUP BY route")
def _(spark, sf):
    return rounded(S.share_of_total(T.total_by(facts(spark, sf), ["route"], "measure"), "y"), y=2, share=6)


@query("o16_label_bands", """SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'weak' WHEN o_totalprice < 150000 THEN 'moderate' ELSE 'strong' END AS band FROM orders""")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.label_bands("o_totalprice", [(50000.0, "weak"), (150000.0, "moderate")], "strong").alias("band"))


@query("o17_frame_number", "SELECT vec_id, vec_id AS frame FROM embeddings")
def _(spark, sf):
    paths = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("set9/class"), "label", F.lit("/A"), F.col("vec_id"), F.lit(".jpg")).alias("path"))
    return paths.select("vec_id", S.frame_number("path").alias("frame"))


@query("o18_class_index", "SELECT r_name, CASE r_name WHEN 'ASIA' THEN 0 WHEN 'EUROPE' THEN 1 WHEN 'AFRICA' THEN 2 END::BIGINT AS y FROM region")
def _(spark, sf):
    return rounded(S.class_index(table(spark, sf, "region").select("r_name"), "r_name", ["ASIA", "EUROPE", "AFRICA"]))


@query("o19_fill_nonfinite", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS x FROM events)
SELECT event_id, coalesce(last_value(x IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS x
FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def _(spark, sf):
    x = F.when(F.col("event_id") % 21 == 0, F.lit(float("inf"))).when(F.col("event_id") % 14 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    df = table(spark, sf, "events").select("event_id", "event_type", x.alias("x"))
    return S.fill_nonfinite(df, ["event_type"], ["x"], "event_id").select("event_id", "x")


@query("o20_drop_constant_columns", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.lit(1.0).alias("constant"), "l_discount")
    return S.drop_constant_columns(df, ["l_quantity", "constant", "l_discount"])


@query("o21_minmax_scale", f"""WITH {series_sql('region')}, c AS (SELECT region, min(y) AS low, max(y) AS high FROM numbered WHERE k <= floor(n * 0.7::DOUBLE) GROUP BY 1)
SELECT region, ds::VARCHAR AS ds, round((y - low) / (high - low), 6) AS scaled, round((y - low) / (high - low) * (high - low) + low, 2) AS back FROM numbered JOIN c USING (region)""")
def _(spark, sf):
    s = T.split_temporal(monthly(spark, sf), ["region"])
    scaled = S.minmax_scale(s, S.minmax_constants(s.where("split = 'train'"), ["region"]), ["region"])
    return rounded(S.minmax_unscale(scaled, name="back").select("region", "ds", "scaled", "back"), scaled=6, back=2)


@query("o22_zscore", f"WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) AS z FROM series WINDOW w AS (PARTITION BY country)")
def _(spark, sf):
    s = monthly(spark, sf, "country")
    return rounded(S.zscore(s, S.zscore_constants(s, ["country"]), ["country"]).select("country", "ds", "z"), z=6)


@query("o23_relative_change", f"""WITH {FACTS}, t AS (SELECT country, coalesce(sum(measure) FILTER (year = 1996), 0) AS a, coalesce(sum(measure) FILTER (year = 1997), 0) AS b FROM facts GROUP BY 1)
SELECT country, round(CASE WHEN a <> 0 THEN 100 * (b - a) / a END, 6) AS change FROM t""")
def _(spark, sf):
    of = lambda y: F.coalesce(F.sum(F.when(F.col("year") == y, F.col("measure"))), F.lit(0.0))
    t = facts(spark, sf).groupBy("country").agg(of(1996).alias("a"), of(1997).alias("b"))
    return rounded(t.select("country", S.relative_change("b", "a").alias("change")), change=6)


@query("o26_fill_calendar", f"WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, round(y, 2) AS y FROM series")
def _(spark, sf):
    return rounded(monthly(spark, sf, "country"), y=2)


@query("o26_fill_calendar_hourly", """WITH e AS (SELECT event_type, date_trunc('hour', ts) AS ds, count(*)::DOUBLE AS y FROM events GROUP BY 1, 2)
SELECT k.event_type, strftime(c.ds, '%Y-%m-%d %H:%M:%S') AS ds, coalesce(e.y, 0) AS y FROM (SELECT DISTINCT event_type FROM e) k
CROSS JOIN (SELECT unnest(generate_series((SELECT min(ds) FROM e), (SELECT max(ds) FROM e), INTERVAL 1 HOUR)) AS ds) c LEFT JOIN e ON e.event_type = k.event_type AND e.ds = c.ds""")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ds")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return T.fill_calendar(e, ["event_type"], "1 hour").withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm:ss"))


@query("o28_attach_baseline", f"""WITH {FACTS} SELECT country, round(sum(measure), 2) AS y, round(any_value(b.base), 2) AS base FROM facts
JOIN (SELECT region AS r, avg(measure) AS base FROM facts GROUP BY 1) b ON b.r = region GROUP BY country""")
def _(spark, sf):
    f = facts(spark, sf)
    totals = f.groupBy("country", "region").agg(F.sum("measure").alias("y"))
    return rounded(T.attach_baseline(totals, f.groupBy("region").agg(F.avg("measure").alias("base")), ["region"]).select("country", "y", "base"), y=2, base=2)


@query("o29_series_by_config", f"WITH {series_sql('region')} SELECT region, a AS alpha, count(*) AS n, round(sum(y) * a, 2) AS weighed FROM series CROSS JOIN (VALUES (0.1::DOUBLE), (0.5::DOUBLE)) v(a) GROUP BY 1, 2")
def _(spark, sf):
    both = T.series_by_config(monthly(spark, sf), spark.createDataFrame([(0.1,), (0.5,)], "alpha double"))
    return rounded(both.groupBy("region", "alpha").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).select("region", "alpha", "n", (F.col("s") * F.col("alpha")).alias("weighed")), weighed=2)


for _name, _dims in (("month", ["ds"]), ("year", ["year"]), ("country", ["country"]), ("region", ["region"]), ("route", ["route"]), ("country_route", ["country", "route"])):
    _select = ", ".join(f"{d}::VARCHAR AS {d}" if d == "ds" else f"{d}::BIGINT AS {d}" if d == "year" else d for d in _dims)
    _group = ", ".join(map(str, range(1, len(_dims) + 1)))

    def _total(spark, sf, dims=tuple(_dims)):
        return rounded(T.total_by(facts(spark, sf), list(dims), "measure"), y=2)

    query(f"o32_total_by_{_name}", f"WITH {FACTS} SELECT {_select}, round(sum(measure), 2) AS y FROM facts GROUP BY {_group}")(_total)


@query("o33_monthly_series", f"WITH {FACTS} SELECT region, ds::VARCHAR AS ds, round(sum(measure), 2) AS y FROM facts WHERE kind IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2")
def _(spark, sf):
    return rounded(T.monthly_series(S.filter_in(facts(spark, sf), "kind", ["1-URGENT", "2-HIGH"]), ["region"], "measure", fill=False), y=2)


@query("o33_monthly_series_lineitem", """SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE::VARCHAR AS ds, round(sum(l_quantity), 2) AS y FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("ds"), "l_quantity")
    return rounded(T.monthly_series(df, ["l_returnflag"], "l_quantity", fill=False), y=2)


@query("o34_month_profile", f"WITH {FACTS}, t AS (SELECT ds, sum(measure) AS y FROM facts GROUP BY 1) SELECT month(ds) AS month, round(avg(y), 2) AS mean FROM t GROUP BY 1")
def _(spark, sf):
    return rounded(P.month_profile(T.total_by(facts(spark, sf), ["ds"], "measure")), mean=2)


@query("o35_mean_by_year", f"WITH {FACTS}, t AS (SELECT ds, sum(measure) AS y FROM facts GROUP BY 1) SELECT year(ds) AS year, round(avg(y), 2) AS mean FROM t GROUP BY 1")
def _(spark, sf):
    return rounded(P.mean_by_year(T.total_by(facts(spark, sf), ["ds"], "measure")), mean=2)


@query("o36_describe", f"""WITH {FACTS} SELECT region, count(measure) AS n, round(avg(measure), 4) AS mean, round(stddev_samp(measure), 4) AS std, min(measure) AS min,
round(quantile_cont(measure, 0.25), 4) AS q25, round(quantile_cont(measure, 0.5), 4) AS q50, round(quantile_cont(measure, 0.75), 4) AS q75, max(measure) AS max FROM facts GROUP BY 1""")
def _(spark, sf):
    return rounded(P.describe(facts(spark, sf), "measure", ["region"]), mean=4, std=4, q25=4, q50=4, q75=4)


@query("o37_moments", f"WITH {FACTS} SELECT region, round(var_samp(measure), 0) AS variance, round(skewness(measure), 6) AS skew, round(kurtosis(measure), 6) AS kurtosis FROM facts GROUP BY 1")
def _(spark, sf):
    return rounded(P.moments(facts(spark, sf), "measure", ["region"]), variance=0, skew=6, kurtosis=6)


@query("o38_null_report", """WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT 'event_id' AS "column", count(*) - count(event_id) AS n_null, 100.0 * (count(*) - count(event_id)) / count(*) AS percent FROM e
UNION ALL SELECT 'event_type', count(*) - count(event_type), 100.0 * (count(*) - count(event_type)) / count(*) FROM e
UNION ALL SELECT 'value', count(*) - count(value), 100.0 * (count(*) - count(value)) / count(*) FROM e""")
def _(spark, sf):
    return P.null_report(table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value")))


@query("o39_duplicate_count", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS n_duplicates FROM lineitem")
def _(spark, sf):
    return P.duplicate_count(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


_Q = "quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3"


@query("o40_iqr_outliers", f"""WITH q AS (SELECT {_Q} FROM lineitem), f AS (SELECT q1 - 0.5 * (q3 - q1) AS low, q3 + 0.5 * (q3 - q1) AS high FROM q)
SELECT round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (l_extendedprice < low OR l_extendedprice > high) AS n_outside,
round(100.0 * count(*) FILTER (l_extendedprice < low OR l_extendedprice > high) / count(*), 6) AS percent FROM lineitem, f GROUP BY f.low, f.high""")
def _(spark, sf):
    return rounded(P.iqr_outliers(table(spark, sf, "lineitem").select("l_extendedprice"), "l_extendedprice", 0.5), low=4, high=4, percent=6)


@query("o41_box_stats", f"""WITH q AS (SELECT l_returnflag, {_Q} FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
min(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
max(l_extendedprice) FILTER (l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q.q1, q.median, q.q3""")
def _(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"]), q1=4, median=4, q3=4)


@query("o42_histogram", """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) * 20 / (hi - lo)), 19)::BIGINT AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def _(spark, sf):
    return rounded(P.histogram(table(spark, sf, "orders"), "o_totalprice", 20))


@query("o43_distinct_values", f"WITH {FACTS} SELECT DISTINCT kind FROM facts")
def _(spark, sf):
    return P.distinct_values(facts(spark, sf), "kind")


@query("o43_count_distinct_by", f"WITH {FACTS} SELECT region, count(DISTINCT ds) AS n_distinct FROM facts GROUP BY 1")
def _(spark, sf):
    return P.count_distinct_by(facts(spark, sf), ["region"], "ds")


@query("o44_value_counts", f"WITH {FACTS} SELECT route, kind, count(*) AS n FROM facts GROUP BY 1, 2")
def _(spark, sf):
    return P.value_counts(facts(spark, sf), ["route", "kind"])


@query("o45_balance_report", "SELECT count(*) AS n_classes, min(n) AS least, max(n) AS greatest, sum(n)::BIGINT AS total, round(stddev_pop(n), 6) AS deviation FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def _(spark, sf):
    return rounded(P.balance_report(table(spark, sf, "embeddings"), "label"), deviation=6)


_ROUTES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("o46_pivot_metric", f"WITH {FACTS} SELECT region, " + ", ".join(f"round(sum(measure) FILTER (route = '{r}'), 2) AS {r.lower()}" for r in _ROUTES) + " FROM facts GROUP BY 1")
def _(spark, sf):
    df = P.pivot_metric(facts(spark, sf), ["region"], "route", _ROUTES, "measure")
    return rounded(df.select("region", *[F.col(r).alias(r.lower()) for r in _ROUTES]), **{r.lower(): 2 for r in _ROUTES})


@query("o47_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(spark, sf):
    return rounded(P.correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), r=6)


_MONTHS = f"WITH {FACTS}, m AS (SELECT ds, sum(measure) FILTER (region = 'ASIA') AS asia, sum(measure) FILTER (region = 'EUROPE') AS europe, sum(measure) FILTER (region = 'AFRICA') AS africa FROM facts GROUP BY 1)"


def _region_months(spark, sf):
    df = P.pivot_metric(facts(spark, sf), ["ds"], "region", ["ASIA", "EUROPE", "AFRICA"], "measure")
    return df.select("ds", F.col("ASIA").alias("asia"), F.col("EUROPE").alias("europe"), F.col("AFRICA").alias("africa"))


_PAIRS = (("asia", "europe"), ("asia", "africa"), ("europe", "africa"))


@query("o48_corr_matrix_pearson", _MONTHS + " UNION ALL ".join(f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM m" for a, b in _PAIRS))
def _(spark, sf):
    return rounded(P.corr_matrix(_region_months(spark, sf), ["asia", "europe", "africa"]), r=6)


_RANKS = ", ranked AS (SELECT " + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}" for c in ("asia", "europe", "africa")) + " FROM m)"


@query("o48_corr_matrix_spearman", _MONTHS + _RANKS + " UNION ALL ".join(f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM ranked" for a, b in _PAIRS))
def _(spark, sf):
    return rounded(P.corr_matrix(_region_months(spark, sf), ["asia", "europe", "africa"], "spearman"), r=6)


_STRONG = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM o" for a, b in (("price", "logged"), ("price", "customer"), ("logged", "customer")))


@query("o48_strong_pairs", f"WITH o AS (SELECT o_totalprice AS price, ln(1 + o_totalprice) AS logged, o_custkey AS customer FROM orders) SELECT a, b, round(r, 6) AS r FROM ({_STRONG}) WHERE abs(r) > 0.8")
def _(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_totalprice").alias("price"), S.log_scale("o_totalprice").alias("logged"), F.col("o_custkey").alias("customer"))
    return rounded(P.strong_pairs(P.corr_matrix(rows, ["price", "logged", "customer"]), 0.8), r=6)


@query("o49_trend_slope", f"WITH {series_sql('country')} SELECT country, round(regr_slope(y, k - 1), 4) AS slope, round(regr_intercept(y, k - 1), 2) AS intercept FROM numbered GROUP BY 1")
def _(spark, sf):
    return rounded(P.trend_slope(T.with_index(monthly(spark, sf, "country"), ["country"]), ["country"]), slope=4, intercept=2)


@query("o50_annual_growth_pct", f"WITH {series_sql('country')} SELECT country, round(100 * (exp(12 * regr_slope(ln(1 + y), k - 1)) - 1), 4) AS growth FROM numbered WHERE ds < DATE '2000-01-01' GROUP BY 1")
def _(spark, sf):
    return rounded(P.annual_growth_pct(T.with_index(monthly(spark, sf, "country"), ["country"]), ["country"], "2000-01-01"), growth=4)


@query("o51_period_impact", f"""WITH {series_sql('country')}, t AS (SELECT country, coalesce(sum(y) FILTER (year(ds) = 1996), 0) AS base, coalesce(sum(y) FILTER (year(ds) = 1997), 0) AS total FROM series GROUP BY 1)
SELECT country, round(base, 2) AS base, round(total, 2) AS total, round(CASE WHEN base <> 0 THEN 100 * (total - base) / base END, 6) AS impact FROM t""")
def _(spark, sf):
    return rounded(P.period_impact(monthly(spark, sf, "country"), ["country"], 1997, 1996), base=2, total=2, impact=6)


@query("o52_log_volatility", f"WITH {series_sql('country')}, d AS (SELECT country, ln(1 + y) - lag(ln(1 + y)) OVER (PARTITION BY country ORDER BY ds) AS d FROM series) SELECT country, round(100 * stddev_samp(d), 4) AS volatility FROM d GROUP BY 1")
def _(spark, sf):
    return rounded(P.log_volatility(monthly(spark, sf, "country"), ["country"]), volatility=4)


@query("o54_mean_over_runs", "SELECT l_returnflag, l_linestatus, round(avg(l_discount), 8) AS mean, round(stddev_pop(l_discount), 8) AS deviation FROM lineitem GROUP BY 1, 2")
def _(spark, sf):
    return rounded(P.mean_over_runs(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount"), mean=8, deviation=8)


@query("o59_composition", f"WITH {series_sql('region')}, m AS (SELECT region, avg(y) AS mean FROM series GROUP BY 1) SELECT region, round(mean, 2) AS mean, round(100 * mean / (SELECT mean FROM m WHERE region = 'ASIA'), 6) AS percent FROM m WHERE region <> 'ASIA'")
def _(spark, sf):
    return rounded(P.composition(monthly(spark, sf), "region", "ASIA"), mean=2, percent=6)


@query("o60_rolling", f"""WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, round(CASE WHEN k >= 12 THEN avg(y) OVER w END, 4) AS rolling_avg,
round(CASE WHEN k >= 12 THEN stddev_samp(y) OVER w END, 2) AS rolling_stddev FROM numbered WINDOW w AS (PARTITION BY country ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    df = T.rolling(T.rolling(monthly(spark, sf, "country"), ["country"], 12, "avg"), ["country"], 12, "stddev")
    return rounded(df.select("country", "ds", "rolling_avg", "rolling_stddev"), rolling_avg=4, rolling_stddev=2)


@query("o61_difference", f"""WITH {series_sql('country')}, d AS (SELECT *, y - lag(y) OVER (PARTITION BY country ORDER BY ds) AS d1 FROM series)
SELECT country, ds::VARCHAR AS ds, round(d1 - lag(d1) OVER (PARTITION BY country ORDER BY ds), 2) AS diff FROM d""")
def _(spark, sf):
    return rounded(T.difference(monthly(spark, sf, "country"), ["country"], 2).select("country", "ds", "diff"), diff=2)


@query("o62_lag_windows", f"""WITH {series_sql('region')}, w AS (SELECT region, ds, k, n, list(y) OVER (PARTITION BY region ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS x,
list(y) OVER (PARTITION BY region ORDER BY ds ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS t FROM numbered)
SELECT region, ds::VARCHAR AS ds, round(x[1], 2) AS first_lag, round(x[6], 2) AS last_lag, round(t[1], 2) AS first_target, round(t[3], 2) AS last_target FROM w WHERE k > 6 AND k <= n - 2""")
def _(spark, sf):
    w = T.lag_windows(monthly(spark, sf), ["region"], 6, 3)
    out = w.select("region", "ds", F.col("x")[0].alias("first_lag"), F.col("x")[5].alias("last_lag"), F.col("target")[0].alias("first_target"), F.col("target")[2].alias("last_target"))
    return rounded(out, first_lag=2, last_lag=2, first_target=2, last_target=2)


@query("o63_split_temporal", f"""WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, CASE WHEN k <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM numbered""")
def _(spark, sf):
    return rounded(T.split_temporal(monthly(spark, sf, "country"), ["country"], (("train", 0.6), ("val", 0.2), ("test", 0.2))).select("country", "ds", "split"))


@query("o64_best_per_group", f"WITH {FACTS}, t AS (SELECT region, country, sum(measure) AS y FROM facts GROUP BY 1, 2) SELECT region, country, round(y, 2) AS y FROM t QUALIFY row_number() OVER (PARTITION BY region ORDER BY y DESC, country) = 1")
def _(spark, sf):
    return rounded(T.best_per_group(T.total_by(facts(spark, sf), ["region", "country"], "measure"), ["region"], [F.desc("y"), "country"]), y=2)


@query("o65_cumulative_share", f"WITH {FACTS}, t AS (SELECT country, sum(measure) AS y FROM facts GROUP BY 1) SELECT country, round(y, 2) AS y, round(100 * sum(y) OVER (ORDER BY y DESC, country ROWS UNBOUNDED PRECEDING) / sum(y) OVER (), 6) AS cumulative FROM t")
def _(spark, sf):
    return rounded(T.cumulative_share(T.total_by(facts(spark, sf), ["country"], "measure"), "y", "country"), y=2, cumulative=6)


@query("o66_rolling_features", f"""WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, round(CASE WHEN k > 24 THEN avg(y) OVER w END, 5) AS f_mean, round(CASE WHEN k > 24 THEN stddev_samp(y) OVER w END, 2) AS f_std,
round(CASE WHEN k > 24 THEN min(y) OVER w END, 2) AS f_min, round(CASE WHEN k > 24 THEN max(y) OVER w END, 2) AS f_max, round(CASE WHEN k > 24 THEN lag(y) OVER (PARTITION BY country ORDER BY ds) END, 2) AS f_last,
round(CASE WHEN k > 24 THEN regr_slope(y, k - 1) OVER w END, 4) AS f_slope FROM numbered WINDOW w AS (PARTITION BY country ORDER BY ds ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def _(spark, sf):
    df = T.rolling_features(T.with_index(monthly(spark, sf, "country"), ["country"]), ["country"]).drop("t", "y")
    return rounded(df, f_mean=5, f_std=2, f_min=2, f_max=2, f_last=2, f_slope=4)


@query("o69_top_k", f"WITH {FACTS} SELECT country, round(sum(measure), 2) AS y FROM facts GROUP BY 1 ORDER BY sum(measure) DESC, country LIMIT 10")
def _(spark, sf):
    return rounded(T.top_k(T.total_by(facts(spark, sf), ["country"], "measure"), "y", ["country"], 10), y=2)


@query("o70_extremes", "(SELECT o_orderkey, o_totalprice, 'low' AS side FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) UNION ALL (SELECT o_orderkey, o_totalprice, 'high' FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)")
def _(spark, sf):
    return T.extremes(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], 5)


@query("o71_sort_by_order", f"WITH {FACTS} SELECT region, round(sum(measure), 2) AS y, row_number() OVER (ORDER BY CASE region WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 WHEN 'AMERICA' THEN 2 ELSE 3 END, region) - 1 AS place FROM facts GROUP BY 1")
def _(spark, sf):
    # A row's place is its number in its partition and the rows in the partitions before, as the sort leaves them.
    rows = T.sort_by_order(T.total_by(facts(spark, sf), ["region"], "measure"), "region", ["EUROPE", "ASIA", "AMERICA"]).coalesce(1)
    return rounded(rows.withColumn("place", F.monotonically_increasing_id()), y=2)


@query("o72_last_n", f"WITH {series_sql('country')} SELECT country, ds::VARCHAR AS ds, round(y, 2) AS y FROM numbered WHERE k > n - 12")
def _(spark, sf):
    return rounded(T.last_n(monthly(spark, sf, "country"), ["country"], 12), y=2)


@query("o73_union_tables", f"WITH {FACTS} SELECT region AS name, round(sum(measure), 2) AS y FROM facts GROUP BY 1 UNION ALL SELECT route, round(sum(measure), 2) FROM facts GROUP BY 1")
def _(spark, sf):
    f = facts(spark, sf)
    name = lambda c: T.total_by(f, [c], "measure").withColumnRenamed(c, "name")
    return rounded(T.union_tables(name("region"), name("route")), y=2)


@query("o74_dedupe_first", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def _(spark, sf):
    return T.dedupe_first(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")
