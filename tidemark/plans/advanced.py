"""Queries over diagnostics, forecasts, features, vectors and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import diagnostics as D
from tidemark.operators import features as X
from tidemark.operators import forecast as R
from tidemark.operators import profile as P
from tidemark.operators import series as T
from tidemark.operators import vectors as V
from tidemark.operators.components import power_pca
from tidemark.plans.basic import FACTS, monthly, query_into, rounded, series_sql
from tidemark.sources.tables import facts, table

QUERIES, SQL = {}, {}


query = query_into(QUERIES, SQL)

KEY = ["region"]
REGION = series_sql("region")


def split(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = T.split_temporal(monthly(spark, sf), KEY)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


def held(spark, sf, months: int = 24) -> tuple[DataFrame, DataFrame]:
    s = T.split_last(monthly(spark, sf), KEY, months)
    return s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")


NAIVE = f"""{REGION}, split AS (SELECT *, k > floor(n * 0.7::DOUBLE) AS test, floor(n * 0.7::DOUBLE)::BIGINT AS m FROM numbered),
naive AS (SELECT a.region, a.ds, a.y, b.y AS yhat FROM split a JOIN split b ON a.region = b.region AND a.test AND b.k = a.m - 12 + 1 + (a.k - a.m - 1) % 12)"""


def naive_aligned(spark, sf) -> DataFrame:
    train, test = split(spark, sf)
    return T.align_actual_forecast(test, R.seasonal_naive(train, KEY, 24), KEY)


@query("o27_align_actual_forecast", f"WITH {NAIVE} SELECT region, ds::VARCHAR AS ds, round(y, 2) AS y, 'seasonal_naive' AS model, round(yhat, 2) AS yhat FROM naive")
def _(spark, sf):
    return rounded(naive_aligned(spark, sf), y=2, yhat=2)


def flagship(spark, sf) -> DataFrame:
    return rounded(P.forecast_errors(naive_aligned(spark, sf), KEY), mae=2, rmse=2, nrmse=6)


query("o53_forecast_errors", f"WITH {NAIVE} SELECT region, round(avg(abs(y - yhat)), 2) AS mae, round(sqrt(avg((y - yhat) ** 2)), 2) AS rmse, round(sqrt(avg((y - yhat) ** 2)) / avg(y), 6) AS nrmse FROM naive GROUP BY 1")(flagship)


@query("o85_seasonal_naive", f"WITH {NAIVE} SELECT region, ds::VARCHAR AS ds, round(yhat, 2) AS yhat FROM naive")
def _(spark, sf):
    return rounded(R.seasonal_naive(split(spark, sf)[0], KEY, 24).select("region", "ds", "yhat"), yhat=2)


_CENTRED = f"{REGION}, d AS (SELECT region, k, n, y - avg(y) OVER (PARTITION BY region) AS d FROM numbered)"
ACF = _CENTRED + """, acf AS (SELECT a.region, any_value(a.n) AS n, g.lag, coalesce(sum(a.d * b.d), 0) / any_value(v.v) AS r FROM range(1, 13) g(lag) CROSS JOIN d a
JOIN (SELECT region, sum(d * d) AS v FROM d GROUP BY 1) v ON v.region = a.region JOIN d b ON b.region = a.region AND b.k = a.k - g.lag GROUP BY 1, 3)"""


@query("o78_acf", f"WITH {ACF} SELECT region, lag, round(r, 6) AS r, n, round(1.96 / sqrt(n), 6) AS \"limit\" FROM acf")
def _(spark, sf):
    return rounded(D.acf(monthly(spark, sf), KEY, 12), r=6, limit=6)


@query("o79_pacf", f"""WITH RECURSIVE {ACF}, a AS (SELECT region, list(r ORDER BY lag) AS r FROM acf GROUP BY 1),
s AS (SELECT region, r, 1::BIGINT AS lag, [r[1]] AS phi, 1 - r[1] * r[1] AS v, r[1] AS pacf FROM a UNION ALL
  SELECT region, r, lag + 1, list_append(list_transform(range(1, lag + 1), lambda j: phi[j] - last * phi[lag + 1 - j]), last), v * (1 - last * last), last FROM (
    SELECT *, (r[lag + 1] - list_sum(list_transform(range(1, lag + 1), lambda j: phi[j] * r[lag + 1 - j]))) / v AS last FROM s WHERE lag < 12))
SELECT region, lag, round(pacf, 8) AS pacf FROM s""")
def _(spark, sf):
    return rounded(D.pacf(monthly(spark, sf), KEY, 12).withColumn("lag", F.col("lag").cast("long")), pacf=8)


@query("o80_adf_table")
def _(spark, sf):
    return rounded(D.adf_table(monthly(spark, sf, "country"), ["country"]), statistic=6, critical=6, p_value=6)


_TAIL = "exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6 + (q / 2) ** 4 / 24 + (q / 2) ** 5 / 120)"


@query("o81_ljung_box", f"WITH {ACF}, q AS (SELECT region, any_value(n) * (any_value(n) + 2) * sum(r * r / (n - lag)) AS q FROM acf GROUP BY 1) SELECT region, round(q, 4) AS q, round({_TAIL}, 6) AS p FROM q")
def _(spark, sf):
    return rounded(D.ljung_box(monthly(spark, sf), KEY), q=4, p=6)


DECOMPOSED = f"""{REGION}, t AS (SELECT *, CASE WHEN k > 6 AND k <= n - 6 THEN (sum(y) OVER (PARTITION BY region ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
  + (lag(y, 6) OVER (PARTITION BY region ORDER BY ds) + lead(y, 6) OVER (PARTITION BY region ORDER BY ds)) / 2) / 12 END AS trend FROM numbered),
m AS (SELECT region, month(ds) AS month, avg(y - trend) AS s FROM t GROUP BY 1, 2), c AS (SELECT region, avg(s) AS c FROM m GROUP BY 1),
parts AS (SELECT t.region, t.ds, t.y, t.trend, m.s - c.c AS seasonal, t.y - t.trend - (m.s - c.c) AS residual FROM t JOIN m ON m.region = t.region AND m.month = month(t.ds) JOIN c ON c.region = t.region)"""


@query("o82_decompose_additive", f"WITH {DECOMPOSED} SELECT region, ds::VARCHAR AS ds, round(trend, 1) AS trend, round(seasonal, 1) AS seasonal, round(residual, 1) AS residual FROM parts")
def _(spark, sf):
    return rounded(D.decompose_additive(monthly(spark, sf), KEY).drop("y"), trend=1, seasonal=1, residual=1)


@query("o83_seasonal_strength", f"WITH {DECOMPOSED} SELECT region, round(greatest(0, 1 - var_pop(residual) / var_pop(seasonal + residual)), 6) AS strength FROM parts WHERE residual IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return rounded(D.seasonal_strength(monthly(spark, sf), KEY), strength=6)


@query("o82_decompose_stl")
def _(spark, sf):
    return rounded(D.decompose_stl(monthly(spark, sf), KEY).drop("y"), trend=1, seasonal=1, residual=1)


@query("o83_stl_strength")
def _(spark, sf):
    return rounded(D.stl_strength(monthly(spark, sf), KEY), strength=6)


@query("o84_needs_transform", f"""WITH {REGION}, w AS (SELECT region, CASE WHEN k >= 12 THEN avg(y) OVER w END AS m, CASE WHEN k >= 12 THEN var_samp(y) OVER w END AS v FROM numbered
WINDOW w AS (PARTITION BY region ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT region, round(corr(m, v), 6) AS r, corr(m, v) > 0.5 AS transform FROM w GROUP BY 1""")
def _(spark, sf):
    return rounded(D.needs_transform(monthly(spark, sf), KEY), r=6)


@query("o86_ses", f"""WITH RECURSIVE {REGION}, tr AS (SELECT region, k, y FROM numbered WHERE k <= floor(n * 0.7::DOUBLE)), a AS (SELECT unnest([round(0.05 * i, 2)::DOUBLE FOR i IN range(1, 21)]) AS alpha),
s AS (SELECT region, alpha, 1::BIGINT AS k, y AS level, 0::DOUBLE AS sse FROM tr, a WHERE k = 1 UNION ALL
  SELECT s.region, s.alpha, s.k + 1, s.level + s.alpha * (tr.y - s.level), s.sse + (tr.y - s.level) ** 2 FROM s JOIN tr ON tr.region = s.region AND tr.k = s.k + 1),
f AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY region)), b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY region ORDER BY sse, alpha) = 1)
SELECT b.region, n.ds::VARCHAR AS ds, round(greatest(b.level, 0), 2) AS yhat FROM b JOIN numbered n ON n.region = b.region AND n.k > floor(n.n * 0.7::DOUBLE) AND n.k <= floor(n.n * 0.7::DOUBLE) + 12""")
def _(spark, sf):
    return rounded(R.ses(split(spark, sf)[0], KEY, 12).select("region", "ds", "yhat"), yhat=2)


_HW = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE, {p}::DOUBLE)" for a, b, g, p in R.HOLT_WINTERS_GRID)


@query("o87_holt_winters", f"""WITH RECURSIVE {REGION}, tr AS (SELECT region, k, y FROM numbered WHERE k <= floor(n * 0.7::DOUBLE)),
i AS (SELECT region, avg(y) FILTER (k <= 12) AS m1, avg(y) FILTER (k > 12 AND k <= 24) AS m2, list(y ORDER BY k) FILTER (k <= 12) AS first FROM tr GROUP BY 1),
s AS (SELECT region, a, b, g, phi, 12::BIGINT AS k, m1 AS level, (m2 - m1) / 12 AS trend, list_transform(first, lambda x: x - m1) AS season, 0::DOUBLE AS sse FROM i, (VALUES {_HW}) v(a, b, g, phi) UNION ALL
  SELECT region, a, b, g, phi, k + 1, l, phi * trend + b * (l - level - phi * trend), list_append(season[2:], season[1] + g * (y - l - season[1])), sse + (y - e - season[1]) ** 2 FROM (
    SELECT s.*, tr.y, level + phi * trend AS e, level + phi * trend + a * (tr.y - season[1] - (level + phi * trend)) AS l FROM s JOIN tr ON tr.region = s.region AND tr.k = s.k + 1)),
f AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY region)), best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY region ORDER BY sse, a, b, g, phi) = 1)
SELECT best.region, 'holt_winters' AS model, n.ds::VARCHAR AS ds, round(greatest(0, level + trend * phi * (1 - phi ** (n.k - best.k)) / (1 - phi) + season[(n.k - best.k - 1) % 12 + 1]), 2) AS yhat
FROM best JOIN numbered n ON n.region = best.region AND n.k > best.k AND n.k <= best.k + 24""")
def _(spark, sf):
    return rounded(R.holt_winters(split(spark, sf)[0], KEY, 24), yhat=2)


@query("o86_ses_search", f"""WITH RECURSIVE {REGION}, tr AS (SELECT region, k, y FROM numbered WHERE k <= floor(n * 0.7::DOUBLE)), a AS (SELECT unnest([round(0.05 * i, 2)::DOUBLE FOR i IN range(1, 21)]) AS alpha),
s AS (SELECT region, alpha, 1::BIGINT AS k, y AS level, 0::DOUBLE AS sse FROM tr, a WHERE k = 1 UNION ALL
  SELECT s.region, s.alpha, s.k + 1, s.level + s.alpha * (tr.y - s.level), s.sse + (tr.y - s.level) ** 2 FROM s JOIN tr ON tr.region = s.region AND tr.k = s.k + 1),
f AS (SELECT * FROM s QUALIFY k = max(k) OVER (PARTITION BY region)) SELECT region, round(min(sse) / 1e12, 6) AS grid_sse, true AS no_worse FROM f GROUP BY 1""")
def _(spark, sf):
    """The grid's error, and that the search never does worse."""
    found = R.ses_search(split(spark, sf)[0], KEY)
    return rounded(found.select("region", (F.col("grid_sse") / 1e12).alias("grid_sse"), (F.col("sse") <= F.col("grid_sse")).alias("no_worse")), grid_sse=6)


@query("o87_holt_winters_search")
def _(spark, sf):
    return rounded(R.holt_winters_search(split(spark, sf)[0], KEY), sse=0, grid_sse=0)


ORDERS = [(p, d, q) for d in (0, 1) for p in range(6) for q in range(6)]


@query("o88_arma_grid")
def _(spark, sf):
    return rounded(R.arma_grid(split(spark, sf)[0], KEY, ORDERS).drop("yhats"), loglik=4, aic=4, bic=4, p_value=6)


@query("o89_select_arma")
def _(spark, sf):
    return rounded(R.select_arma(R.arma_grid(split(spark, sf)[0], KEY, ORDERS, 24), KEY).drop("yhats"), loglik=4, aic=4, bic=4, p_value=6)


_FITS = f"""{FACTS}, t AS (SELECT country, count(*) AS n FROM facts GROUP BY 1), fits AS (SELECT country, p, 1::BIGINT AS d, q, ((n * (p + 2) + 13 * q) % 29)::DOUBLE AS aic, ((n * (q + 3) + 7 * p) % 11)::DOUBLE AS bic, ((n * 31 + 17 * p + 5 * q) % 100) / 400 AS p_value
  FROM t, range(0, 3) a(p), range(0, 3) b(q))"""


@query("o89_select_arma_rule", f"WITH {_FITS} SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY country ORDER BY (p_value <= 0.05)::INT, CASE WHEN p_value <= 0.05 THEN aic ELSE bic END, aic, p, d, q) = 1")
def _(spark, sf):
    """The rule of o89 by itself, over criteria derived from counts."""
    orders = spark.createDataFrame([(p, 1, q) for p in range(3) for q in range(3)], "p long, d long, q long")
    n = T.series_by_config(P.value_counts(facts(spark, sf), ["country"]), orders)
    criteria = {"aic": "n * (p + 2) + 13 * q", "bic": "n * (q + 3) + 7 * p", "p_value": "n * 31 + 17 * p + 5 * q"}
    aic, bic, p_value = (F.expr(f"cast(({x}) % {m} as double)") for x, m in zip(criteria.values(), (29, 11, 100)))
    return R.select_arma(n.select("country", "p", "d", "q", aic.alias("aic"), bic.alias("bic"), (p_value / 400).alias("p_value")), ["country"])


@query("o90_trend_fourier")
def _(spark, sf):
    return rounded(R.trend_fourier(split(spark, sf)[0], KEY, 24), yhat=2)


@query("o90_changepoint_trend")
def _(spark, sf):
    return rounded(R.changepoint_trend(split(spark, sf)[0], KEY, 24), yhat=2)


@query("o91_window_regressor_direct")
def _(spark, sf):
    return rounded(R.window_regressor_direct(held(spark, sf, 12)[0], KEY, 12), yhat=2)


@query("o92_window_regressor_recursive")
def _(spark, sf):
    return rounded(R.window_regressor_recursive(held(spark, sf, 12)[0], KEY, 12), yhat=2)


@query("o93_window_regressor_with_features")
def _(spark, sf):
    train = held(spark, sf, 12)[0]
    feats = X.distribution_features(train, KEY).select("region", "skew", "cv").join(X.acf_features(train, KEY), KEY)
    return rounded(R.window_regressor_with_features(train, feats, ["skew", "cv", "acf1", "acf2"], KEY, 12), yhat=2)


@query("o91_recurrent_direct")
def _(spark, sf):
    return rounded(R.recurrent_direct(held(spark, sf, 12)[0], KEY, 12), yhat=2)


@query("o92_recurrent_recursive")
def _(spark, sf):
    return rounded(R.recurrent_recursive(held(spark, sf, 12)[0], KEY, 12), yhat=2)


@query("o93_recurrent_with_features")
def _(spark, sf):
    train = held(spark, sf, 12)[0]
    feats = X.distribution_features(train, KEY).select("region", "skew", "cv").join(X.acf_features(train, KEY), KEY)
    return rounded(R.recurrent_with_features(train, feats, ["skew", "cv", "acf1", "acf2"], KEY, 12), yhat=2)


@query("o94_tune_on_validation")
def _(spark, sf):
    return rounded(R.tune_on_validation(held(spark, sf, 12)[0], KEY, [6, 12, 18]), rmse=2)


_ERRORS = """e AS (SELECT region, 'flat' AS model, avg(abs(y - 0)) AS mae, sqrt(avg(y * y)) AS rmse FROM naive GROUP BY 1
  UNION ALL SELECT region, 'seasonal_naive', avg(abs(y - yhat)), sqrt(avg((y - yhat) ** 2)) FROM naive GROUP BY 1)"""


@query("o95_compare_models", f"WITH {NAIVE}, {_ERRORS} SELECT region, model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, row_number() OVER (PARTITION BY region ORDER BY rmse, mae, model) = 1 AS best FROM e")
def _(spark, sf):
    train, test = split(spark, sf)
    naive = R.seasonal_naive(train, KEY, 24)
    flat = naive.withColumns({"model": F.lit("flat"), "yhat": F.lit(0.0)})
    return rounded(R.compare_models(test, T.union_tables(naive, flat), KEY).drop("nrmse"), mae=2, rmse=2)


@query("o95_compare_all_models")
def _(spark, sf):
    train, test = held(spark, sf, 12)
    arma = R.select_arma(R.arma_grid(train, KEY, ORDERS, 12), KEY)
    forecasts = T.union_tables(
        R.seasonal_naive(train, KEY, 12), R.ses(train, KEY, 12), R.holt_winters(train, KEY, 12), R._dated(arma, KEY, "arma"), R.trend_fourier(train, KEY, 12), R.window_regressor_recursive(train, KEY, 12)
    )
    return rounded(R.compare_models(test, forecasts, KEY), mae=2, rmse=2, nrmse=6)


COUNTRY, CKEY = series_sql("country"), ["country"]


@query("o96_distribution_features", f"""WITH {COUNTRY}, c AS (SELECT country, avg(y) AS m, quantile_cont(y, 0.5) AS md FROM series GROUP BY 1),
g AS (SELECT country, avg(y) AS m, stddev_pop(y) AS s FROM series GROUP BY 1)
SELECT s.country, round(avg(y), 4) AS mean, round(stddev_samp(y), 2) AS std, round(avg(((y - g.m) / g.s) ** 3), 6) AS skew, round(avg(((y - g.m) / g.s) ** 4) - 3, 6) AS kurtosis, round(avg(abs(y - c.m)), 2) AS mean_abs_dev,
round(quantile_cont(abs(y - c.md), 0.5), 4) AS median_abs_dev, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 4) AS iqr, round(stddev_samp(y) / abs(avg(y)), 6) AS cv
FROM series s JOIN c ON c.country = s.country JOIN g ON g.country = s.country GROUP BY s.country""")
def _(spark, sf):
    return rounded(X.distribution_features(monthly(spark, sf, "country"), CKEY), mean=4, std=2, skew=6, kurtosis=6, mean_abs_dev=2, median_abs_dev=4, iqr=4, cv=6)


@query("o97_acf_features", f"WITH {ACF} SELECT region, round(max(r) FILTER (lag = 1), 6) AS acf1, round(max(r) FILTER (lag = 2), 6) AS acf2 FROM acf GROUP BY 1")
def _(spark, sf):
    return rounded(X.acf_features(monthly(spark, sf), KEY), acf1=6, acf2=6)


@query("o98_peak_features", f"""WITH {COUNTRY}, r AS (SELECT country, ds, y FROM (SELECT *, lag(y) OVER (PARTITION BY country ORDER BY ds) AS p FROM series) WHERE p IS NULL OR p <> y),
q AS (SELECT country, y, lag(y) OVER w AS b, lead(y) OVER w AS a FROM r WINDOW w AS (PARTITION BY country ORDER BY ds))
SELECT country, count(*) FILTER (y > b AND y > a) AS n_peaks, round(avg(y) FILTER (y > b AND y > a), 3) AS peak_mean, round(stddev_samp(y) FILTER (y > b AND y > a), 2) AS peak_std FROM q GROUP BY 1""")
def _(spark, sf):
    return rounded(X.peak_features(monthly(spark, sf, "country"), CKEY), peak_mean=3, peak_std=2)


@query("o99_zero_crossing", f"""WITH {COUNTRY}, d AS (SELECT country, k, n, sign(y - avg(y) OVER (PARTITION BY country)) AS d FROM numbered), m AS (SELECT *, lead(d) OVER (PARTITION BY country ORDER BY k) AS e FROM d)
SELECT country, coalesce(min(k - 1) FILTER (e <> d), any_value(n))::DOUBLE AS zero_crossing FROM m GROUP BY 1""")
def _(spark, sf):
    return X.zero_crossing(monthly(spark, sf, "country"), CKEY)


@query("o100_spectral_features", f"""WITH {_CENTRED}, p AS (SELECT region, j, sum(d * cos(2 * pi() * j * (k - 1) / n)) ** 2 + sum(d * sin(2 * pi() * j * (k - 1) / n)) ** 2 AS p, any_value(n) AS n
  FROM d, range(1, 41) g(j) WHERE 2 * j <= n GROUP BY 1, 2), q AS (SELECT *, p / sum(p) OVER (PARTITION BY region) AS w FROM p)
SELECT region, round(max(p) / 1e6, 3) AS max_power_m, round(arg_max(j::DOUBLE / n, p), 8) AS dominant_freq, round(-sum(w * ln(w)), 6) AS spectral_entropy FROM q GROUP BY 1""")
def _(spark, sf):
    s = X.spectral_features(monthly(spark, sf), KEY).select("region", (F.col("max_power") / 1e6).alias("max_power_m"), "dominant_freq", "spectral_entropy")
    return rounded(s, max_power_m=3, dominant_freq=8, spectral_entropy=6)


_CLOSE = f"""{REGION}, sd AS (SELECT region, 0.2 * stddev_pop(y) AS r FROM series GROUP BY 1), x AS (SELECT region, k, n, y AS y0, lead(y, 1) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM numbered WINDOW w AS (PARTITION BY region ORDER BY k)),
c AS (SELECT a.region, a.k, count(*) FILTER (a.k < a.n AND b.k < b.n AND abs(a.y0 - b.y0) <= r AND abs(a.y1 - b.y1) <= r) AS c2,
  count(*) FILTER (a.k < a.n - 1 AND b.k < b.n - 1 AND abs(a.y0 - b.y0) <= r AND abs(a.y1 - b.y1) <= r AND abs(a.y2 - b.y2) <= r) AS c3, any_value(a.n) AS n
  FROM x a JOIN x b ON a.region = b.region JOIN sd ON sd.region = a.region GROUP BY 1, 2)"""


@query("o101_entropy_features", f"""WITH {_CLOSE} SELECT region, round(avg(ln(c2::DOUBLE / (n - 1))) FILTER (k < n) - avg(ln(c3::DOUBLE / (n - 2))) FILTER (k < n - 1), 6) AS approximate_entropy,
CASE WHEN sum(c3 - 1) FILTER (k < n - 1) > 0 AND sum(c2 - 1) FILTER (k < n) > 0 THEN round(-ln((sum(c3 - 1) FILTER (k < n - 1))::DOUBLE / (sum(c2 - 1) FILTER (k < n))), 6) END AS sample_entropy FROM c GROUP BY 1""")
def _(spark, sf):
    return rounded(X.entropy_features(monthly(spark, sf), KEY), approximate_entropy=6, sample_entropy=6)


@query("o102_histogram_entropy", f"""WITH {COUNTRY}, b AS (SELECT country, min(y) AS lo, max(y) AS hi FROM series GROUP BY 1),
h AS (SELECT country, least(floor((y - lo) * 10 / (hi - lo)), 9) AS bin, count(*) AS n FROM series JOIN b USING (country) GROUP BY 1, 2), p AS (SELECT country, n / sum(n) OVER (PARTITION BY country) AS p FROM h)
SELECT country, round(-sum(p * ln(p)), 6) AS histogram_entropy FROM p GROUP BY 1""")
def _(spark, sf):
    return rounded(X.histogram_entropy(monthly(spark, sf, "country"), CKEY), histogram_entropy=6)


def _scales(least: int) -> str:
    step = f"(log10(n // 4) - log10({least})) / 9"
    return f"""sc AS (SELECT region, n, unnest(list_distinct([floor(pow(10::DOUBLE, log10({least}) + i * {step}) + 1e-9)::BIGINT FOR i IN range(10)])) AS scale FROM (SELECT DISTINCT region, n FROM numbered WHERE n >= 10)),
scales AS (SELECT region, scale FROM sc WHERE scale >= 2 AND n // scale >= 2)"""


@query("o103_dfa", f"""WITH {REGION}, {_scales(4)}, prof AS (SELECT region, k - 1 AS t, n, sum(d) OVER (PARTITION BY region ORDER BY k) AS c FROM (SELECT *, y - avg(y) OVER (PARTITION BY region) AS d FROM numbered)),
g AS (SELECT region, scale, t // scale AS seg, regr_syy(c, t % scale) - coalesce(regr_sxy(c, t % scale) * regr_slope(c, t % scale), 0) AS sse FROM prof JOIN scales USING (region) WHERE t // scale < n // scale GROUP BY 1, 2, 3),
f AS (SELECT region, scale, avg(sqrt(greatest(sse, 0) / scale)) AS f FROM g GROUP BY 1, 2)
SELECT region, round(regr_slope(ln(f), ln(scale)), 6) AS dfa FROM f WHERE f > 0 GROUP BY 1""")
def _(spark, sf):
    return rounded(X.dfa_exponent(monthly(spark, sf), KEY), dfa=6)


@query("o103_hurst", f"""WITH {REGION}, {_scales(1)}, g AS (SELECT region, scale, (k - 1) // scale AS seg, (k - 1) % scale AS i, y FROM numbered JOIN scales USING (region) WHERE (k - 1) // scale < n // scale),
d AS (SELECT *, y - avg(y) OVER (PARTITION BY region, scale, seg) AS d FROM g), c AS (SELECT *, sum(d) OVER (PARTITION BY region, scale, seg ORDER BY i) AS c FROM d),
r AS (SELECT region, scale, seg, max(c) - min(c) AS range, stddev_samp(y) AS s FROM c GROUP BY 1, 2, 3), a AS (SELECT region, scale, avg(range / s) AS rs FROM r WHERE s > 0 GROUP BY 1, 2)
SELECT region, round(regr_slope(ln(rs), ln(scale)), 6) AS hurst FROM a WHERE rs > 0 GROUP BY 1""")
def _(spark, sf):
    return rounded(X.hurst_exponent(monthly(spark, sf), KEY), hurst=6)


_Z = f"{REGION}, z AS (SELECT region, k, n, (y - avg(y) OVER (PARTITION BY region)) / stddev_samp(y) OVER (PARTITION BY region) AS z FROM numbered)"


@query("o104_canonical_features", f"""WITH {_Z},
s AS (SELECT region, max(l) AS l FROM (SELECT region, count(*) AS l FROM (SELECT region, k, k - row_number() OVER (PARTITION BY region ORDER BY k) AS g FROM z WHERE z >= 0) GROUP BY region, g) GROUP BY 1),
e AS (SELECT region, stddev_samp(CASE WHEN k > 3 THEN z - m END) AS e FROM (SELECT *, avg(z) OVER (PARTITION BY region ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM z) GROUP BY 1),
c AS (SELECT region, quantile_cont(z, 1 / 3::DOUBLE) AS c1, quantile_cont(z, 2 / 3::DOUBLE) AS c2 FROM z GROUP BY 1),
a AS (SELECT region, k, CASE WHEN z <= c1 THEN 0 WHEN z <= c2 THEN 1 ELSE 2 END AS a FROM z JOIN c USING (region)), p AS (SELECT region, a, lead(a) OVER (PARTITION BY region ORDER BY k) AS b FROM a),
q AS (SELECT region, count(*) / sum(count(*)) OVER (PARTITION BY region) AS p FROM p WHERE b IS NOT NULL GROUP BY region, a, b), m AS (SELECT region, -sum(p * ln(p)) AS m FROM q GROUP BY 1)
SELECT region, l::DOUBLE AS longstretch1, round(e, 6) AS mean3_stderr, round(m, 6) AS motif3_hh FROM s JOIN e USING (region) JOIN m USING (region)""")
def _(spark, sf):
    return rounded(X.canonical_features(monthly(spark, sf), KEY).select("region", "longstretch1", "mean3_stderr", "motif3_hh"), mean3_stderr=6, motif3_hh=6)


_ACF40 = ACF.replace("range(1, 13)", "range(1, 41)")
_MORE = f"""{_ACF40}, lagged AS (SELECT *, coalesce(lag(r) OVER w, 1) AS before, lead(r) OVER w AS after, -0.5 * ln(greatest(1 - r * r, 1e-12)) AS ami FROM acf WINDOW w AS (PARTITION BY region ORDER BY lag)),
ami AS (SELECT *, lag(ami) OVER w AS ab, lead(ami) OVER w AS aa FROM lagged WINDOW w AS (PARTITION BY region ORDER BY lag)),
ac AS (SELECT region, coalesce(min(lag - 1 + (before - exp(-1)) / (before - r)) FILTER (r < exp(-1) AND before >= exp(-1)), 40) AS f1ecac, coalesce(min(lag) FILTER (r < before AND r < after), 40)::DOUBLE AS first_min_ac,
  coalesce(min(lag) FILTER (ami < ab AND ami < aa), 40)::DOUBLE AS fmmi FROM ami GROUP BY 1),
zz AS (SELECT region, d / (SELECT stddev_samp(x.d) FROM d x WHERE x.region = d.region) AS z FROM d), zb AS (SELECT region, min(z) AS lo, max(z) AS hi FROM zz GROUP BY 1),
zh AS (SELECT region, lo, hi, least(floor((z - lo) * 10 / (hi - lo)), 9) AS bin, count(*) AS n FROM zz JOIN zb USING (region) GROUP BY 1, 2, 3, 4),
mo AS (SELECT region, lo + (bin + 0.5) * (hi - lo) / 10 AS mode_10 FROM zh QUALIFY row_number() OVER (PARTITION BY region ORDER BY n DESC, bin) = 1)"""
SQL["o104_canonical_features_all"] = f"""SELECT * FROM ({SQL["o104_canonical_features"]}) JOIN (WITH {_MORE} SELECT region, round(f1ecac, 6) AS f1ecac, first_min_ac, fmmi, round(mode_10, 6) AS mode_10 FROM ac JOIN mo USING (region)) USING (region)"""


@query("o104_canonical_features_all", SQL["o104_canonical_features_all"])
def _(spark, sf):
    return rounded(X.canonical_features(monthly(spark, sf), KEY), f1ecac=6, mean3_stderr=6, mode_10=6, motif3_hh=6)


def _by_region(sql: str) -> str:
    """SQL over series of countries as SQL over series of regions."""
    return sql.replace("country", "region").replace(COUNTRY.replace("country", "region"), REGION) if COUNTRY in sql else sql


_PARTS = [SQL[f"o{x}"] for x in ("96_distribution_features", "97_acf_features", "98_peak_features", "99_zero_crossing", "100_spectral_features", "101_entropy_features", "102_histogram_entropy", "103_dfa", "103_hurst", "104_canonical_features_all")]
_WIDE = "SELECT * FROM " + " JOIN ".join(f"({_by_region(x)})" + (" USING (region)" if i else "") for i, x in enumerate(_PARTS))


@query("o105_feature_matrix", _WIDE)
def _(spark, sf):
    df = X.feature_matrix(monthly(spark, sf), KEY).withColumn("max_power_m", F.col("max_power") / 1e6).drop("max_power")
    digits = {"mean": 4, "std": 2, "mean_abs_dev": 2, "median_abs_dev": 4, "iqr": 4, "peak_mean": 3, "peak_std": 2, "max_power_m": 3, "dominant_freq": 8}
    return rounded(df, **{c: digits.get(c, 6) for c in df.columns if c not in ("region", "n_peaks")})


def vectors(spark, sf, least: int = 0, most: int = 1 << 62) -> DataFrame:
    df = table(spark, sf, "embeddings").where(F.col("vec_id").between(least, most))
    return df.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


CENTROIDS = """cent AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2),
pairs AS (SELECT a.label AS label_a, b.label AS label_b, sqrt(sum((a.m - b.m) ** 2)) AS distance, 1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS cosine
  FROM cent a JOIN cent b ON a.pos = b.pos AND a.label < b.label GROUP BY 1, 2)"""


@query("o30_unordered_pairs", "SELECT a.n_name AS n_name_a, b.n_name AS n_name_b, a.n_regionkey::BIGINT AS n_regionkey_a, b.n_regionkey::BIGINT AS n_regionkey_b, a.n_nationkey::BIGINT AS n_nationkey_a, b.n_nationkey::BIGINT AS n_nationkey_b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    return rounded(V.unordered_pairs(table(spark, sf, "nation"), "n_nationkey", ["n_name", "n_regionkey"]))


@query("o57_centroids", f"WITH {CENTROIDS} SELECT label::BIGINT AS label, pos - 1 AS pos, round(m, 8) AS m FROM cent")
def _(spark, sf):
    return rounded(V.centroids(vectors(spark, sf), "label", "v").select("label", F.posexplode("centroid").alias("pos", "m")), m=8)


@query("o58_percentile_of_pair", f"WITH {CENTROIDS} SELECT label_a::BIGINT AS label_a, label_b::BIGINT AS label_b, round(distance, 6) AS distance, round((rank() OVER (ORDER BY distance) - 1) / count(*) OVER (), 6) AS closer FROM pairs")
def _(spark, sf):
    return rounded(V.class_similarity(vectors(spark, sf), "label", "v"), distance=6, closer=6)


@query("o112_class_similarity", f"""WITH {CENTROIDS}, b AS (SELECT label_a AS label, label_b AS other, cosine FROM pairs UNION ALL SELECT label_b, label_a, cosine FROM pairs)
SELECT label::BIGINT AS label, arg_min(other, cosine)::BIGINT AS closest, round(min(cosine), 6) AS distance FROM b GROUP BY 1""")
def _(spark, sf):
    """The most similar class of every class, by the cosine of centroids."""
    pairs = V.class_similarity(vectors(spark, sf), "label", "v", "cosine")
    both = pairs.select(F.col("label_a").alias("label"), F.col("label_b").alias("closest"), "distance").union(pairs.select("label_b", "label_a", "distance"))
    return rounded(T.best_per_group(both, ["label"], ["distance", "closest"]), distance=6)


@query("o110_pairwise_distance", f"WITH {CENTROIDS} SELECT label_a::BIGINT AS label_a, label_b::BIGINT AS label_b, round(cosine, 6) AS distance FROM pairs")
def _(spark, sf):
    return rounded(V.pairwise_distance(V.centroids(vectors(spark, sf), "label", "v"), "label", "centroid", "cosine"), distance=6)


@query("o111_most_atypical", f"WITH {CENTROIDS}, b AS (SELECT label_a AS label, distance FROM pairs UNION ALL SELECT label_b, distance FROM pairs) SELECT label::BIGINT AS label, round(avg(distance), 6) AS mean_distance FROM b GROUP BY 1")
def _(spark, sf):
    return rounded(V.most_atypical(V.pairwise_distance(V.centroids(vectors(spark, sf), "label", "v"), "label", "centroid"), "label"), mean_distance=6)


@query("o111_nearest_farthest", f"WITH {CENTROIDS} (SELECT label_a::BIGINT AS label_a, label_b::BIGINT AS label_b, round(distance, 6) AS distance, 'nearest' AS kind FROM pairs ORDER BY distance LIMIT 1) UNION ALL (SELECT label_a, label_b, round(distance, 6), 'farthest' FROM pairs ORDER BY distance DESC LIMIT 1)")
def _(spark, sf):
    return rounded(V.nearest_farthest(V.pairwise_distance(V.centroids(vectors(spark, sf), "label", "v"), "label", "centroid"), "label"), distance=6)


_GAP = "list_sum(list_transform(list_zip(embedding, nxt), lambda x: abs(x[1]::DOUBLE - x[2]))) / len(embedding)"


@query("o67_adjacent_vs_distant", f"""WITH a AS (SELECT label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings), b AS (SELECT label, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY (vec_id * 7919 + 7) % 104729, vec_id) AS nxt FROM embeddings)
SELECT x.label::BIGINT AS label, round(adjacent, 6) AS adjacent, round(distant, 6) AS distant FROM (SELECT label, avg({_GAP}) AS adjacent FROM a WHERE nxt IS NOT NULL GROUP BY 1) x JOIN (SELECT label, avg({_GAP}) AS distant FROM b WHERE nxt IS NOT NULL GROUP BY 1) y ON x.label = y.label""")
def _(spark, sf):
    return rounded(V.adjacent_vs_distant(vectors(spark, sf), "label", "vec_id", "v"), adjacent=6, distant=6)


def _region_vectors(spark, sf) -> DataFrame:
    """Each country's share of every month as a vector, with its region as label."""
    s = monthly(spark, sf, "country")
    arrays = T.as_arrays(s, ["country"]).select("country", F.transform("ys", lambda y: y / 1e6).alias("v"))
    return arrays.join(facts(spark, sf).select("country", "region").distinct(), "country")


@query("o68_silhouette", f"""WITH {series_sql('country')}, l AS (SELECT DISTINCT country, region FROM facts), d AS (SELECT a.country, b.country AS other, sqrt(sum((a.y / 1e6 - b.y / 1e6) ** 2)) AS d FROM series a JOIN series b ON a.ds = b.ds AND a.country <> b.country GROUP BY 1, 2),
m AS (SELECT d.country, x.region, y.region AS c, avg(d) AS d FROM d JOIN l x ON x.country = d.country JOIN l y ON y.country = d.other GROUP BY 1, 2, 3),
s AS (SELECT country, region, max(d) FILTER (c = region) AS own, min(d) FILTER (c <> region) AS other FROM m GROUP BY 1, 2)
SELECT country, region, round(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END, 6) AS silhouette FROM s""")
def _(spark, sf):
    return rounded(V.silhouette(_region_vectors(spark, sf), "country", "v", "region"), silhouette=6)


@query("o75_sample_per_class", "SELECT vec_id, label::BIGINT AS label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7'), vec_id) <= 10")
def _(spark, sf):
    return rounded(V.sample_per_class(vectors(spark, sf), "label", "vec_id", 10).select("vec_id", "label"))


@query("o76_stratified_split", """SELECT vec_id, label::BIGINT AS label, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7'), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)""")
def _(spark, sf):
    return rounded(V.stratified_split(vectors(spark, sf), "label", "vec_id").select("vec_id", "label", "split"))


_MARK = "('0x' || substr(md5(label || ':' || (vec_id // 20) || ':7'), 1, 8))::BIGINT % 100"


@query("o77_block_split", f"SELECT vec_id, label::BIGINT AS label, vec_id // 20 AS block, CASE WHEN {_MARK} < 70 THEN 'train' WHEN {_MARK} < 85 THEN 'val' ELSE 'test' END AS split FROM embeddings")
def _(spark, sf):
    return rounded(V.block_split(vectors(spark, sf), "label", "vec_id", 20).select("vec_id", "label", "block", "split"))


def _standard_features(spark, sf) -> tuple[DataFrame, list[str]]:
    feats = X.distribution_features(monthly(spark, sf, "country"), CKEY).join(X.acf_features(monthly(spark, sf, "country"), CKEY), CKEY)
    columns = [c for c in feats.columns if c != "country"]
    return S.zscore_columns(feats, columns), columns


@query("o106_pca_scores")
def _(spark, sf):
    return rounded(V.pca(*(lambda d, c: (d, "country", c, 2))(*_standard_features(spark, sf)))[0], score=6)


@query("o106_pca_variance")
def _(spark, sf):
    return rounded(V.pca(*(lambda d, c: (d, "country", c, 2))(*_standard_features(spark, sf)))[1], explained=8, cumulative=8)


@query("o106_power_scores")
def _(spark, sf):
    """The same components without a matrix of all columns."""
    df, columns = _standard_features(spark, sf)
    return rounded(power_pca(df.select("country", F.array(*columns).alias("v")), "country", "v", 2)[0], score=6)


@query("o107_top_loadings")
def _(spark, sf):
    loadings = V.pca(*(lambda d, c: (d, "country", c, 2))(*_standard_features(spark, sf)))[2]
    return rounded(V.top_loadings(loadings, 3), loading=6)


@query("o108_kmeans")
def _(spark, sf):
    return rounded(V.best_k(V.kmeans(_region_vectors(spark, sf), "country", "v", [2, 3, 4])), inertia=4, silhouette=6)


@query("o109_bisecting_groups")
def _(spark, sf):
    return rounded(V.best_k(V.bisecting_groups(_region_vectors(spark, sf), "country", "v", [2, 3, 4])), inertia=4, silhouette=6)


@query("o109_hierarchical_groups")
def _(spark, sf):
    return rounded(V.best_k(V.hierarchical_groups(_region_vectors(spark, sf), "country", "v", [2, 3, 4])), inertia=4, silhouette=6)


def _ward_sql(steps: int = 24) -> str:
    """The one-by-one procedure: in every step the nearest two of all clusters become one."""
    parts = [f"{series_sql('country')}", "c0 AS MATERIALIZED (SELECT country AS name, 1::BIGINT AS size, list(y / 1e6 ORDER BY ds) AS v, [country] AS members FROM series GROUP BY 1)"]
    for i in range(steps):
        parts.append(
            f"m{i} AS MATERIALIZED (SELECT a.name AS a, b.name AS b, sqrt(2.0 * a.size * b.size / (a.size + b.size) * list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS height, a.size + b.size AS size, "
            f"list_transform(list_zip(a.v, b.v), lambda z: (a.size * z[1] + b.size * z[2]) / (a.size + b.size)) AS v, list_concat(a.members, b.members) AS members FROM c{i} a JOIN c{i} b ON a.name < b.name ORDER BY height, a, b LIMIT 1),"
            f"c{i + 1} AS MATERIALIZED (SELECT c.* FROM c{i} c WHERE NOT EXISTS (SELECT 1 FROM m{i} m WHERE c.name = m.a OR c.name = m.b) UNION ALL SELECT a, size, v, members FROM m{i})"
        )
    return "WITH " + ", ".join(parts)


_WARD = _ward_sql()


@query("o109_ward_merges", f"{_WARD} " + " UNION ALL ".join(f"SELECT a, b, round(height, 6) AS height, size FROM m{i}" for i in range(24)))
def _(spark, sf):
    return rounded(V.ward_linkage(_region_vectors(spark, sf), "country", "v"), height=6)


@query("o109_ward_groups", f"{_WARD}, " + "s AS (" + " UNION ALL ".join(f"SELECT *, (SELECT count(*) FROM c{i}) AS k FROM c{i}" for i in range(25)) + """)
SELECT unnest(members) AS country, k, cluster FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY name) - 1 AS cluster FROM s WHERE k BETWEEN 2 AND 4)""")
def _(spark, sf):
    vectors = _region_vectors(spark, sf)
    return rounded(V.cut_linkage(V.ward_linkage(vectors, "country", "v"), vectors, "country", [2, 3, 4]).drop("inertia"))


_KNN = """d AS (SELECT a.vec_id, a.label, b.vec_id AS other, b.label AS l, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM d QUALIFY r <= 3), v AS (SELECT vec_id, label, l, count(*) AS n, min(r) AS first FROM t GROUP BY 1, 2, 3),
knn AS (SELECT vec_id, label, l AS prediction FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, first) = 1)"""


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = vectors(spark, sf)
    return v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0")


def _knn(spark, sf) -> DataFrame:
    return V.knn_classify(*_parts(spark, sf), "vec_id", "label", "v")


@query("o113_knn_classify", f"WITH {_KNN} SELECT vec_id, label::BIGINT AS label, prediction::BIGINT AS prediction FROM knn")
def _(spark, sf):
    return rounded(_knn(spark, sf))


@query("o113_knn_probed")
def _(spark, sf):
    """Predictions within 12 of 16 lists: these vectors have no clusters, so that fewer lists would lose neighbours."""
    return rounded(V.knn_classify_probed(*_parts(spark, sf), "vec_id", "label", "v", lists=16, probes=12))


@query("o114_dense_classifier")
def _(spark, sf):
    return V.dense_classifier(*_parts(spark, sf), "vec_id", "label", "v", [64, 24, 10])


@query("o115_margin_classifier")
def _(spark, sf):
    return V.margin_classifier(*_parts(spark, sf), "vec_id", "label", "v", 16)


@query("o114_rectified_classifier")
def _(spark, sf):
    return V.rectified_classifier(*_parts(spark, sf), "vec_id", "label", "v")


@query("o115_kernel_margin_classifier")
def _(spark, sf):
    return V.kernel_margin_classifier(*_parts(spark, sf), "vec_id", "label", "v", 16)


@query("o116_tune_grid")
def _(spark, sf):
    train, test = _parts(spark, sf)
    return V.tune_grid(train.where("vec_id % 5 <> 1"), train.where("vec_id % 5 = 1"), "vec_id", "label", "v", [8, 16], [0.01, 0.1])


@query("o117_classification_report", f"""WITH {_KNN}, c AS (SELECT label AS c FROM knn UNION SELECT prediction FROM knn), r AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (label = c AND prediction = c) AS hit, count(*) FILTER (prediction = c) AS said FROM c, knn GROUP BY c)
SELECT c::BIGINT AS label, support, round(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 6) AS recall, round(2.0 * hit / (said + support), 6) AS f1,
round(sum(hit) OVER () / sum(support) OVER (), 6) AS accuracy, round(avg(2.0 * hit / (said + support)) OVER (), 6) AS macro_f1, round(1 / count(*) OVER (), 6) AS chance FROM r""")
def _(spark, sf):
    return rounded(V.classification_report(_knn(spark, sf), "label"), precision=6, recall=6, f1=6, accuracy=6, macro_f1=6, chance=6)


@query("o118_compute_split_constants", f"WITH {REGION} SELECT region, ds::VARCHAR AS ds, k > floor(n * 0.7::DOUBLE) AS held, round((y - avg(y) FILTER (k <= floor(n * 0.7::DOUBLE)) OVER (PARTITION BY region)) / stddev_pop(y) FILTER (k <= floor(n * 0.7::DOUBLE)) OVER (PARTITION BY region), 6) AS z FROM numbered")
def _(spark, sf):
    s = T.split_temporal(monthly(spark, sf), KEY)
    z = S.zscore(s, S.zscore_constants(s.where("split = 'train'"), KEY), KEY)
    return rounded(z.select("region", "ds", (F.col("split") == "test").alias("held"), "z"), z=6)
