"""Models that SQL cannot express, against plain forms, exact optima and planted data."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_operators import K, ar1, make, month, noise, seasonal
from tidemark.functions import scalar as S
from tidemark.operators import arma as A
from tidemark.operators import components as C
from tidemark.operators import diagnostics as D
from tidemark.operators import features as X
from tidemark.operators import forecast as R
from tidemark.operators import linkage as L
from tidemark.operators import networks as N
from tidemark.operators import profile as P
from tidemark.operators import vectors as V


@pytest.mark.parametrize("kind", ["recurrent", "dense"])
def test_gradients_equal_finite_differences(kind):
    r = np.random.default_rng(1)
    net = N.Recurrent(4, 3, 2, extras=1) if kind == "recurrent" else N.Dense([5, 6, 4, 3], dropout=0.0)
    x, y = r.normal(size=(7, 5)), r.normal(size=(7, 2)) if kind == "recurrent" else r.integers(0, 3, (7, 1)).astype(float)
    flat = net.start(3) + 0.1 * r.normal(size=net.size)
    loss, gradient = net.gradient(flat, x, y)
    assert loss == pytest.approx(net.loss(flat, x, y))
    for i in range(net.size):
        h = np.zeros(net.size)
        h[i] = 1e-6
        assert gradient[i] == pytest.approx((net.loss(flat + h, x, y) - net.loss(flat - h, x, y)) / 2e-6, abs=1e-6, rel=1e-5)


def bent(n, seed):
    """A series whose next value is a tent of the one two before: no linear model follows it."""
    x = list(np.random.default_rng(seed).uniform(0.2, 0.8, 2))
    for _ in range(n - 2):
        x.append(0.1 + 0.85 * (1 - abs(2 * x[-2] - 1)) * 0.95)
    return [math.expm1(2 * v) for v in x]


def test_recurrent_network_beats_the_linear_model(spark):
    whole = {f"s{i}": bent(121, i) for i in range(8)}
    train = make(spark, **{k: v[:-1] for k, v in whole.items()}).cache()
    how = {"lookback": 4, "hidden": 16, "epochs": 24, "batches": 2, "rate": 0.03}
    error = lambda f: np.sqrt(np.mean([(math.log1p(r["yhat"]) - math.log1p(whole[r["series_id"]][120])) ** 2 for r in f.collect()]))
    linear, recurrent = error(R.window_regressor_direct(train, K, 1, 4)), error(R.recurrent_direct(train, K, 1, **how))
    assert recurrent < 0.7 * linear


def test_recurrent_forms_run_and_repeat(spark):
    train = make(spark, a=seasonal(), b=ar1(90), c=[1.0] * 5)
    how = {"lookback": 6, "hidden": 3, "epochs": 2, "batches": 2}
    first = R.recurrent_recursive(train, K, 5, **how).orderBy("series_id", "ds").collect()
    assert len(first) == 10 and min(r["ds"] for r in first if r["series_id"] == "a") == month(120)
    assert first == R.recurrent_recursive(train.repartition(5), K, 5, **how).orderBy("series_id", "ds").collect()
    features = train.groupBy("series_id").agg((F.avg("y") / 100).alias("level"), F.lit(None).cast("double").alias("none"))
    assert R.recurrent_with_features(train, features, ["level", "none"], K, 3, **how).count() == 6


def test_validation_keeps_the_best_parameters(spark):
    rows = spark.createDataFrame([(i, [i / 10.0, 1.0], [2.0 * i], i % 4 == 0) for i in range(40)], "id int, x array<double>, y array<double>, valid boolean")
    net = N.Recurrent(2, 2, 1)
    flat, losses = N.train(N.prepared(rows, ["id"], "x", "y", "valid"), net, net.start(1), epochs=3, batches=2, rate=0.5)
    held = rows.where("valid").collect()
    assert net.loss(flat, np.array([r["x"] for r in held]), np.array([r["y"] for r in held])) / len(held) == pytest.approx(min(losses), rel=1e-6)


def autocovariance(phi, theta, variance, n, m=4000):
    psi = np.zeros(m)
    psi[0] = 1
    for j in range(1, m):
        psi[j] = (theta[j - 1] if j <= len(theta) else 0) + sum(phi[i] * psi[j - 1 - i] for i in range(len(phi)) if j > i)
    return np.array([psi[: m - k] @ psi[k:] for k in range(n)]) * variance


def dense_loglik(z, phi, theta, mean, variance):
    c = autocovariance(phi, theta, variance, len(z))[np.abs(np.subtract.outer(np.arange(len(z)), np.arange(len(z))))]
    e = z - mean
    return -0.5 * (len(z) * math.log(2 * math.pi) + np.linalg.slogdet(c)[1] + e @ np.linalg.solve(c, e))


def test_arma_likelihood_is_the_dense_gaussian_one():
    fits = A.fit_orders(np.array(ar1(80)), 0, [(p, q) for p in range(3) for q in range(3)], 1)
    assert len(fits) == 9 and {len(f["sample"]) for f in fits} == {79}
    value = {(f["p"], f["q"]): f["loglik"] for f in fits}
    for f in fits:
        roots = np.roots([*(-f["phi"][::-1]), 1.0]) if len(f["phi"]) else np.array([9.0])
        if np.abs(roots).min() > 1.02:
            assert dense_loglik(f["sample"], f["phi"], f["theta"], f["mean"], f["variance"]) == pytest.approx(f["loglik"], abs=1e-8)
        k = f["p"] + f["q"] + 2
        assert f["aic"] == pytest.approx(2 * k - 2 * f["loglik"]) and f["bic"] == pytest.approx(k * math.log(79) - 2 * f["loglik"])
        for inner in ((f["p"] - 1, f["q"]), (f["p"], f["q"] - 1)):
            assert value.get(inner, -1e9) <= f["loglik"] + 1e-6


def test_arma_maximum_is_that_of_a_fine_search():
    y = np.array(ar1(150))
    fit = A.fit_orders(y, 0, [(1, 1)], 0)[0]
    z = (y - y.mean()) / y.std()
    best = max(A.kalman(z, np.array([[a]]), np.array([[b]]), True)["loglik"][0] for a in np.linspace(-0.95, 0.95, 77) for b in np.linspace(-0.95, 0.95, 77))
    assert fit["loglik"] >= best - 150 * math.log(y.std()) - 1e-6


def test_arma_recovers_and_forecasts():
    fit = A.fit_orders(np.array(ar1(2000)), 0, [(1, 0)], 0, 50)[0]
    assert abs(fit["phi"][0] - 0.6) < 0.05 and abs(fit["mean"] - 50) < 0.3 and abs(fit["ahead"][-1] - fit["mean"]) < 0.01
    walk = np.cumsum(noise(300) + 0.0)
    ahead = A.fit_orders(walk, 1, [(0, 0)], 1, 3)[0]
    assert np.allclose(ahead["ahead"], walk[-1]) and ahead["loglik"] == pytest.approx(-0.5 * 299 * (math.log(2 * math.pi * np.mean(np.diff(walk) ** 2)) + 1))
    assert A.fit_orders(np.ones(50), 0, [(1, 0)], 0) == [] and A.fit_orders(np.arange(4.0), 0, [(1, 0)], 0) == []


def test_arma_grid_rows(spark):
    fits = R.arma_grid(make(spark, a=ar1(90), c=[5.0] * 90, s=[1.0, 2.0]), K, [(p, d, q) for p in (0, 1) for d in (0, 1) for q in (0, 1)], 4).collect()
    assert sorted((r["series_id"], r["p"], r["d"], r["q"]) for r in fits) == [("a", p, d, q) for p in (0, 1) for d in (0, 1) for q in (0, 1)]
    assert all(len(r["yhats"]) == 4 for r in fits)


def plain_ward(rows):
    clusters = {k: (1, np.array(v, float)) for k, v in rows}
    out = []
    while len(clusters) > 1:
        h, a, b = min((math.sqrt(2 * s * t / (s + t) * float(((v - w) ** 2).sum())), a, b) for (a, (s, v)), (b, (t, w)) in itertools.combinations(sorted(clusters.items()), 2))
        (s, v), (t, w) = clusters.pop(a), clusters.pop(b)
        clusters[a] = s + t, (s * v + t * w) / (s + t)
        out.append((a, b, h, s + t))
    return out


def test_ward_merges_equal_the_one_by_one_procedure(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=3).tolist()) for i in range(40)]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "id long, v array<double>, size string")
    old, L.BLOCK_ROWS = L.BLOCK_ROWS, 16
    try:
        merges = sorted(((m["a"], m["b"], m["height"], m["size"]) for m in L.ward_linkage(df, "id", "v").collect()), key=lambda m: m[2])
    finally:
        L.BLOCK_ROWS = old
    wanted = plain_ward(rows)
    assert [(a, b, s) for a, b, _, s in merges] == [(a, b, s) for a, b, _, s in wanted] and np.allclose([m[2] for m in merges], [m[2] for m in wanted])
    cut = L.cut_linkage(L.ward_linkage(df, "id", "v"), df, "id", [1, 2, 5, 40]).collect()
    for k in (1, 2, 5, 40):
        names = {i: i for i, _ in rows}
        for a, b, *_ in wanted[: 40 - k]:
            names = {i: a if n == b else n for i, n in names.items()}
        order = {n: i for i, n in enumerate(sorted(set(names.values())))}
        assert {c["id"]: c["cluster"] for c in cut if c["k"] == k} == {i: order[n] for i, n in names.items()}
        inside = sum(float(((np.array([v for i, v in rows if names[i] == n]) - np.mean([v for i, v in rows if names[i] == n], axis=0)) ** 2).sum()) for n in order)
        assert next(c["inertia"] for c in cut if c["k"] == k) == pytest.approx(inside)


def test_ward_of_copies_and_of_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0]) for i in range(7)] + [(9, [4.0])], "id long, v array<double>")
    merges = L.ward_linkage(df, "id", "v").collect()
    assert sorted(round(m["height"], 9) for m in merges)[:6] == [0] * 6 and max(m["height"] for m in merges) == pytest.approx(math.sqrt(2 * 7 / 8) * 3)
    assert L.ward_linkage(df.limit(1), "id", "v").count() == 0 and L.ward_linkage(df.limit(0), "id", "v").count() == 0
    assert [r["cluster"] for r in L.cut_linkage(L.ward_linkage(df.limit(1), "id", "v"), df.limit(1), "id", [1]).collect()] == [0]


def plain_loess(y, at, width, weights):
    n, out = len(y), []
    for x in at:
        near = sorted(range(n), key=lambda i: (abs(i - x), i))[: min(width, n)]
        reach = max(abs(i - x) for i in near) + max(width - n, 0) / 2
        w = np.array([(1 - min(abs(i - x) / reach, 1) ** 3) ** 3 * weights[i] if abs(i - x) < 0.999 * reach else 0.0 for i in near])
        x0 = np.array(near, float)
        # Weighted least squares of a line, solved as a system.
        m = np.array([[w.sum(), (w * x0).sum()], [(w * x0).sum(), (w * x0 * x0).sum()]])
        b = np.linalg.lstsq(m, np.array([(w * y[near]).sum(), (w * x0 * y[near]).sum()]), rcond=None)[0]
        out.append(b[0] + b[1] * x)
    return np.array(out)


def plain_stl(y, period=12, seasonal=7, trend_width=23, low_width=13):
    n, trend, weights = len(y), np.zeros(len(y)), np.ones(len(y))
    for _ in range(16):
        for _ in range(2):
            cycles = np.zeros(n + 2 * period)
            for m in range(period):
                at = list(range(m, n, period))
                smooth = plain_loess((y - trend)[at], range(-1, len(at) + 1), seasonal, weights[at])
                for j, v in enumerate(smooth):
                    cycles[m + j * period] = v
            low = cycles
            for k in (period, period, 3):
                low = np.array([low[i : i + k].mean() for i in range(len(low) - k + 1)])
            part = cycles[period : period + n] - plain_loess(low, range(n), low_width, np.ones(n))
            trend = plain_loess(y - part, range(n), trend_width, weights)
        apart = np.abs(y - part - trend)
        u = apart / (6 * np.median(apart))
        weights = np.where(u < 0.001, 1, np.where(u > 0.999, 0, (1 - np.minimum(u, 1) ** 2) ** 2))
    return trend, part


def test_stl_equals_a_plain_form_and_survives_outliers(spark):
    y = np.array(seasonal(96)) + 0.5 * noise(96)
    y[30] += 60
    y[71] -= 45
    trend, part = D.stl_parts(y)
    wanted = plain_stl(y)
    assert np.allclose(trend, wanted[0], atol=1e-6) and np.allclose(part, wanted[1], atol=1e-6)
    rows = D.decompose_stl(make(spark, a=y, short=y[:20], gap=[None, *y[1:]], flat=[3.0] * 40), K).collect()
    own = {i: r for i, r in enumerate(sorted((r for r in rows if r["series_id"] == "a"), key=lambda r: r["ds"]))}
    assert all(r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["y"]) for r in own.values())
    # The outliers are in the residual; the line below stays.
    assert abs(own[30]["residual"] - 60) < 3 and abs(own[71]["residual"] + 45) < 3
    assert max(abs(own[i]["trend"] - (100 + i)) for i in range(12, 84)) < 3
    assert all(r["trend"] is None for r in rows if r["series_id"] in ("short", "gap")) and all(abs(r["residual"]) < 1e-9 for r in rows if r["series_id"] == "flat")
    strength = D.stl_strength(make(spark, a=seasonal()), K).first()["strength"]
    assert strength > 0.95
    assert max(abs(x) for x in D.stl_parts(np.array(seasonal(60)), robust=False)[0] - (100 + np.arange(60))) < 2


def test_unit_root_p_values():
    # The published 1, 5 and 10 % points of the test with a constant.
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.1)):
        assert D.adf_p_value(statistic) == pytest.approx(p, abs=7e-4)
    assert D.adf_p_value(-30) == 0 and D.adf_p_value(5) == 1 and math.isnan(D.adf_p_value(float("nan")))
    values = [D.adf_p_value(x) for x in np.arange(-18, 2.7, 0.1)]
    assert all(b >= a - 1e-3 for a, b in zip(values, values[1:]))


@pytest.fixture
def many_parts(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    yield lambda adaptive: [spark.conf.set("spark.sql.shuffle.partitions", "9"), spark.conf.set("spark.sql.adaptive.enabled", adaptive)]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_next_rows_over_many_ranges(spark, many_parts, adaptive):
    many_parts(adaptive)
    n = 60_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("label"), F.array(F.col("id").cast("double")).alias("v"), F.repeat(F.lit("x"), 50).alias("extra"))
    rows = V.with_next(df, "label", ["id"], "v", "next")
    wrong = rows.where("next is null and id < 59997 or next is not null and next[0] <> id + 3")
    assert rows.count() == n and wrong.count() == 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_fill_over_many_ranges(spark, many_parts, adaptive):
    many_parts(adaptive)
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("ds"), F.when(F.col("id") % 2 == 0, "a").alias("k"), F.when(F.col("id") % 1000 < 2, F.col("id").cast("double")).alias("x"), F.lit("y").alias("extra"), F.when(F.col("id") > n - 3, 1.5).alias("z"))
    rows = S.fill_nonfinite(df, ["k"], ["x", "z"])
    # Every row has the value of the last full thousand, by parity.
    assert rows.where("x <> ds - ds % 1000 + ds % 2 or x is null").count() == 0 and rows.where("z = 1.5").count() == n
    assert rows.columns == df.columns and rows.count() == n


def test_ranges_of_empty_tables(spark):
    df = spark.range(0).select(F.col("id").alias("ds"), F.lit("a").alias("k"), F.lit(1.0).alias("x"), F.array(F.lit(1.0)).alias("v"))
    assert S.fill_nonfinite(df, ["k"], ["x"]).count() == 0 and V.with_next(df, "k", ["ds"], "v", "next").count() == 0
    assert P.average_ranks(df, ["x"]).count() == 0 and P.exact_quantiles(df, "x", (0.5,), ["k"]).count() == 0


def test_ranks_over_many_ranges(spark, many_parts):
    many_parts("true")
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_000).cast("double").alias("x"), F.floor(F.col("id") / 3).alias("y"), F.when(F.col("id") > 9, F.lit(1.0)).alias("z"))
    ranked = P.average_ranks(df, ["x", "y", "z"])
    both = ranked.agg(F.min("x"), F.max("x"), F.countDistinct("x"), F.min("y"), F.max("y"), F.max("z"), F.count("z")).first()
    assert tuple(both) == (1, 30_000, 30_000, 2, 29_999, (29_990 + 1) / 2, 29_990)


def test_ranks_of_values_that_change_when_computed_again(spark):
    last_bits = F.udf(lambda x: x + random.random() * 1e-9, "double").asNondeterministic()
    df = spark.range(200).select((F.col("id") * 79 % 200).cast("double").alias("x")).select("x", last_bits("x").alias("y"))
    ranked = P.average_ranks(df, ["x", "y"])
    assert ranked.where("x = y").count() == 200
    assert P.corr_matrix(df, ["x", "y"], "spearman").first()["r"] == pytest.approx(1.0)


def test_quantiles_of_large_and_small_groups(spark):
    r = np.random.default_rng(3)
    groups = {"normal": r.normal(size=9000), "ties": r.integers(0, 4, 9000).astype(float), "one": np.array([5.0]), "steps": np.repeat([1.0, 2.0, 3.0], 3000), "small": r.normal(size=50)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), (None, 4.0), ("normal", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6).cache()
    for accuracy in (100, P.ACCURACY):
        got = {q["k"]: q for q in P.exact_quantiles(df, "x", (0.0, 0.25, 0.5, 0.99, 1.0), ["k"], accuracy=accuracy).collect()}
        for k, vs in groups.items():
            assert got[k]["n"] == len(vs) and np.allclose(got[k]["q"], np.quantile(vs, (0.0, 0.25, 0.5, 0.99, 1.0)), atol=1e-12), k
        assert got[None]["q"] == [4.0] * 5 and got["none"]["n"] == 0 and got["none"]["q"] == [None] * 5
    whole = P.exact_quantiles(df, "x", (0.3,), accuracy=50).first()
    assert whole["q"][0] == pytest.approx(np.quantile(np.concatenate([*groups.values(), [4.0]]), 0.3))
    assert P.describe(df, "x", ["k"]).where("k = 'none'").first()["n"] == 0
    assert P.describe(df.limit(0), "x").first()["n"] == 0


def most_in_a_task(spark, run, figure) -> int:
    """The greatest ``figure`` of the metrics of a task while ``run`` runs."""
    spark.sparkContext.setJobGroup(name := f"watched-{random.random()}", name)
    run()
    spark.sparkContext.setJobGroup("", "")
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for stage in {x for job in tracker.getJobIdsForGroup(name) for x in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            if (found := tasks.apply(i).taskMetrics()).isDefined():
                most = max(most, figure(found.get()))
    return most


def test_no_task_of_box_stats_holds_a_large_group(spark, many_parts):
    many_parts("true")
    df = spark.range(120_000).select(F.when(F.col("id") < 15, "small").when(F.col("id") % 3 > 0, "a").otherwise("b").alias("k"), (F.col("id") * 7919 % 120_000).cast("double").alias("x"))
    found = {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for tables that are too large for it
    try:
        rows_read = lambda m: m.shuffleReadMetrics().recordsRead()
        assert most_in_a_task(spark, lambda: found.update({r["k"]: r for r in P.box_stats(df, "x", ["k"]).collect()}), rows_read) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    local = df.toPandas()
    for k, rows in local.groupby("k"):
        q1, q2, q3 = np.quantile(rows["x"], (0.25, 0.5, 0.75))
        inside = rows["x"][rows["x"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
        assert np.allclose([found[k][c] for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], [q1, q2, q3, inside.min(), inside.max()]), k


def test_features_need_few_pages_of_memory_in_a_task(spark):
    df = make(spark, a=seasonal(60), b=ar1(60))
    found = []
    assert most_in_a_task(spark, lambda: found.extend(X.canonical_features(df, K).collect()), lambda m: m.peakExecutionMemory()) < 400 << 20
    assert len(found) == 2 and all(v is not None for r in found for v in r)


def test_rectified_layers_learn_and_repeat(spark):
    r = np.random.default_rng(4)
    # Inside or outside of a ball: no line divides them.
    x = r.normal(size=(900, 4))
    rows = [(i, int((v * v).sum() > 3.4), v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").cache()
    how = {"hidden": (24, 12), "dropout": 0.1, "epochs": 14, "batches": 2, "rate": 0.02}
    train, test = df.where("id < 700"), df.where("id >= 700")
    found = V.rectified_classifier(train, test, "id", "label", "v", **how).orderBy("id").collect()
    hit = np.mean([f["label"] == f["prediction"] for f in found])
    chance = np.mean([f["label"] for f in found])
    assert len(found) == 200 and hit > max(chance, 1 - chance) + 0.2
    assert found == V.rectified_classifier(train.repartition(3), test, "id", "label", "v", **how).orderBy("id").collect()


def test_kernel_margins_part_two_rings(spark):
    r = np.random.default_rng(6)
    turn, far = r.uniform(0, 2 * np.pi, 400), np.where(np.arange(400) % 2, 1.0, 3.0) + 0.15 * r.normal(size=400)
    rows = [(i, i % 2, [float(d * np.cos(a)), float(d * np.sin(a))]) for i, (a, d) in enumerate(zip(turn, far))]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").cache()
    train, test = df.where("id < 300"), df.where("id >= 300")
    hit = lambda f: f.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
    assert hit(V.kernel_margin_classifier(train, test, "id", "label", "v", 2, features=100)) > 0.97
    assert hit(V.margin_classifier(train, test, "id", "label", "v", 2)) < 0.75


def test_sparse_fit_is_the_optimum():
    r = np.random.default_rng(9)
    x, sparse = r.normal(size=(60, 6)), np.array([False, False, True, True, True, True])
    y = x @ np.array([1.0, -2.0, 0.0, 0.5, 0.0, 0.02]) + 0.1 * r.normal(size=60)
    cost = lambda b, p: 0.5 * ((y - x @ b) ** 2).sum() + p * np.abs(b[sparse]).sum()
    for penalty in (0.5, 5.0, 1e4):
        b = R.sparse_fit(x, y, sparse, penalty)
        # Subgradients hold, so the convex cost is least there; and no move nearby is better.
        slope = x.T @ (y - x @ b)
        assert np.allclose(slope[~sparse], 0, atol=1e-6)
        assert all(abs(s - penalty * np.sign(v)) < 1e-6 if v else abs(s) <= penalty + 1e-6 for s, v in zip(slope[sparse], b[sparse]))
        assert all(cost(b, penalty) <= cost(b + 0.01 * d, penalty) + 1e-9 for d in r.normal(size=(200, 6)))
    assert (R.sparse_fit(x, y, sparse, 1e4)[sparse] == 0).all()


def test_changepoint_is_found_and_the_rest_stays_straight(spark):
    n, knots = 120, 25
    t = np.arange(n)
    where = 0.8 * 13 / (knots + 1) * (n - 1)
    y = 2 + 0.01 * t - 0.03 * np.maximum(t - where, 0) + 0.1 * np.sin(2 * np.pi * t / 12) + 0.002 * noise(n)
    hinges = R.sparse_trend(y, knots, 3)[2 : 2 + knots]
    assert np.abs(hinges).argmax() == 12 and (np.delete(hinges, [11, 12, 13]) == 0).sum() >= knots - 4
    rows = R.changepoint_trend(make(spark, a=np.expm1(y), c=[7] * 30, s=[3.0]), K, 6).orderBy("ds").collect()
    ahead = 2 + 0.01 * (n + np.arange(6)) - 0.03 * (n + np.arange(6) - where) + 0.1 * np.sin(2 * np.pi * (n + np.arange(6)) / 12)
    assert np.allclose([math.log1p(r["yhat"]) for r in rows if r["series_id"] == "a"], ahead, atol=0.03)
    assert all(abs(r["yhat"] - 7) < 1e-6 for r in rows if r["series_id"] == "c") and len([r for r in rows if r["series_id"] == "s"]) == 6


def test_smoothing_search_is_no_worse_than_the_grid(spark):
    train = make(spark, a=seasonal(), b=ar1(96), c=[5] * 40, s=[1, 2, 3])
    fits = {r["series_id"]: r for r in R.ses_fits(train, K, R.grid(0.05, 1.0, 20)).groupBy("series_id").agg(F.min("sse").alias("sse")).collect()}
    for r in R.ses_search(train, K).collect():
        assert r["grid_sse"] == pytest.approx(fits[r["series_id"]]["sse"]) and r["sse"] <= r["grid_sse"] and 0 <= r["params"][0] <= 1
        y = np.array([x["y"] for x in train.where(F.col("series_id") == r["series_id"]).orderBy("ds").collect()])
        assert r["sse"] <= min(R.smoothing_sse(y, np.linspace(0, 1, 401)[:, None], 0)) * (1 + 1e-3) + 1e-9
    found = {r["series_id"]: r for r in R.holt_winters_search(train, K).collect()}
    assert set(found) == {"a", "b", "c"} and all(r["sse"] <= r["grid_sse"] for r in found.values())
    # The grid's errors are those of the array functions of holt_winters.
    y = np.array(seasonal())
    own = R.smoothing_sse(y, np.array(R.HOLT_WINTERS_GRID), 12)
    best = np.array(R.HOLT_WINTERS_GRID)[own.argmin()]
    level, trend, season = y[:12].mean(), (y[12:24].mean() - y[:12].mean()) / 12, list(y[:12] - y[:12].mean())
    sse, (a, b, g, phi) = 0.0, best
    for v in y[12:]:
        ahead = level + phi * trend
        e = v - ahead - season[0]
        sse += e * e
        new = ahead + a * e
        trend, level = phi * trend + b * (new - level - phi * trend), new
        season = [*season[1:], season[0] + g * (v - new - season[0])]
    assert own.min() == pytest.approx(sse)


def test_sample_of_a_large_label(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").alias("label"))
    plain = df.withColumn("s", V.scramble("id", 7))
    wanted = {r["id"] for r in plain.where("label is null").orderBy("s", "id").limit(30).collect()} | {r["id"] for r in plain.where("label = 'hot'").orderBy("s", "id").limit(30).collect()}
    found = V.sample_per_class(df, "label", "id", 30)
    assert {r["id"] for r in found.collect()} == wanted and found.columns == df.columns
    assert V.sample_per_class(df.limit(5), "label", "id", 30).count() == 5 and V.sample_per_class(df, "label", "id", 0).count() == 0


def test_power_components_are_those_of_the_covariance(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(400, 30)) * 0.9 ** np.arange(30) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    _, found, values, total = C.power_components(df, "v", 3)
    own, axes = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(values, own[::-1][:3]) and total == pytest.approx(own.sum())
    assert np.abs(np.abs(found.T @ axes[:, ::-1][:, :3]) - np.eye(3)).max() < 1e-6
    scores, variance = C.power_pca(df, "id", "v", 2)
    rows = scores.groupBy("component").agg(F.avg("score").alias("m"), F.var_samp("score").alias("v")).orderBy("component").collect()
    assert np.allclose([s["m"] for s in rows], 0, atol=1e-9) and np.allclose([s["v"] for s in rows], own[::-1][:2])
    assert variance.orderBy("component").collect()[1]["cumulative"] == pytest.approx(own[::-1][:2].sum() / own.sum())


def test_components_by_library_and_by_power_agree(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(60, 5)) @ r.normal(size=(5, 5))
    x = (x - x.mean(0)) / x.std(0)
    names = list("abcde")
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{n} double" for n in names))
    scores, variance, loadings = V.pca(df, "id", names, 2)
    other, shares = C.power_pca(df.select("id", F.array(*names).alias("v")), "id", "v", 2)
    a, b = ({(q["id"], q["component"]): q["score"] for q in f.collect()} for f in (scores, other))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a) and len(a) == 120
    assert np.allclose([q["explained"] for q in variance.orderBy("component").collect()], [q["explained"] for q in shares.orderBy("component").collect()])
    matrix = np.array([[next(q["loading"] for q in loadings.collect() if (q["component"], q["feature"]) == (i, n)) for n in names] for i in range(2)])
    assert np.allclose(matrix @ matrix.T, np.eye(2), atol=1e-9)
    top = V.top_loadings(loadings, 2).collect()
    assert len(top) == 4 and all(q["rank"] <= 2 for q in top)


def test_window_regressors_are_least_squares(spark):
    whole = {"a": seasonal(60), "b": [50 + 3 * v for v in noise(60, 8)]}
    found = {r["series_id"]: r["yhat"] for r in R.window_regressor_direct(make(spark, **whole), K, 1, 5).collect()}
    scaled = {k: (np.log1p(v) - np.log1p(v).min()) / np.ptp(np.log1p(v)) for k, v in whole.items()}
    rows = [(s[i : i + 5], s[i + 5]) for s in scaled.values() for i in range(55)]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    c = x - x.mean(0)
    w = np.linalg.solve(c.T @ c / len(x) + np.diag(1e-3 * (c * c).mean(0)), c.T @ (y - y.mean()) / len(x))
    for k, s in scaled.items():
        ahead = y.mean() + (s[-5:] - x.mean(0)) @ w
        assert found[k] == pytest.approx(max(0, math.expm1(ahead * np.ptp(np.log1p(whole[k])) + np.log1p(whole[k]).min())), rel=1e-6)


def test_clusters_nest_and_lower_the_inertia(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, (r.normal(size=3) + 6 * (i % 3)).tolist()) for i in range(45)], "id long, v array<double>").cache()
    for made in (V.kmeans, V.bisecting_groups, V.hierarchical_groups):
        rows = made(df, "id", "v", [2, 3, 4]).collect()
        inertia = {q["k"]: q["inertia"] for q in rows}
        assert len(rows) == 135 and inertia[2] > inertia[3] > inertia[4]
        three = {}
        for q in rows:
            if q["k"] == 3:
                three.setdefault(q["id"] % 3, set()).add(q["cluster"])
        assert all(len(c) == 1 for c in three.values()) and len({c for s in three.values() for c in s}) == 3
        if made is not V.kmeans:
            inner, outer = ({q["id"]: q["cluster"] for q in rows if q["k"] == k} for k in (4, 3))
            assert all(len({outer[i] for i in inner if inner[i] == c}) == 1 for c in set(inner.values()))
    assert V.best_k(V.hierarchical_groups(df, "id", "v", [2, 3, 4])).where("best").first()["k"] == 3


def test_probed_neighbours_and_their_recall(spark, monkeypatch):
    r = np.random.default_rng(21)
    middles = r.normal(size=(12, 8)) * 5
    x = middles[r.integers(0, 12, 1500)] + r.normal(size=(1500, 8))
    df = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, label int, v array<double>").cache()
    train, test = df.where("id >= 200"), df.where("id < 200")
    monkeypatch.setattr(V, "TRAIN_BYTES", 64 * 40)
    exact = V.nearest_rows(train, test, "id", "label", "v", 5)
    own = {i: np.sort(np.sqrt(((x[200:] - x[i]) ** 2).sum(1)))[:5] for i in range(200)}
    rows = {}
    for q in exact.collect():
        rows.setdefault(q["id"], []).append(q["d"])
    assert all(np.allclose(sorted(rows[i])[:5], own[i]) for i in own)
    found = V.nearest_probed(train, test, "id", "label", "v", 5, lists=12, probes=3)
    assert V.neighbour_recall(exact, found, "id", 5).first()["recall"] >= 0.95
    every = V.nearest_probed(train, test, "id", "label", "v", 5, lists=12, probes=12)
    assert V.neighbour_recall(exact, every, "id", 5).first()["recall"] == 1
    a, b = ({q["id"]: q["prediction"] for q in f(train, test, "id", "label", "v").collect()} for f in (V.knn_classify, V.knn_classify_probed))
    assert len(b) == 200 and np.mean([a[i] == b[i] for i in a]) > 0.9
    assert V.knn_classify_probed(train.limit(0), test, "id", "label", "v").count() == 0


def test_a_grid_prepares_its_rows_once(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, i % 3, [float(x) for x in r.normal(size=6) + 1.5 * np.eye(6)[i % 3]]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").coalesce(1).cache()
    train, valid = df.where("vec_id % 4 <> 0"), df.where("vec_id % 4 = 0")
    wanted = {(k, reg): V.margin_classifier(train, valid, "vec_id", "label", "v", k, reg).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0] for k in (1, 3) for reg in (0.1,)}
    fits, fit = [], V.Pipeline.fit
    monkeypatch.setattr(V.Pipeline, "fit", lambda self, *a: (fits.append(self), fit(self, *a))[1])
    found = V.tune_grid(train, valid, "vec_id", "label", "v", [1, 3], [0.1]).collect()
    assert len(fits) == 1 and {(x["k"], x["reg"]): x["accuracy"] for x in found} == wanted
    assert [x["accuracy"] for x in found if x["best"]] == [max(wanted.values())]
