"""Operators on small hand-made tables: edge cases, properties, reference values."""

import datetime as dt
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import scalar as S
from tidemark.operators import diagnostics as D
from tidemark.operators import features as X
from tidemark.operators import forecast as R
from tidemark.operators import images as I
from tidemark.operators import profile as P
from tidemark.operators import series as Q
from tidemark.operators import vectors as V
from tidemark.sources import tables as B

K = ["series_id"]
SCHEMA = "series_id string, ds date, y double"


def month(i: int) -> dt.date:
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def make(spark, **series):
    return spark.createDataFrame([(k, month(i), None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)], SCHEMA)


def seasonal(n=120):
    return [100 + t + 10 * math.sin(2 * math.pi * t / 12) for t in range(n)]


def noise(n, seed=3):
    return np.random.default_rng(seed).normal(size=n)


def ar1(n=300, phi=0.6):
    out, x = [], 0.0
    for e in noise(n):
        x = phi * x + e
        out.append(50 + x)
    return out


def test_fill_calendar_is_dense(spark):
    df = spark.createDataFrame([("a", month(0), 1.0), ("a", month(3), 2.0), ("b", month(5), 3.0)], SCHEMA)
    rows = Q.fill_calendar(df, K).orderBy("series_id", "ds").collect()
    assert [r["y"] for r in rows] == [1, 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 3]
    assert Q.fill_calendar(df.limit(0), K).count() == 0


def test_total_by_drops_null_keys_and_sums_nulls_to_zero(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("b", 2.0)], "k string, m double")
    assert {r["k"]: r["y"] for r in Q.total_by(df, ["k"], "m").collect()} == {"a": 0.0, "b": 2.0}


def test_split_points_are_those_of_double_arithmetic(spark):
    s = Q.split_temporal(make(spark, a=range(90)), K)
    assert s.where("split = 'train'").count() == int(90 * 0.70) == 62


def test_windows_do_not_look_ahead(spark):
    rows = Q.lag_windows(make(spark, a=range(10)), K, 3, 2).orderBy("ds").collect()
    assert [(r["x"], r["target"]) for r in rows][0] == ([0, 1, 2], [3, 4]) and len(rows) == 6
    f = Q.rolling_features(Q.with_index(make(spark, a=range(30)), K), K, 24).orderBy("ds").collect()
    assert f[23]["f_mean"] is None and f[24]["f_mean"] == 11.5 and f[24]["f_last"] == 23


def test_rolling_needs_full_windows(spark):
    rows = Q.rolling(make(spark, a=range(13)), K, 12).orderBy("ds").collect()
    assert [r["rolling_avg"] for r in rows][10:] == [None, 5.5, 6.5]


def test_coerce_and_duplicates_and_nulls(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("1.5",)], "m string")
    assert [r["m"] for r in B.coerce_numeric(df, "m").collect()] == [1.5, None, None, 1.5]
    assert P.duplicate_count(df).first()[0] == 1
    assert P.null_report(df).first()["n_null"] == 1


def test_read_fact_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Año,País,Viajero\n2010,Perú,5\n2011,Chile,n/d\n", encoding="utf-8")
    schema = T.StructType([T.StructField("Año", T.IntegerType()), T.StructField("País", T.StringType()), T.StructField("Viajero", T.StringType())])
    df = B.coerce_numeric(B.read_fact_csv(spark, str(tmp_path), schema), "Viajero")
    assert [tuple(r) for r in df.orderBy("Año").collect()] == [(2010, "Perú", 5.0), (2011, "Chile", None)]
    B.write_table(df, str(tmp_path / "t"))
    assert B.read_table(spark, str(tmp_path / "t")).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("a/b12/F003.jpg",), ("x.png",)], "p string")
    assert [r[0] for r in df.select(S.frame_number("p")).collect()] == [3, None]
    df = spark.createDataFrame([("a", 1, float("inf")), ("a", 2, 5.0), ("a", 3, float("nan")), ("b", 1, None)], "k string, ds int, x double")
    assert [r["x"] for r in S.fill_nonfinite(df, ["k"], ["x"]).orderBy("k", "ds").collect()] == [5, 5, 5, 0]
    assert S.drop_constant_columns(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), ["a", "b"]).columns == ["b"]
    p = spark.createDataFrame([([0.0, 127.5, 255.0],)], "p array<double>")
    back = p.withColumn("q", S.scale_pixels("p", [0.5, 0.4, 0.3], [0.2, 0.2, 0.2])).withColumn("r", S.unscale_pixels("q", [0.5, 0.4, 0.3], [0.2, 0.2, 0.2])).first()
    assert np.allclose(back["r"], back["p"])


def test_zscore_and_minmax_invert(spark):
    s = make(spark, a=[1, 2, 4, 9], c=[5, 5, 5, 5])
    z = S.zscore(s, S.zscore_constants(s, K), K)
    stats = z.where("series_id = 'a'").agg(F.avg("z"), F.stddev_pop("z")).first()
    assert abs(stats[0]) < 1e-12 and abs(stats[1] - 1) < 1e-12
    assert [r["z"] for r in z.where("series_id = 'c'").collect()] == [0] * 4
    m = S.minmax_unscale(S.minmax_scale(s, S.minmax_constants(s, K), K), name="back")
    assert all(abs(r["back"] - r["y"]) < 1e-9 for r in m.collect())


def test_ties_at_the_cut(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, m double")
    assert [r["k"] for r in Q.top_k(df, "m", ["k"], 2).collect()] == ["c", "a"]


def test_acf_pacf(spark):
    y = ar1()
    s = make(spark, ar=y, c=[1.0] * 20)
    r = {x["lag"]: x["r"] for x in D.acf(s, K, 3).where("series_id = 'ar'").collect()}
    d = np.array(y) - np.mean(y)
    assert all(abs(r[k] - (d[k:] @ d[:-k]) / (d @ d)) < 1e-9 for k in r)
    assert all(x["r"] is None for x in D.acf(s, K, 3).where("series_id = 'c'").collect())
    p = {x["lag"]: x["pacf"] for x in D.pacf(s, K, 3).where("series_id = 'ar'").collect()}
    assert abs(p[1] - r[1]) < 1e-9 and abs(p[2] - (r[2] - r[1] ** 2) / (1 - r[1] ** 2)) < 1e-9


def test_adf_separates_random_walk(spark):
    s = make(spark, ar=ar1(), walk=100 + np.cumsum(noise(300, 5)), c=[2.0] * 40, one=[1.0])
    chosen = {r["series_id"]: r["d"] for r in D.adf_table(s, K).where("chosen").collect()}
    assert chosen["ar"] == 0 and chosen["walk"] == 1 and "c" not in chosen and "one" not in chosen


def test_decomposition(spark):
    s = make(spark, a=seasonal())
    assert D.seasonal_strength(s, K).first()["strength"] > 0.99
    parts = D.decompose_additive(s, K).where("trend is not null").collect()
    assert all(abs(r["y"] - r["trend"] - r["seasonal"] - r["residual"]) < 1e-9 for r in parts) and len(parts) == 108


def test_forecasts_recover_simple_series(spark):
    s = make(spark, a=seasonal(), b=[7.0] * 120)
    for model in (R.seasonal_naive, R.ses, R.holt_winters, R.trend_fourier, R.window_regressor_recursive):
        rows = model(s, K, 12).where("series_id = 'b'").collect()
        assert len(rows) == 12 and all(abs(r["yhat"] - 7) < 0.1 for r in rows), model
        assert min(r["ds"] for r in rows) == month(120)
    truth = seasonal(132)[120:]
    for model, most in ((R.holt_winters, 3.0), (R.trend_fourier, 8.0)):
        got = [r["yhat"] for r in model(s, K, 12).where("series_id = 'a'").orderBy("ds").collect()]
        assert np.abs(np.array(got) - truth).mean() < most, model


def test_arma_selection_prefers_passing_fits(spark):
    rows = [("a", 0, 1, 0, 10.0, 10.0, 0.01), ("a", 1, 1, 0, 12.0, 12.0, 0.5), ("a", 1, 1, 1, 11.0, 13.0, 0.5), ("b", 0, 1, 0, 9.0, 9.0, 0.01), ("b", 2, 1, 0, 8.0, 19.0, 0.01)]
    best = R.select_arma(spark.createDataFrame(rows, "series_id string, p int, d int, q int, aic double, bic double, p_value double"), K)
    assert {r["series_id"]: r["p"] for r in best.collect()} == {"a": 1, "b": 2}
    assert {r["series_id"]: r["q"] for r in best.collect()}["a"] == 0


def test_features(spark):
    s = make(spark, p=[0, 2, 2, 1, 3, 0], c=[1, 1, 1, 1, 1, 1])
    peaks = {r["series_id"]: r for r in X.peak_features(s, K).collect()}
    assert peaks["p"]["n_peaks"] == 2 and peaks["p"]["peak_mean"] == 2.5 and peaks["c"]["n_peaks"] == 0
    assert {r["series_id"]: r["zero_crossing"] for r in X.zero_crossing(s, K).collect()} == {"p": 0.0, "c": 6.0}
    e = {r["series_id"]: r for r in X.entropy_features(s, K).collect()}
    assert e["c"]["approximate_entropy"] == 0 and e["c"]["sample_entropy"] is None
    wave = X.spectral_features(make(spark, w=[math.sin(2 * math.pi * t / 8) for t in range(64)]), K).first()
    assert abs(wave["dominant_freq"] - 1 / 8) < 1e-12
    assert X.feature_matrix(make(spark, a=seasonal(), b=ar1(120)), K).count() == 2


def test_vectors(spark):
    rows = [(1, "a", [0.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [4.0, 0.0]), (4, "b", [4.0, 1.0]), (5, "c", [0.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>")
    pairs = V.pairwise_distance(df, "id", "v")
    assert pairs.count() == 10 and pairs.where("id_a = 1 and id_b = 3").first()["distance"] == 4
    assert {r["label"]: r["centroid"] for r in V.centroids(df, "label", "v").collect()}["b"] == [4.0, 0.5]
    s = {r["id"]: r["silhouette"] for r in V.silhouette(df, "id", "v", "label").collect()}
    other = (4 + math.sqrt(17)) / 2
    assert abs(s[1] - (other - 1) / other) < 1e-9 and s[5] == 0
    got = {r["id"]: r["prediction"] for r in V.knn_classify(df.where("id <> 2"), df.where("id = 2"), "id", "label", "v", 1).collect()}
    assert got == {2: "a"}
    near = V.knn_classify_approx(df.where("id <> 2"), df.where("id = 2"), "id", "label", "v", 1, reach=2.0, bucket=4.0).collect()
    assert [r["prediction"] for r in near] == ["a"]


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("string").alias("label"))
    s = V.stratified_split(df, "label", "id")
    assert {tuple(r) for r in s.groupBy("label", "split").count().collect()} == {(k, n, c) for k in "01" for n, c in (("train", 70), ("val", 15), ("test", 15))}
    b = V.block_split(df, "label", "id", 10)
    assert b.groupBy("label", "block").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert V.sample_per_class(df, "label", "id", 7).count() == 14


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (2, 1)], "label int, prediction int")
    rows = {r["label"]: r for r in V.classification_report(df, "label").collect()}
    assert rows[0]["recall"] == pytest.approx(2 / 3) and rows[2]["f1"] == 0 and rows[0]["accuracy"] == pytest.approx(0.6) and rows[0]["chance"] == pytest.approx(1 / 3)


def png(path, pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    red = np.zeros((4, 4, 3), np.uint8)
    red[:, :, 0] = 200
    png(tmp_path / "A" / "A1.png", red)
    png(tmp_path / "A" / "A2.png", red)
    png(tmp_path / "B" / "B1.png", red // 2)
    inventory = {r["label"]: r["n_images"] for r in B.image_inventory(spark, str(tmp_path)).collect()}
    assert inventory == {"A": 2, "B": 1}
    images = B.read_images(spark, str(tmp_path))
    assert images.count() == 3
    small = I.resize_images(images, 2, 2)
    assert small.where("label = 'A'").first()["pixels"] == [200, 0, 0] * 4
    assert len(I.resize_images(images, 2, 2, gray=True).first()["pixels"]) == 4
    stats = {r["channel"]: r for r in I.channel_stats(small.where("label = 'A'")).collect()}
    assert stats[0]["mean"] == pytest.approx(200 / 255) and stats[1]["deviation"] == 0
    by_class = {r["label"]: r for r in I.brightness_by_class(I.brightness_stats(images)).collect()}
    assert by_class["A"]["red"] == 200 and by_class["B"]["brightness"] == pytest.approx(29.9)
    manifest = spark.createDataFrame([("A", "train", "somewhere/A/A1.png")], "label string, split string, path string")
    assert I.manifest_to_images(manifest, images).count() == 1
    B.write_vectors(small.withColumn("split", F.lit("train")), str(tmp_path / "out"))
    assert B.read_vectors(spark, str(tmp_path / "out"), "train").count() == 3


def test_bilinear_keeps_linear_ramps():
    x = np.repeat(np.arange(8.0)[None, :, None], 8, axis=0)
    assert np.allclose(I.bilinear(x, 4, 4)[0, :, 0], [0.5, 2.5, 4.5, 6.5])
