"""Features of keyed series, one value or row a key. Input is (key, ds, y)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.diagnostics import acf
from tidemark.operators.profile import histogram
from tidemark.operators.series import as_arrays, ordered, with_index
from tidemark.sources.tables import kept


def side_by_side(parts: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """One row a key with the columns of all ``parts``, each of a row a key.

    Every part is written first: Spark would run the windows and sorts of all parts in one task, as they are dealt by one key, and each of these holds a page of memory however short the series are.
    """
    parts = [kept(p, "features") for p in parts]
    columns = [c for p in parts for c in p.columns if c not in key]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*key).agg(*[F.max(c).alias(c) for c in columns])


def distribution_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, biased skewness and kurtosis, mean and median absolute deviation, quartile distance, coefficient of variation (by the absolute mean)."""
    centre = df.groupBy(*key).agg(F.avg("y").alias("__m"), F.percentile("y", F.lit(0.5)).alias("__md"))
    return df.join(centre, list(key)).groupBy(*key).agg(
        F.avg("y").alias("mean"), F.stddev("y").alias("std"), F.skewness("y").alias("skew"), F.kurtosis("y").alias("kurtosis"),
        F.avg(F.abs(F.col("y") - F.col("__m"))).alias("mean_abs_dev"), F.percentile(F.abs(F.col("y") - F.col("__md")), F.lit(0.5)).alias("median_abs_dev"),
        (F.percentile("y", F.lit(0.75)) - F.percentile("y", F.lit(0.25))).alias("iqr"), F.expr("try_divide(stddev(y), abs(avg(y)))").alias("cv"),
    )


def acf_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return acf(df, key, 2).groupBy(*key).agg(F.max(F.when(F.col("lag") == 1, F.col("r"))).alias("acf1"), F.max(F.when(F.col("lag") == 2, F.col("r"))).alias("acf2"))


def peak_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number of the peaks, their mean (null without any) and sample deviation (null for fewer than two); a run of equal values counts once, and the ends are no peaks."""
    w = ordered(key)
    runs = df.withColumn("__p", F.lag("y").over(w)).where("__p is null or y <> __p")
    peaks = runs.withColumns({"__b": F.lag("y").over(w), "__a": F.lead("y").over(w)})
    top = F.when((F.col("y") > F.col("__b")) & (F.col("y") > F.col("__a")), F.col("y"))
    return peaks.groupBy(*key).agg(F.count(top).alias("n_peaks"), F.avg(top).alias("peak_mean"), F.stddev(top).alias("peak_std"))


def zero_crossing(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Index of the first value before a change of sign of y less its mean, or else the number of values."""
    centred = with_index(df.withColumn("__d", F.signum(F.col("y") - F.avg("y").over(W.partitionBy(*key)))), key)
    moved = centred.withColumn("__n", F.lead("__d").over(ordered(key)))
    return moved.groupBy(*key).agg(F.coalesce(F.min(F.when(F.col("__n") != F.col("__d"), F.col("t"))), F.count("y").cast("double")).alias("zero_crossing"))


def spectral_features(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Greatest power, its frequency and the entropy of the centred series' power spectrum without the zero frequency."""

    @F.pandas_udf("max_power double, dominant_freq double, spectral_entropy double")
    def spectrum(ys: pd.Series) -> pd.DataFrame:
        out = []
        for y in ys:
            y = np.asarray(y, float)
            power = np.abs(np.fft.rfft(y - y.mean())) ** 2 if len(y) else np.zeros(1)
            power, freq = power[1:], np.fft.rfftfreq(max(len(y), 1))[1:]
            if not len(power) or power.sum() <= 1e-12:
                out.append((0.0, 0.0, 0.0))
                continue
            p = power / power.sum()
            p = p[p > 0]
            out.append((float(power.max()), float(freq[power.argmax()]), float(-(p * np.log(p)).sum())))
        return pd.DataFrame(out, columns=["max_power", "dominant_freq", "spectral_entropy"])

    return as_arrays(df, key).withColumn("s", spectrum("ys")).select(*key, "s.*")


def _close_counts(y: np.ndarray, m: int, r: float) -> np.ndarray:
    x = np.lib.stride_tricks.sliding_window_view(y, m)
    # One template at a time, so that memory stays in proportion to the series.
    return np.array([(np.abs(x - t).max(axis=1) <= r).sum() for t in x])


def entropy_features(df: DataFrame, key: Sequence[str], m: int = 2, r: float = 0.2) -> DataFrame:
    """Approximate entropy, and sample entropy (null without matches), with templates within r population deviations."""

    @F.pandas_udf("approximate_entropy double, sample_entropy double")
    def entropies(ys: pd.Series) -> pd.DataFrame:
        out = []
        for y in ys:
            y = np.asarray(y, float)
            near = r * y.std()
            if len(y) < m + 2 or near <= 0:
                out.append((0.0, None))
                continue
            a, b = _close_counts(y, m, near), _close_counts(y, m + 1, near)
            phi = [np.log(c / len(c)).mean() for c in (a, b)]
            matches = [int((c - 1).sum()) for c in (a, b)]
            out.append((float(phi[0] - phi[1]), float(-np.log(matches[1] / matches[0])) if min(matches) > 0 else None))
        return pd.DataFrame(out, columns=["approximate_entropy", "sample_entropy"])

    return as_arrays(df, key).withColumn("s", entropies("ys")).select(*key, "s.*")


def histogram_entropy(df: DataFrame, key: Sequence[str], bins: int = 10) -> DataFrame:
    p = F.col("n") / F.sum("n").over(W.partitionBy(*key))
    return histogram(df, "y", bins, key).withColumn("p", p).groupBy(*key).agg(F.sum(-F.col("p") * F.ln("p")).alias("histogram_entropy"))


def log_scales(n: str, least: int) -> Column:
    """Ten whole numbers in equal steps of their logarithm from ``least`` to a quarter of ``n``, those below 2 and repeats left out."""
    step = f"(log10({n} div 4) - log10({least})) / 9"
    return F.expr(f"filter(array_distinct(transform(sequence(0, 9), i -> cast(floor(pow(10D, log10({least}) + i * {step}) + 1e-9D) as int))), s -> s >= 2 and {n} div s >= 2)")


def _segments(df: DataFrame, key: Sequence[str], least: int) -> DataFrame:
    """Every series of 10 values or more cut into whole segments of every scale: columns scale, seg, i."""
    n = F.count("y").over(W.partitionBy(*key))
    rows = with_index(df.withColumn("__n", n), key).where("__n >= 10").withColumn("scale", F.explode(log_scales("__n", least)))
    rows = rows.withColumns({"seg": F.floor(F.col("t") / F.col("scale")), "i": F.col("t") % F.col("scale")})
    return rows.where(F.col("seg") < F.floor(F.col("__n") / F.col("scale")))


def dfa_exponent(df: DataFrame, key: Sequence[str], least: int = 4) -> DataFrame:
    """Slope of ln fluctuation over ln scale; the fluctuation is the mean over segments of the root mean square about the segment's line of the profile."""
    profile = df.withColumn("__d", F.col("y") - F.avg("y").over(W.partitionBy(*key)))
    profile = profile.withColumn("__c", F.sum("__d").over(ordered(key).rowsBetween(W.unboundedPreceding, 0)))
    sse = F.regr_syy("__c", "i") - F.coalesce(F.regr_sxy("__c", "i") * F.regr_slope("__c", "i"), F.lit(0.0))
    rest = _segments(profile, key, least).groupBy(*key, "scale", "seg").agg(sse.alias("sse"))
    by_scale = rest.groupBy(*key, "scale").agg(F.avg(F.sqrt(F.greatest("sse", F.lit(0.0)) / F.col("scale"))).alias("f")).where("f > 0")
    return by_scale.groupBy(*key).agg(F.regr_slope(F.ln("f"), F.ln("scale")).alias("dfa"))


def hurst_exponent(df: DataFrame, key: Sequence[str], least: int = 1) -> DataFrame:
    """Slope of ln rescaled range over ln scale; ranges are over sample deviations."""
    seg = [*key, "scale", "seg"]
    rows = _segments(df, key, least)
    rows = rows.withColumn("__d", F.col("y") - F.avg("y").over(W.partitionBy(*seg)))
    rows = rows.withColumn("__c", F.sum("__d").over(W.partitionBy(*seg).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
    ratio = rows.groupBy(*seg).agg((F.max("__c") - F.min("__c")).alias("range"), F.stddev("y").alias("s")).where("s > 0")
    by_scale = ratio.groupBy(*key, "scale").agg(F.avg(F.col("range") / F.col("s")).alias("rs")).where("rs > 0")
    return by_scale.groupBy(*key).agg(F.regr_slope(F.ln("rs"), F.ln("scale")).alias("hurst"))


def canonical_features(df: DataFrame, key: Sequence[str], nlags: int = 40) -> DataFrame:
    """Seven of the published canonical features (Lubba et al. 2019) of the z-scored series.

    f1ecac: lag at which the autocorrelation first falls below 1/e, interpolated; first_min_ac: its first minimum; longstretch1: longest run at or
    above the mean; mean3_stderr: sample deviation of residuals of the mean of three; mode_10: centre of the fullest of ten bins; motif3_hh: entropy of
    pairs of tercile letters; fmmi: first minimum of the Gaussian automutual information.
    """
    df = kept(df, "series")
    z = F.when(F.stddev("y").over(W.partitionBy(*key)) > 0, (F.col("y") - F.avg("y").over(W.partitionBy(*key))) / F.stddev("y").over(W.partitionBy(*key))).otherwise(0.0)
    s = kept(with_index(df.withColumn("z", z), key), "scaled-series")
    w = ordered(key)
    lags = acf(df, key, nlags).withColumn("r", F.coalesce("r", F.lit(0.0)))
    by_lag = W.partitionBy(*key).orderBy("lag")
    near = lags.withColumns({"before": F.coalesce(F.lag("r").over(by_lag), F.lit(1.0)), "after": F.lead("r").over(by_lag)})
    e = F.lit(float(np.exp(-1)))
    fall = F.when((F.col("r") < e) & (F.col("before") >= e), F.col("lag") - 1 + (F.col("before") - e) / (F.col("before") - F.col("r")))
    low = F.when((F.col("r") < F.col("before")) & (F.col("r") < F.col("after")), F.col("lag"))
    ami = near.withColumn("ami", -0.5 * F.ln(F.greatest(1 - F.col("r") * F.col("r"), F.lit(1e-12))))
    ami = ami.withColumns({"ab": F.lag("ami").over(by_lag), "aa": F.lead("ami").over(by_lag)})
    from_acf = ami.groupBy(*key).agg(
        F.coalesce(F.min(fall), F.lit(float(nlags))).alias("f1ecac"), F.coalesce(F.min(low), F.lit(nlags)).cast("double").alias("first_min_ac"),
        F.coalesce(F.min(F.when((F.col("ami") < F.col("ab")) & (F.col("ami") < F.col("aa")), F.col("lag"))), F.lit(nlags)).cast("double").alias("fmmi"),
    )
    above = s.withColumn("__u", (F.col("z") >= 0).cast("int"))
    above = above.withColumn("__g", F.sum(1 - F.col("__u")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    stretch = above.groupBy(*key, "__g").agg(F.sum("__u").alias("l")).groupBy(*key).agg(F.max("l").cast("double").alias("longstretch1"))
    last3 = w.rowsBetween(-3, -1)
    stderr = s.withColumn("__e", F.when(F.count("z").over(last3) == 3, F.col("z") - F.avg("z").over(last3))).groupBy(*key).agg(F.stddev("__e").alias("mean3_stderr"))
    bounds = s.groupBy(*key).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    fullest = histogram(s, "z", 10, key).withColumn("k", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "bin"))).where("k = 1")
    mode = fullest.join(bounds, list(key)).select(*key, (F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / 10).alias("mode_10"))
    cuts = s.groupBy(*key).agg(F.percentile("z", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    letters = s.join(cuts, list(key)).withColumn("a", F.when(F.col("z") <= F.col("c")[0], 0).when(F.col("z") <= F.col("c")[1], 1).otherwise(2))
    pairs = letters.withColumn("b", F.lead("a").over(w)).where("b is not null").groupBy(*key, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy(*key))
    motif = pairs.withColumn("p", p).groupBy(*key).agg(F.sum(-F.col("p") * F.ln("p")).alias("motif3_hh"))
    return side_by_side([from_acf, stretch, stderr, mode, motif], key)


def feature_matrix(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row a series with all features."""
    df = kept(df, "series")
    parts = [f(df, key) for f in (distribution_features, acf_features, peak_features, zero_crossing, spectral_features, entropy_features, histogram_entropy, dfa_exponent, hurst_exponent, canonical_features)]
    return side_by_side(parts, key)
