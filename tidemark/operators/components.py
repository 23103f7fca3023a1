"""Principal components of wide vectors by block power iteration: no matrix of width x width anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(df: DataFrame, vec: str, make, size: int) -> np.ndarray:
    """The sum over all rows of ``make`` (a matrix of rows to a vector of ``size``): a vector a task, added by place."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(size), False
        for frame in frames:
            if len(frame):
                total, seen = total + make(np.stack(frame["v"].to_numpy()).astype(float)), True
        if seen:
            yield pd.DataFrame({"place": np.arange(size), "value": total})

    parts = df.select(F.col(vec).cast("array<double>").alias("v")).where("v is not null").mapInPandas(task, "place int, value double")
    out = np.zeros(size)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def power_components(df: DataFrame, vec: str, k: int, spare: int = 6, rounds: int = 60, tolerance: float = 1e-10, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean, unit components as columns, their variances, total variance), divisor rows less one, by rows of one width without nulls.

    A round is a pass that multiplies the covariance with a block of k + ``spare`` directions: each task returns width x block sums. Rayleigh-Ritz in the block gives the components; it ends
    when their residuals are below ``tolerance`` of the greatest variance. Each component's largest entry is positive.
    """
    width = int(df.agg(F.max(F.size(vec))).first()[0] or 0)
    if not width:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0
    first = _sums(df, vec, lambda x: np.concatenate([[len(x)], x.sum(0)]), width + 1)
    n, mean = first[0], first[1:] / first[0]
    total = float(_sums(df, vec, lambda x: np.array([((x - mean) ** 2).sum()]), 1)[0]) / max(n - 1, 1)
    block = min(k + spare, width)
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0]
    for _ in range(rounds):
        image = _sums(df, vec, lambda x: ((x - mean).T @ ((x - mean) @ basis)).ravel(), width * block).reshape(width, block) / max(n - 1, 1)  # noqa: B023
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        found, image = basis @ turn, image @ turn
        left = np.linalg.norm(image[:, :k] - found[:, :k] * values[:k], axis=0).max()
        if left <= tolerance * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(image)[0]
    found = found[:, :k]
    return mean, found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1.0, 1.0), values[:k], total


def power_pca(df: DataFrame, key: str, vec: str, k: int, **how) -> tuple[DataFrame, DataFrame]:
    """Scores (key, component, score) of centred vectors, and variance (component, explained, cumulative)."""
    mean, found, values, total = power_components(df, vec, k, **how)

    @F.pandas_udf("array<double>")
    def project(rows: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(rows.to_numpy()).astype(float) - mean) @ found) if len(rows) else [], dtype=object)

    scores = df.where(F.col(vec).isNotNull()).select(key, F.posexplode(project.asNondeterministic()(F.col(vec).cast("array<double>"))).alias("component", "score"))
    shares = [float(v / total) if total > 0 else 0.0 for v in values]
    return scores, df.sparkSession.createDataFrame([(i, s, sum(shares[: i + 1])) for i, s in enumerate(shares)], "component int, explained double, cumulative double")
