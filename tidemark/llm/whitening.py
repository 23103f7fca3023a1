"""Whitening of embeddings by an incremental eigendecomposition.

The covariance is that of the distinct vectors, the fit list. Exact integer sums give its mean first. Then

- every task keeps the spectrum (eigenvalues and eigenvectors) of the scatter of its own rows. A centred row v turns Q diag(d) Q' into Q diag(d) Q' + v v'; the new
  eigenvalues are the roots of the secular equation 1 + sum(z_i^2 / (d_i - t)) = 0 with z = Q'v. Components with a negligible z_i, and those with
  equal d, are deflated: they keep their eigenvalue, and only the others are solved for. A block of more rows than dimensions is first turned into as many rows as
  dimensions with the same scatter (the triangle of a QR step), so that the number of updates does not grow with the block;
- spectra are combined in a tree: the axes of one, scaled by the roots of their eigenvalues, are successive rank-one updates of another;
- a last pass over the fit list refines the result by Rayleigh-Ritz: the covariance in the basis found is summed over all tasks and its small eigenproblem solved.

What leaves a task, and what the driver holds, is of the size of one spectrum: d * d for vectors of d components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, written
from tidemark.llm.ptolemaic import _lists, matrix

SCALE, COMPONENTS = 256, 4
#: Rows of a block that is turned into one row a dimension, and spectra that one task combines.
BLOCK_ROWS, FAN_IN = 8192, 32
EPS = float(np.finfo(float).eps)
#: Steps after which a root that has not settled is left to bisection, and steps of that.
STEPS, HALVINGS = 20, 60

SPECTRUM = "node long, values array<double>, vectors array<double>"


def integers(rows: DataFrame, key: str, vec: str, scale: int = SCALE) -> DataFrame:
    """(key, x): floor(scale * component) of the vectors without null or non-finite entries. An entry that doesn't fit in 32 bits is an error."""
    good = f"`{vec}` is not null and not exists(`{vec}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return rows.where(good).select(F.col(key).alias("key"), F.expr(f"transform(`{vec}`, x -> cast(floor({scale} * cast(x as double)) as int))").alias("x"))


def secular_roots(d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The matrix of d_j - t_i for the roots t_i of 1 + sum(z_j^2 / (d_j - t)) = 0; ``d`` rises strictly and no z is 0.

    Root i lies between d_i and d_(i+1), the last one between d_n and d_n + z'z. Each is kept as its distance from the nearer pole, so that
    no difference loses digits. Steps are those of the rational function that fits the sums on both sides of the root; where one leaves the bracket, that is halved instead.
    """
    n, w = len(d), z * z
    if n == 1:
        return np.array([[-w[0]]])
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    rows = np.arange(n)
    # Which pole is nearer: the sign of the function in the middle says on which side the root is.
    middle = (d[None, :] - d[:, None]) - gap[:, None] / 2
    right = 1 + (w / middle).sum(1) < 0
    right[-1] = False
    base = np.where(right, np.minimum(rows + 1, n - 1), rows)
    poles = d[None, :] - d[base][:, None]
    low, high = np.where(right, -gap / 2, 0.0), np.where(right, 0.0, np.where(rows < n - 1, gap / 2, gap))
    shift = (low + high) / 2
    first = np.minimum(rows, n - 2)
    before = np.arange(n)[None, :] <= first[:, None]
    done = np.zeros(n, bool)
    for step in range(STEPS + HALVINGS):
        delta = poles - shift[:, None]
        terms = w / delta
        f = 1 + terms.sum(1)
        done |= np.abs(f) <= 4 * n * EPS * (1 + np.abs(terms).sum(1))
        if done.all():
            break
        low, high = np.where(f < 0, shift, low), np.where(f < 0, high, shift)
        half = (low + high) / 2
        if step >= STEPS:
            shift = np.where(done, shift, half)
            continue
        slopes = terms / delta
        whole, left = slopes.sum(1), np.where(before, slopes, 0).sum(1)
        one, two = delta[rows, first], delta[rows, first + 1]
        a, b, c = (one + two) * f - one * two * whole, one * two * f, f - one * left - two * (whole - left)
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            inner = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            outer = np.where(a >= 0, (a + root) / (2 * c), 2 * b / (a - root))
        move = np.where(rows < n - 1, inner, outer)
        done |= np.abs(move) <= 2 * EPS * np.abs(shift)
        tried = shift + move
        shift = np.where(done, shift, np.where(np.isfinite(tried) & (tried > low) & (tried < high), tried, half))
    return poles - shift[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of ``vectors`` diag(``values``) ``vectors``' + v v', values rising."""
    z = vectors.T @ v
    norm = float(z @ z)
    if norm == 0:
        return values, vectors
    values, vectors, z = values.copy(), vectors.copy(), z.copy()
    least = 8 * EPS * max(abs(float(values[-1])), norm)
    # Deflation: a component that the row hardly has, and all but one of components with (nearly) one value, turned so that the others hold nothing of the row.
    left, last = [], -1
    for j in np.flatnonzero(np.abs(z) * np.sqrt(norm) > least):
        if last >= 0:
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            if abs((values[j] - values[last]) * c * s) <= least:
                z[last], z[j] = 0.0, r
                vectors[:, last], vectors[:, j] = c * vectors[:, last] - s * vectors[:, j], s * vectors[:, last] + c * vectors[:, j]
                values[last], values[j] = c * c * values[last] + s * s * values[j], s * s * values[last] + c * c * values[j]
                left.pop()
        left.append(j)
        last = j
    left = np.array(left)
    # Turned values can be out of order by a rounding.
    left = left[np.argsort(values[left], kind="stable")]
    d, own = values[left], z[left]
    delta = secular_roots(d, own)  # d_j - t_i by (i, j)
    n = len(d)
    # The z for which the computed roots are exact (Gu and Eisenstat 1994), which makes the new vectors orthogonal.
    apart = d[:, None] - d[None, :]  # d_i - d_j by (i, j)
    np.fill_diagonal(apart, 1.0)
    ratio = -delta / apart
    product = np.where(np.arange(n)[:, None] == np.arange(n)[None, :], -delta, ratio)
    exact = np.sqrt(np.abs(np.exp(np.log(np.abs(product) + 1e-300).sum(0)))) * np.sign(own)
    turned = exact[:, None] / delta.T
    turned /= np.sqrt((turned * turned).sum(0))
    values[left] = d[np.arange(n)] - np.diag(delta)
    vectors[:, left] = vectors[:, left] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def add_rows(values: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after a rank-one update by each of ``rows``, which are centred."""
    if len(rows) > len(values):
        rows = np.linalg.qr(rows, mode="r")
    for v in rows:
        values, vectors = rank_one(values, vectors, v)
    return values, vectors


def combined(values: np.ndarray, vectors: np.ndarray, others: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of two scatters: the axes of the second are rank-one updates of the first."""
    for value, axis in zip(others, axes.T):
        if value > 0:
            values, vectors = rank_one(values, vectors, axis * np.sqrt(value))
    return values, vectors


def fit_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(rows, exact sum of every dimension) of the fit list."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, width + 1), np.int64)
        for batch in batches:
            total[0, 0] += batch.num_rows
            total[0, 1:] += matrix(batch.column("x"), np.int64).sum(0) if batch.num_rows else 0
        yield pa.RecordBatch.from_arrays([_lists(total, pa.int64())], names=["sums"])

    parts = fit.select("x").mapInArrow(sums, "sums array<long>").select(F.posexplode("sums").alias("place", "value"))
    found = {r["place"]: int(r["value"]) for r in parts.groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    return found.get(0, 0), [found.get(j, 0) for j in range(1, width + 1)]


def spectra(fit: DataFrame, mean: np.ndarray, block: int = BLOCK_ROWS) -> DataFrame:
    """(node, values, vectors), a row a task: the spectrum of the scatter of its rows about ``mean``."""
    width = len(mean)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, vectors, seen = np.zeros(width), np.eye(width), False
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                x = matrix(batch.column("x").slice(i, block), float) - mean
                values, vectors = add_rows(values, vectors, x)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), _lists(values[None, :], pa.float64()), _lists(vectors.reshape(1, -1), pa.float64())], names=["node", "values", "vectors"])

    return fit.select("x").mapInArrow(task, SPECTRUM)


def combine(parts: DataFrame, width: int, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of all of ``parts``, a written table, in a tree of groups of ``fan_in``."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable")
        values, vectors = np.zeros(width), np.eye(width)
        for i, (v, q) in enumerate(zip(rows["values"], rows["vectors"])):
            v, q = np.asarray(v), np.asarray(q).reshape(width, width)
            values, vectors = (v, q) if i == 0 else combined(values, vectors, v, q)
        return pd.DataFrame({"node": [rows["node"].iloc[0] // fan_in], "values": [values], "vectors": [vectors.ravel()]})

    most = parts.agg(F.max("node")).first()[0]
    while most is not None and most > 0:
        parts = parts.groupBy(F.expr(f"node div {fan_in}").alias("group")).applyInPandas(merge, SPECTRUM)
        most //= fan_in
    found = parts.collect()  # one row, or none
    return (np.array(found[0]["values"]), np.array(found[0]["vectors"]).reshape(width, width)) if found else (np.zeros(width), np.eye(width))


def products(fit: DataFrame, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance of the fit list in the columns of ``basis``, and the trace of its covariance; centred first, divisor the number of rows."""
    k = basis.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, one, trace, n = np.zeros((k, k)), np.zeros(k), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), float) - mean
                y = x @ basis
                square, one, trace, n = square + y.T @ y, one + y.sum(0), trace + float((x * x).sum()), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([_lists(np.concatenate([square.ravel(), one, [trace, n]])[None, :], pa.float64())], names=["sums"])

    parts = fit.select("x").mapInArrow(sums, "sums array<double>").select(F.posexplode("sums").alias("place", "value"))
    found = {r["place"]: r["value"] for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    total = np.array([found.get(i, 0.0) for i in range(k * k + k + 2)])
    n = max(total[-1], 1.0)
    one = total[k * k : k * k + k] / n
    return total[: k * k].reshape(k, k) / n - np.outer(one, one), float(total[-2] / n)


def eigen_components(fit: DataFrame, n: int, sums: list[int], block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the covariance of ``fit``, a written table of ``n`` distinct rows x."""
    mean = np.array(sums, float) / max(n, 1)
    values, vectors = combine(written(spectra(fit, mean, block), "spectra"), len(mean))
    basis = np.linalg.qr(vectors[:, ::-1])[0]
    inner, trace = products(fit, mean, basis)
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    return np.maximum(values[::-1], 0.0), basis @ turned[:, ::-1], trace


def whiten(rows: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every vector without null or non-finite entries, a row for each of the first ``components``.

    Vectors of another length than the commonest one (the longer of equally common ones) are dropped, too. Repeated rows count once in the fit and are each returned; null keys pass. A component along which the
    fit list does not vary has a null ``whitened`` and is left out of identity_error, which is null if none is left. A deviation that doesn't fit in a long is an error. An
    empty table gives an empty result. Other columns of ``rows`` are not read.
    """
    every = integers(rows.select(key, vec), key, vec, scale)
    lengths = every.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width = lengths[0]["width"] if lengths else 0
    every = every.where(F.size("x") == width)
    fit = written(every.select("x").distinct(), "fit-list")
    n, sums = fit_sums(fit, width)
    k = min(components, width)
    values, vectors, trace = eigen_components(fit, n, sums) if k else (np.zeros(0), np.zeros((0, 0)), 0.0)
    # Along which the list doesn't vary, a value is of the size of rounding.
    varies = [bool(values[i] > 64 * width * EPS * trace) for i in range(k)]
    scaled = np.stack([vectors[:, i] / np.sqrt(values[i]) if varies[i] else np.zeros(width) for i in range(k)], axis=1) if k else np.zeros((0, 0))
    kept = [i for i in range(k) if varies[i]]
    mean, total = np.array(sums, float) / max(n, 1), np.array(sums, object)
    error = float(np.abs(products(fit, mean, scaled[:, kept])[0] - np.eye(len(kept))).max()) if kept else None
    explained = [float(values[i] / trace) if trace > 0 else 0.0 for i in range(k)]
    exact = np.array([int(s) & (1 << 64) - 1 for s in total], np.uint64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = matrix(batch.column("x"), np.int64)
            # Modulo 2^64, which is exact if the sum fits; the same sum in doubles says whether it does.
            gap = x.astype(np.uint64) * np.uint64(n) - exact
            deviation = (gap * gap).sum(1).view(np.int64)
            about = ((x * float(n) - total.astype(float)) ** 2).sum(1)
            if (about > 9.2e18).any():
                raise OverflowError("a deviation doesn't fit in a long")
            w = (x - mean) @ scaled
            m = len(x)
            at = np.repeat(np.arange(m), k)
            skipped = np.tile(~np.array(varies), m)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(deviation[at]),
                    pa.array(w.ravel(), mask=skipped), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, np.nan if error is None else error), mask=np.full(m * k, error is None)),
                ],
                names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([every.schema["key"], *[T.StructField(name, kind) for name, kind in kinds]])
    return every.mapInArrow(project, schema).withColumnRenamed("key", key)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
