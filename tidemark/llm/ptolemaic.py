"""Centroid clustering of integer vectors, with nearest centroids found by Ptolemaic pivots.

For any four points of a Euclidean space Ptolemy's inequality holds, so with two pivots p and q

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q).

The distances of every vector to a few fixed pivots are computed once and written beside it. In each round a centroid is paired with its
nearest pivot and every other one, and the greatest of these bounds says whether it can be the nearest one at all. Bounds are rounded downwards by more than
their arithmetic can be wrong; the centroids that survive are compared by exact integer distances, so that pivots change the work but never the result.

A round is one pass over the written table. Tasks return sums by centroid, which Spark adds; the driver holds the centroids alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, written

WIDTH, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Pivots, and the vectors of least hash among which they are chosen; both only change how much is pruned.
PIVOTS, PIVOT_SAMPLE = 12, 256
#: Greatest magnitude of a component, so that squared distances fit in 64 bits at up to 64 components.
LIMIT = 1 << 27
#: Rows that a task compares at once. Share by which a bound is lowered; its arithmetic is wrong by less than 2 ** -48.
ROWS, SLACK = 4096, 2.0**-44


def integers(vectors: DataFrame, key: str, vec: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(key, x): floor(scale * component) of the vectors with ``width`` components, none null or non-finite. Larger components than LIMIT are an error."""
    good = f"size(`{vec}`) = {width} and not exists(`{vec}`, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    floor = f"transform(`{vec}`, x -> floor({scale} * cast(x as double)))"
    small = F.expr(f"forall({floor}, x -> abs(x) <= {LIMIT})")
    x = F.when(small, F.expr(f"transform({floor}, x -> cast(x as int))")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT}")))
    return vectors.where(good).select(F.col(key).alias("key"), x.alias("x"))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to the row, or the rows, ``b``."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def distances(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``a`` to every one of ``points``."""
    return np.sqrt(np.stack([square_distances(a, p) for p in points], axis=1).astype(float)) if len(points) else np.zeros((len(a), 0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Vectors of the sample that are far from each other: each is the one farthest from those before it."""
    chosen, far = [], None
    for _ in range(min(n, len(sample))):
        at = 0 if far is None else int(far.argmax())
        if far is not None and far[at] == 0:
            break
        chosen.append(at)
        near = square_distances(sample, sample[at])
        far = near if far is None else np.minimum(far, near)
    return sample[chosen]


def lower_bounds(cached: np.ndarray, centers: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of the distance of every row to every centroid, from the rows' cached distances to the pivots."""
    out = np.zeros((len(cached), len(centers)))
    if len(pivots) < 2:
        return out
    own, between = distances(centers, pivots), distances(pivots, pivots)
    for c in range(len(centers)):
        s = int(own[c].argmin())
        q = np.flatnonzero(between[s] > 0)
        if len(q):
            a, b = cached[:, [s]] * own[c, q], cached[:, q] * own[c, s]
            out[:, c] = ((np.abs(a - b) - SLACK * (a + b)) / between[s, q]).max(axis=1)
    return np.maximum(out, 0)


def nearest(x: np.ndarray, cached: np.ndarray, centers: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance, exact comparisons) of every row; of equally near ones the smaller number."""
    cluster, best, checked = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64), np.ones(len(x), np.int32)
    for i in range(0, len(x), ROWS):
        rows, at = x[i : i + ROWS], slice(i, i + ROWS)
        low = lower_bounds(cached[at], centers, pivots)
        low *= low * (1 - SLACK)
        mine = low.argmin(axis=1)
        least = square_distances(rows, centers[mine])
        first, count = mine.copy(), checked[at]
        for c in range(len(centers)):
            left = np.flatnonzero((low[:, c] <= least * (1 + SLACK)) & (first != c))
            d = square_distances(rows[left], centers[c])
            better = (d < least[left]) | ((d == least[left]) & (c < mine[left]))
            mine[left[better]], least[left[better]] = c, d[better]
            count[left] += 1
        cluster[at], best[at] = mine, least
    return cluster, best, checked


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return values.reshape(len(column), -1)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width) if width else np.zeros(len(values) + 1), pa.int32()), pa.array(values.ravel(), kind))


def with_pivots(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (key, x) with p, the distances to the pivots."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = distances(matrix(batch.column("x"), np.int64), pivots)
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found, pa.float64())], names=["key", "x", "p"])

    return rows.mapInArrow(measure, T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))


def next_centers(cached: DataFrame, centers: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The floor of the mean of every centroid's vectors, componentwise; a centroid without any stays."""
    k, width = centers.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, width + 1), np.int64), False
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), np.int64)
                mine, seen = nearest(x, matrix(batch.column("p"), float), centers, pivots)[0], True
                order = np.argsort(mine, kind="stable")
                found, starts = np.unique(mine[order], return_index=True)
                total[found, 1:] += np.add.reduceat(x[order], starts)
                total[:, 0] += np.bincount(mine, minlength=k)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), _lists(total, pa.int64())], names=["cluster", "sums"])

    parts = cached.select("x", "p").mapInArrow(sums, "cluster int, sums array<long>").select("cluster", F.posexplode("sums").alias("place", "value"))
    total = {(r["cluster"], r["place"]): int(r["value"]) for r in parts.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    out = centers.copy()
    for c in range(k):
        if n := total.get((c, 0), 0):
            out[c] = [total[c, j] // n for j in range(1, width + 1)]
    return out


def assigned(cached: DataFrame, centers: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(key, cluster, distance, checked) of every vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(matrix(batch.column("x"), np.int64), matrix(batch.column("p"), float), centers, pivots)
                yield pa.RecordBatch.from_arrays([batch.column("key"), *map(pa.array, found)], names=["key", "cluster", "distance", "checked"])

    fields = [T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("checked", T.IntegerType())]
    return cached.mapInArrow(assign, T.StructType([cached.schema["key"], *fields]))


def center_hash(center: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in center).encode()).hexdigest()


def cluster_vectors(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, n_pivots: int = PIVOTS) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256, checked) of the vectors with ``width`` finite components.

    The first centroids are the vectors of least hash of seed and key, null keys last, equal hashes in order of components. Repeated rows count each. With fewer
    vectors than ``clusters`` each is a centroid. An empty table gives an empty result. Other columns of ``vectors`` are not read. ``checked`` is
    the number of centroids whose distance was computed in the end.
    """
    rows = integers(vectors.select(key, vec), key, vec, width, scale)
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256))
    sample = hashed.orderBy(F.col("h").asc_nulls_last(), "x").limit(max(clusters, PIVOT_SAMPLE)).collect()
    few = np.array([r["x"] for r in sample], np.int64).reshape(len(sample), width)
    centers, pivots = few[:clusters], choose_pivots(few, n_pivots)
    cached = written(with_pivots(rows, pivots), "pivot-distances")
    if len(centers):
        for _ in range(rounds):
            centers = next_centers(cached, centers, pivots)
    found = written(assigned(cached, centers, pivots), "assigned")
    # A row a centroid.
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(sums.values())
    facts = [(c, sums.get(c, 0), total, center_hash(x)) for c, x in enumerate(centers)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "checked")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("checked")


def _sql() -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS cluster, x FROM kept ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT k.row, k.vec_id, k.x, c.cluster, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept k, c{i} c "
            f"QUALIFY row_number() OVER (PARTITION BY k.row ORDER BY d, c.cluster) = 1)"
        )
        if i < ROUNDS:
            parts.append(
                f"s{i} AS MATERIALIZED (SELECT cluster, p, sum(v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, generate_subscripts(x, 1) AS p, unnest(x) AS v FROM a{i}) GROUP BY 1, 2),"
                f"m{i} AS MATERIALIZED (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM s{i} GROUP BY 1),"
                f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)"
            )
    last = f"""SELECT a.vec_id, a.cluster::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.cluster"""
    return "WITH " + ",\n".join(parts) + "\n" + last


OP11_SQL = _sql()
