"""Labelled vectors (id, label, v array<double or float>): distances, components, clusters, classifiers, splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.linkage import cut_linkage, ward_linkage
from tidemark.operators.networks import Dense, predicted, prepared, steady
from tidemark.operators.networks import train as train_network
from tidemark.operators.profile import percentile_of_pair
from tidemark.sources.tables import ranged


def euclidean(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, d) -> s + d))")


def cosine(a: str, b: str) -> Column:
    """1 less the cosine; null for a zero vector."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p as double) * q), 0D, (s, d) -> s + d)"
    return F.expr(f"1 - try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)}))")


#: Bytes of training vectors that meet test rows in a task, and rows of a block.
TRAIN_BYTES, BLOCK_ROWS = 8 << 20, 4096
METRICS = {"euclidean": euclidean, "cosine": cosine}


def unordered_pairs(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Every two rows once, columns with suffixes _a and _b. Quadratic: for tables of groups, not of rows."""
    a = df.select(*[F.col(c).alias(f"{c}_a") for c in [key, *columns]])
    b = df.select(*[F.col(c).alias(f"{c}_b") for c in [key, *columns]])
    return a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))


def pairwise_distance(df: DataFrame, key: str, vec: str, metric: str = "euclidean") -> DataFrame:
    pairs = unordered_pairs(df, key, [vec])
    return pairs.select(f"{key}_a", f"{key}_b", METRICS[metric](f"{vec}_a", f"{vec}_b").alias("distance"))


def nearest_farthest(pairs: DataFrame, key: str) -> DataFrame:
    """The closest and the farthest pair, with column kind."""
    ties = [f"{key}_a", f"{key}_b"]
    near = pairs.orderBy("distance", *ties).limit(1).withColumn("kind", F.lit("nearest"))
    return near.unionByName(pairs.orderBy(F.desc("distance"), *ties).limit(1).withColumn("kind", F.lit("farthest")))


def most_atypical(pairs: DataFrame, key: str) -> DataFrame:
    """(key, mean_distance) to all others."""
    both = pairs.select(F.col(f"{key}_a").alias(key), "distance").unionByName(pairs.select(F.col(f"{key}_b").alias(key), "distance"))
    return both.groupBy(key).agg(F.avg("distance").alias("mean_distance"))


def centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """The mean vector of each label."""
    means = df.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(label).agg(F.transform(rows, lambda r: r["m"]).alias("centroid"))


def class_similarity(df: DataFrame, label: str, vec: str, metric: str = "euclidean") -> DataFrame:
    """Distances of class centroids, and the share of pairs that are closer."""
    return percentile_of_pair(pairwise_distance(centroids(df, label, vec), label, "centroid", metric))


def silhouette(df: DataFrame, key: str, vec: str, cluster: str) -> DataFrame:
    """(key, cluster, silhouette) by plain Euclidean distance to all others; 0 for clusters of one. Keys are unique.

    Rows are cut into blocks; every two blocks meet in a task of bounded size, and only sums of distances by row and cluster leave it.
    """
    n = max(1, -(-df.count() // BLOCK_ROWS))
    block, every = F.pmod(F.xxhash64(key), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = df.select(F.col(key).cast("string").alias("key"), F.col(cluster).cast("string").alias("cluster"), F.col(vec).cast("array<double>").alias("v"), block.alias("own"))
    a = plain.withColumnRenamed("own", "i").withColumn("j", every)
    b = plain.select(F.col("key").alias("other"), F.col("cluster").alias("theirs"), F.col("v").alias("w"), F.col("own").alias("j"), every.alias("i"))

    def sums(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(others):
            y, theirs = np.stack(others["w"].to_numpy()), others["other"].to_numpy()
            groups = {c: np.flatnonzero(others["theirs"].to_numpy() == c) for c in others["theirs"].unique()}
            for own, mine, v in zip(rows["key"], rows["cluster"], rows["v"]):
                d = np.sqrt(((y - v) ** 2).sum(1))
                for c, at in groups.items():
                    at = at[theirs[at] != own]
                    if len(at):
                        out.append((own, mine, c, float(d[at].sum()), len(at)))
        return pd.DataFrame(out, columns=["key", "cluster", "c", "d", "n"])

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(sums, "key string, cluster string, c string, d double, n long")
    mean = found.groupBy("key", "cluster", "c").agg((F.sum("d") / F.sum("n")).alias("d"))
    own, other = F.max(F.when(F.col("c") == F.col("cluster"), F.col("d"))), F.min(F.when(F.col("c") != F.col("cluster"), F.col("d")))
    value = F.when(F.col("own").isNull() | F.col("other").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.expr("try_divide(other - own, greatest(own, other))"), F.lit(0.0)))
    kinds = dict(df.dtypes)
    rows = mean.groupBy("key", "cluster").agg(own.alias("own"), other.alias("other"))
    return rows.select(F.col("key").cast(kinds[key]).alias(key), F.col("cluster").cast(kinds[cluster]).alias(cluster), value.alias("silhouette"))


def _features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def pca(df: DataFrame, key: str, columns: Sequence[str], k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of columns that are already standardised: scores (key, component, score), variance (component, explained, cumulative), loadings
    (component, feature, loading). Each component's largest loading is positive."""
    spark, rows = df.sparkSession, _features(df, columns)
    model = PCA(k=k, inputCol="features", outputCol="scores").fit(rows)
    matrix = model.pc.toArray()
    signs = [1.0 if matrix[abs(matrix[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    flip = F.array(*map(F.lit, signs))
    scores = model.transform(rows).select(key, F.posexplode(F.zip_with(vector_to_array("scores"), flip, lambda a, b: a * b)).alias("component", "score"))
    explained = [float(x) for x in model.explainedVariance.toArray()]
    variance = spark.createDataFrame([(i, e, sum(explained[: i + 1])) for i, e in enumerate(explained)], "component int, explained double, cumulative double")
    loadings = spark.createDataFrame(
        [(i, c, float(matrix[j, i] * signs[i])) for i in range(k) for j, c in enumerate(columns)], "component int, feature string, loading double"
    )
    return scores, variance, loadings


def top_loadings(loadings: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature")
    return loadings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _clusters(df: DataFrame, key: str, vec: str, ks: Sequence[int], make) -> DataFrame:
    rows = df.select(key, vec, array_to_vector(F.col(vec).cast("array<double>")).alias("features")).cache()
    out = None
    for k in ks:
        model = make(k).fit(rows)
        found = model.transform(rows).select(key, vec, F.col("prediction").alias("cluster"))
        part = silhouette(found, key, vec, "cluster").select(key, F.lit(k).alias("k"), "cluster", "silhouette", F.lit(float(model.summary.trainingCost)).alias("inertia"))
        out = part if out is None else out.unionByName(part)
    rows.unpersist()
    return out


def kmeans(df: DataFrame, key: str, vec: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """(key, k, cluster, silhouette, inertia) for every number of clusters."""
    return _clusters(df, key, vec, ks, lambda k: KMeans(k=k, seed=seed, featuresCol="features"))


def bisecting_groups(df: DataFrame, key: str, vec: str, ks: Sequence[int], seed: int = 7) -> DataFrame:
    """As kmeans, by bisecting: the clusters of k + 1 split those of k."""
    return _clusters(df, key, vec, ks, lambda k: BisectingKMeans(k=k, seed=seed, featuresCol="features"))


def hierarchical_groups(df: DataFrame, key: str, vec: str, ks: Sequence[int]) -> DataFrame:
    """(key, k, cluster, silhouette, inertia): Ward's linkage cut into every number of clusters."""
    cut = cut_linkage(ward_linkage(df, key, vec), df, key, ks)
    out = None
    for k in ks:
        found = cut.where(F.col("k") == k).join(df.select(key, vec), key)
        part = silhouette(found, key, vec, "cluster").select(key, F.lit(k).alias("k"), "cluster", "silhouette")
        out = part if out is None else out.unionByName(part)
    return out.join(cut.select("k", "inertia").distinct(), "k").select(key, "k", "cluster", "silhouette", "inertia")


def best_k(clusters: DataFrame) -> DataFrame:
    """(k, inertia, silhouette, best): the best has the greatest mean silhouette."""
    by_k = clusters.groupBy("k").agg(F.first("inertia").alias("inertia"), F.avg("silhouette").alias("silhouette"))
    return by_k.withColumn("best", F.row_number().over(W.orderBy(F.desc("silhouette"), "k")) == 1)


def with_next(df: DataFrame, label: str, order: Sequence[str | Column], vec: str, name: str) -> DataFrame:
    """Column ``name``: the vector of the next row of the label, null for its last.

    Ranges of (label, order) are walked by themselves; the first vector of each range goes to the range before, so that no task holds a whole label. Rows with a null label are one
    sequence; of rows with one place in the order any may be the next.
    """
    places = {f"__o{i}": c if isinstance(c, Column) else F.col(c) for i, c in enumerate(order)}
    rows = ranged(df.withColumns(places), label, *places)
    firsts = rows.groupBy(label, "__part").agg(F.min_by(vec, F.struct(*places)).alias("__first"))
    firsts = firsts.select(F.col(label).alias("__label"), F.col("__part").alias("__in"), F.lead("__first").over(W.partitionBy(label).orderBy("__part")).alias("__then"))
    near = W.partitionBy(label, "__part").orderBy(*places)
    joined = rows.join(firsts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__part") == F.col("__in")))
    # By number, since the next row of the range may itself have no vector.
    is_last = F.row_number().over(near) == F.count(F.lit(1)).over(W.partitionBy(label, "__part"))
    return joined.withColumn(name, F.when(is_last, F.col("__then")).otherwise(F.lead(vec).over(near))).select(*df.columns, name)


def adjacent_vs_distant(df: DataFrame, label: str, order: str, vec: str, seed: int = 7) -> DataFrame:
    """(label, adjacent, distant): mean absolute difference of neighbours, and of vectors paired by a seeded order."""
    gap = F.expr(f"aggregate(zip_with({vec}, __n, (x, y) -> abs(cast(x as double) - y)), 0D, (s, d) -> s + d) / size({vec})")
    mean = lambda how, name: with_next(df, label, how, vec, "__n").where("__n is not null").groupBy(label).agg(F.avg(gap).alias(name))
    return mean([order], "adjacent").join(mean([F.pmod(F.col(order) * 7919 + seed, F.lit(104729)), order], "distant"), label)


def scramble(key: str | Column, seed: int) -> Column:
    """A fixed scramble of a key: the md5 of its text and the seed."""
    return F.md5(F.concat_ws(":", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed))))


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """Exactly n rows of every label, or all if it has fewer: those of least scramble of the key, then of least key. Of rows that repeat a key any may be taken.

    Counts by label and slice, the first three digits of the scramble, say up to which slice the n rows reach; only the rows of those slices are ranked.
    """
    rows = df.withColumn("__s", scramble(key, seed)).withColumn("__slice", F.substring("__s", 1, 3))
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__slice").alias("__in")).agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy("__label").orderBy("__in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = counts.withColumn("__before", before).where(F.col("__before") < n).groupBy("__label").agg(F.max("__in").alias("__upto"))
    some = rows.join(reached, F.col(label).eqNullSafe(F.col("__label"))).where(F.col("__slice") <= F.col("__upto"))
    k = F.row_number().over(W.partitionBy(label).orderBy("__s", key))
    return some.withColumn("__k", k).where(F.col("__k") <= n).select(*df.columns)


def stratified_split(df: DataFrame, label: str, key: str, shares: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.15), ("test", 0.15)), seed: int = 7) -> DataFrame:
    """Column split with floor(n * share) rows of each label for every name, the rest for the last.

    A row's rank in its label is that within its slice, by the first two digits of the scramble, and the counts of the slices before, so that no task holds a whole label.
    """
    rows = df.withColumn("__s", scramble(key, seed)).withColumn("__slice", F.substring("__s", 1, 2))
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__slice").alias("__in")).agg(F.count(F.lit(1)).alias("__c"))
    every = W.partitionBy("__label")
    before = F.coalesce(F.sum("__c").over(every.orderBy("__in").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__label", "__in", before.alias("__before"), F.sum("__c").over(every).alias("__n"))
    rows = rows.join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__slice") == F.col("__in")))
    k = F.col("__before") + F.row_number().over(W.partitionBy(label, "__slice").orderBy("__s", key))
    out, upto = None, F.lit(0)
    for name, share in shares[:-1]:
        upto = upto + F.floor(F.col("__n") * F.lit(float(share)))
        out = F.when(F.col("__k") <= upto, name) if out is None else out.when(F.col("__k") <= upto, name)
    return rows.withColumn("__k", k).withColumn("split", out.otherwise(shares[-1][0])).select(*df.columns, "split")


def block_split(df: DataFrame, label: str, frame: str, block: int, shares: Sequence[tuple[str, int]] = (("train", 70), ("val", 15), ("test", 15))) -> DataFrame:
    """Column split by blocks of neighbouring frames, so that no block is torn; shares in percent of a fixed scramble of (label, block)."""
    number = F.floor(F.col(frame) / block)
    mark = F.substring(scramble(F.concat_ws(":", F.col(label).cast("string"), number.cast("string")), 7), 1, 8)
    place = F.conv(mark, 16, 10).cast("long") % 100
    out, upto = None, 0
    for name, share in shares[:-1]:
        upto += share
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return df.withColumns({"block": number, "split": out.otherwise(shares[-1][0])})


def _vote(top: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(key, label, prediction) from neighbours (key, label, __k, __l, d): the vote of the k nearest, ties by nearness."""
    top = top.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("d", "__k"))).where(F.col("r") <= k)
    votes = top.groupBy(key, label, "__l").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first"))
    best = votes.withColumn("w", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))).where("w = 1")
    return best.select(key, label, F.col("__l").alias("prediction"))


def _neighbours(a: DataFrame, b: DataFrame, groups: Sequence[str], key: str, label: str, k: int) -> DataFrame:
    """(key, label, __k, __l, d): of every row of ``a`` (key, label, v) the k nearest rows of ``b`` in the same group; a group meets in one task, as one matrix product."""

    def nearest(tests: pd.DataFrame, trains: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(tests) and len(trains):
            trains = trains.sort_values("key")
            x, y = np.stack(tests["v"].to_numpy()), np.stack(trains["v"].to_numpy())
            keys, labels, least = trains["key"].to_numpy(), trains["label"].to_numpy(), min(k, len(trains))
            for i in range(0, len(x), 256):
                part = x[i : i + 256]
                square = (part * part).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * part @ y.T
                # A few more than k by the product, which is rounded, then the distances themselves.
                some = np.argpartition(square, min(least + 4, len(y)) - 1, axis=1)[:, : least + 4]
                for row, own, near in zip(tests.iloc[i : i + 256].itertuples(index=False), part, some):
                    near = np.sort(near)
                    d = np.sqrt(((y[near] - own) ** 2).sum(1))
                    for at in np.argsort(d, kind="stable")[:least]:
                        out.append((row.key, row.label, keys[near[at]], labels[near[at]], d[at]))
        return pd.DataFrame(out, columns=[key, label, "__k", "__l", "d"])

    return a.groupBy(*groups).cogroup(b.groupBy(*groups)).applyInPandas(nearest, f"`{key}` long, `{label}` string, __k long, __l string, d double")


def _plain(df: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))


def _voted(found: DataFrame, test: DataFrame, key: str, label: str, k: int) -> DataFrame:
    kind = dict(test.dtypes)
    return _vote(found, key, label, k).select(F.col(key).cast(kind[key]), F.col(label).cast(kind[label]), F.col("prediction").cast(kind[label]))


def nearest_rows(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int) -> DataFrame:
    """(key, label, __k, __l, d): the k nearest of all training rows at least, for every test row. Keys are unique.

    Test rows and training rows are cut into blocks by hash; every block of the one meets every block of the other in a task of
    bounded size, and only the k nearest of each test row and block leave it.
    """
    sizes = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("w")).first()
    n_train, n_test = max(1, -(-int(sizes["n"] or 0) * int(sizes["w"] or 1) * 8 // TRAIN_BYTES)), max(1, -(-test.count() // BLOCK_ROWS))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = _plain(test, key, label, vec).withColumn("i", block(n_test)).withColumn("j", every(n_train))
    b = _plain(train, key, label, vec).withColumn("j", block(n_train)).withColumn("i", every(n_test))
    return _neighbours(a, b, ["i", "j"], key, label, k)


def knn_classify(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int = 3) -> DataFrame:
    """(key, label, prediction): vote of the k nearest of all training rows, ties by nearness, then by key. Keys are unique."""
    return _voted(nearest_rows(train, test, key, label, vec, k), test, key, label, k)


#: Training rows, by a hash of the key, on which the centres of inverted lists are fitted.
LIST_SAMPLE = 20_000


def nearest_probed(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int, lists: int = 32, probes: int = 8, seed: int = 7) -> DataFrame:
    """As nearest_rows, but only within the ``probes`` of ``lists`` lists whose centres are nearest to the test row; every training row is in the list of its nearest centre.

    Centres are fitted on a bounded sample. Long lists are cut into blocks by hash, so that a hot list is many tasks; the work is that of all pairs times the share of rows in the probed lists.
    """
    n = train.count()
    if not n:
        return nearest_rows(train, test, key, label, vec, k)
    a, b = _plain(test, key, label, vec), _plain(train, key, label, vec)
    some = b.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, LIST_SAMPLE / n)))).select(array_to_vector("v").alias("features"))
    centers = np.array(KMeans(k=lists, seed=seed, maxIter=8).fit(some).clusterCenters())

    def lists_of(most: int):
        @F.pandas_udf("array<int>")
        def near(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=object)
            x = np.stack(rows.to_numpy())
            square = (centers * centers).sum(1)[None, :] - 2 * x @ centers.T
            return pd.Series(list(np.argsort(square, axis=1, kind="stable")[:, :most].astype(np.int32)), dtype=object)

        return near.asNondeterministic()

    rows, asked = b.withColumn("list", lists_of(1)("v")[0]), a.withColumn("list", F.explode(lists_of(min(probes, len(centers)))("v")))
    per_block = max(1, TRAIN_BYTES // (8 * centers.shape[1]))
    cuts = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(name))
    counts = cuts(rows, per_block, "n_j").join(cuts(asked, BLOCK_ROWS, "n_i"), "list")  # a row a list
    mine = lambda name: F.pmod(F.xxhash64("key"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = asked.join(F.broadcast(counts), "list").withColumn("i", mine("n_i")).withColumn("j", every("n_j"))
    right = rows.join(F.broadcast(counts), "list").withColumn("j", mine("n_j")).withColumn("i", every("n_i"))
    return _neighbours(left.select("key", "label", "v", "list", "i", "j"), right.select("key", "label", "v", "list", "i", "j"), ["list", "i", "j"], key, label, k)


def knn_classify_probed(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int = 3, lists: int = 32, probes: int = 8, seed: int = 7) -> DataFrame:
    """As knn_classify within probed lists; ``neighbour_recall`` says what that leaves out."""
    return _voted(nearest_probed(train, test, key, label, vec, k, lists, probes, seed), test, key, label, k)


def neighbour_recall(exact: DataFrame, found: DataFrame, key: str, k: int) -> DataFrame:
    """(recall): the share of the k nearest rows by ``exact`` that are among the k nearest by ``found``."""
    top = lambda df: df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("d", "__k"))).where(F.col("__r") <= k).select(key, "__k")
    hits = top(exact).join(top(found).withColumn("__hit", F.lit(1)), [key, "__k"], "left")
    return hits.agg((F.sum(F.coalesce("__hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def knn_classify_approx(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int = 3, reach: float = 1.0, bucket: float = 1.0, tables: int = 8, seed: int = 7) -> DataFrame:
    """As knn_classify over random-projection buckets, for training sets too large to compare with; rows without a neighbour within ``reach`` have no prediction."""
    v = lambda df: df.select(key, label, array_to_vector(F.col(vec).cast("array<double>")).alias("f"))
    train, test = v(train), v(test)
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(train)
    near = model.approxSimilarityJoin(test, train, reach, "d").select(F.col(f"datasetA.{key}").alias(key), F.col(f"datasetA.{label}").alias(label), F.col(f"datasetB.{key}").alias("__k"), F.col(f"datasetB.{label}").alias("__l"), "d")
    return _vote(near, key, label, k)


def _with_features(df: DataFrame, key: str, label: str, vec: str) -> DataFrame:
    return df.select(key, F.col(label).cast("double").alias(label), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))


def dense_classifier(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, layers: Sequence[int], seed: int = 7, iterations: int = 60) -> DataFrame:
    """(key, label, prediction) of a multilayer perceptron; layers from vector size to number of labels, which run from 0."""
    model = MultilayerPerceptronClassifier(layers=list(layers), labelCol=label, seed=seed, maxIter=iterations).fit(_with_features(train, key, label, vec))
    return model.transform(_with_features(test, key, label, vec)).select(key, label, "prediction")


def rectified_classifier(
    train: DataFrame, test: DataFrame, key: str, label: str, vec: str, hidden: Sequence[int] = (64, 32), dropout: float = 0.3, seed: int = 7, epochs: int = 12, batches: int = 3, rate: float = 0.01
) -> DataFrame:
    """(key, label, prediction) of rectified layers with dropout, trained by gradient sums over all tasks; labels run from 0.

    A fixed 15 % of the training rows, by a hash of the key, say when to stop and which parameters to keep. Components are brought to deviation 1 with one
    constant of the training rows.
    """
    whole = train.select(F.explode(F.col(vec).cast("array<double>")).alias("x")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    facts = train.agg(F.max(F.size(vec)).alias("w"), F.max(label).alias("top")).first()
    mean, deviation = steady(whole["m"] or 0), steady(whole["s"] or 1) or 1.0
    scaled = lambda df: df.select(key, label, F.transform(vec, lambda x: (x.cast("double") - mean) / deviation).alias("x"))
    network = Dense([int(facts["w"]), *hidden, int(facts["top"]) + 1], dropout)
    rows = scaled(train).withColumns({"y": F.array(F.col(label).cast("double")), "valid": F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < 15})
    flat, _ = train_network(prepared(rows, [key], "x", "y", "valid"), network, network.start(seed), epochs, batches, rate, seed=seed)
    found = predicted(scaled(test), network, flat, "x", "p")
    return found.select(key, F.col(label).cast("double").alias(label), (F.array_position("p", F.array_max("p")) - 1).cast("double").alias("prediction"))


def fourier_features(df: DataFrame, vec: str, size: int, features: int, gamma: float, seed: int, name: str) -> DataFrame:
    """``df`` with column ``name``: random Fourier features, whose products approach the kernel exp(-gamma |x - y|^2)."""
    r = np.random.default_rng(seed)
    turn, shift = r.normal(size=(size, features)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, features)

    @F.pandas_udf("array<double>")
    def turned(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / features) * np.cos(np.stack(rows.to_numpy()) @ turn + shift)) if len(rows) else [], dtype=object)

    return df.withColumn(name, array_to_vector(turned(vector_to_array(vec))))


def kernel_margin_classifier(
    train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int, features: int = 256, gamma: float | None = None, reg: float = 0.001, iterations: int = 30, seed: int = 7
) -> DataFrame:
    """(key, label, prediction) of scaling, principal components, a radial kernel by random Fourier features, and one-vs-rest margins.

    Without ``gamma`` it is 1 over k times the components' variance.
    """
    steps = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="components")]
    rows, others = _with_features(train, key, label, vec), _with_features(test, key, label, vec)
    first = Pipeline(stages=steps).fit(rows)
    if gamma is None:
        spread = first.transform(rows).select(F.explode(vector_to_array("components")).alias("x")).agg(F.var_pop("x")).first()[0]
        gamma = 1 / (k * spread) if spread else 1.0
    mapped = lambda df: fourier_features(first.transform(df), "components", k, features, float(gamma), seed, "turned")
    margin = LinearSVC(maxIter=iterations, regParam=reg, featuresCol="turned", labelCol=label)
    kept = mapped(rows).select(key, label, "turned").cache()
    model = OneVsRest(parallelism=8, classifier=margin, featuresCol="turned", labelCol=label).fit(kept)
    kept.unpersist()
    return model.transform(mapped(others)).select(key, label, "prediction")


def margin_classifier(train: DataFrame, test: DataFrame, key: str, label: str, vec: str, k: int, reg: float = 0.01, iterations: int = 20) -> DataFrame:
    """(key, label, prediction) of scaling, principal components and one-vs-rest linear margins."""
    steps = [
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="components"),
        OneVsRest(parallelism=8, classifier=LinearSVC(maxIter=iterations, regParam=reg, featuresCol="components", labelCol=label), featuresCol="components", labelCol=label),
    ]
    model = Pipeline(stages=steps).fit(_with_features(train, key, label, vec))
    return model.transform(_with_features(test, key, label, vec)).select(key, label, "prediction")


def tune_grid(train: DataFrame, valid: DataFrame, key: str, label: str, vec: str, ks: Sequence[int], regs: Sequence[float]) -> DataFrame:
    """(k, reg, accuracy, best) of margin classifiers on a fixed validation split.

    As margin_classifier for every k and reg, but rows are scaled and turned to components once: those of a smaller k are the first ones of the largest. A row a k and reg reaches the driver.
    """
    rows, others = _with_features(train, key, label, vec), _with_features(valid, key, label, vec)
    steps = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), PCA(k=max(ks), inputCol="scaled", outputCol="components")]).fit(rows)
    ready = lambda df: steps.transform(df).select(label, "components").cache()
    kept, held = ready(rows), ready(others)
    found = []
    for k in ks:
        first = VectorSlicer(inputCol="components", outputCol="first", indices=list(range(k)))
        some = first.transform(kept).select(label, "first").cache()
        for reg in regs:
            model = OneVsRest(parallelism=8, classifier=LinearSVC(maxIter=20, regParam=reg, featuresCol="first", labelCol=label), featuresCol="first", labelCol=label).fit(some)
            hit = model.transform(first.transform(held)).agg(F.avg((F.col(label) == F.col("prediction")).cast("double")).alias("accuracy"))
            found.append((k, float(reg), hit.first()["accuracy"]))
        some.unpersist()
    kept.unpersist()
    held.unpersist()
    out = train.sparkSession.createDataFrame(found, "k int, reg double, accuracy double")
    return out.withColumn("best", F.row_number().over(W.orderBy(F.desc("accuracy"), "k", "reg")) == 1)


def confusion(predictions: DataFrame, label: str) -> DataFrame:
    return predictions.groupBy(label, "prediction").agg(F.count(F.lit(1)).alias("n"))


def classification_report(predictions: DataFrame, label: str) -> DataFrame:
    """(label, support, precision, recall, f1, accuracy, macro_f1, chance): a row a label that occurs or is predicted."""
    cells = confusion(predictions, label)
    actual = cells.groupBy(F.col(label).alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col(label) == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("said"))
    rows = actual.join(said, "c", "full").select("c", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "hit", "said")])
    rows = rows.select(
        F.col("c").alias(label), "support", "hit", F.coalesce(F.expr("try_divide(hit, said)"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.expr("try_divide(hit, support)"), F.lit(0.0)).alias("recall"), F.coalesce(F.expr("try_divide(2.0D * hit, said + support)"), F.lit(0.0)).alias("f1"),
    )
    every = W.partitionBy()
    return rows.withColumns({"accuracy": F.sum("hit").over(every) / F.sum("support").over(every), "macro_f1": F.avg("f1").over(every), "chance": 1 / F.count(F.lit(1)).over(every)}).drop("hit")
