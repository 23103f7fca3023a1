"""Agglomerative clustering by Ward's criterion: pairs that are each other's nearest cluster merge, all of them in one round."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder

#: Clusters of a block; two blocks meet in a task.
BLOCK_ROWS = 2048


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def nearest_clusters(clusters: DataFrame, n: int) -> DataFrame:
    """(name, other, height) of every cluster (name, size, v): the least of the pairs it is in, by height, then by names, so that the least pair of all is the choice of both its clusters.

    The height sqrt(2 s t / (s + t)) |v - w| is Lance and Williams' update for Ward's criterion in closed form: sizes s, t and means v, w of two clusters are all it depends on. Clusters are cut into
    blocks; every two blocks meet in a task of bounded size, which gives the nearest one of each row alone.
    """
    blocks = max(1, -(-n // BLOCK_ROWS))
    own, every = F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = clusters.select("*", own.alias("i")).withColumn("j", every)
    b = clusters.select("*", own.alias("j")).withColumn("i", every)
    kind = clusters.schema["name"].dataType.simpleString()

    def nearest(rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(others):
            others = others.sort_values("name", kind="stable")
            names, sizes, means = others["name"].to_numpy(), others["size"].to_numpy(float), np.stack(others["v"].to_numpy())
            for name, size, mean in zip(rows["name"], rows["size"], rows["v"]):
                gap = means - mean
                square = 2 * size * sizes / (size + sizes) * (gap * gap).sum(1)
                square[names == name] = np.inf
                least = square.min()
                if np.isfinite(least):
                    # Of equally near ones the pair with the smaller names: the first in order, whether it is below or above this one.
                    out.append((name, names[int(square.argmin())], float(np.sqrt(least))))
        return pd.DataFrame(out, columns=["name", "other", "height"])

    found = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(nearest, f"name {kind}, other {kind}, height double")
    pair = F.struct("height", F.least("name", "other").alias("low"), F.greatest("name", "other").alias("high"), "other")
    return found.groupBy("name").agg(F.min(pair).alias("p")).select("name", "p.other", "p.height")


def ward_linkage(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(a, b, height, size): the merges of all rows into one cluster, one fewer than rows. A cluster is named by its least key, a is the smaller name and stays; the size is that of both.

    Keys are unique and not null, vectors of one length. Since the criterion is reducible, merging all reciprocal pairs of a round gives the merges of the one-by-one procedure, and a round costs as many
    comparisons as pairs of clusters left. Rows of equal vectors merge at height 0, in rounds that halve them at best.
    """
    clusters = _kept(df.select(F.col(key).alias("name"), F.lit(1).cast("long").alias("size"), F.col(vec).cast("array<double>").alias("v")), "clusters")
    n, merges = clusters.count(), None
    while n > 1:
        near = _kept(nearest_clusters(clusters, n), "nearest")
        back = near.select(F.col("name").alias("other"), F.col("other").alias("name"))
        pairs = near.join(back, ["name", "other"]).where(F.col("name") < F.col("other")).select(F.col("name").alias("a"), F.col("other").alias("b"), "height")
        left, right = (clusters.select(F.col("name").alias(x), F.col("size").alias(f"s{x}"), F.col("v").alias(f"v{x}")) for x in "ab")
        joined = _kept(pairs.join(left, "a").join(right, "b"), "merges")
        mean = F.expr("zip_with(va, vb, (x, y) -> (sa * x + sb * y) / (sa + sb))")
        merged = joined.select(F.col("a").alias("name"), (F.col("sa") + F.col("sb")).alias("size"), mean.alias("v"))
        gone = joined.select(F.explode(F.array("a", "b")).alias("name"))
        clusters = _kept(clusters.join(gone, "name", "left_anti").unionByName(merged), "clusters")
        part = joined.select("a", "b", "height", (F.col("sa") + F.col("sb")).alias("size"))
        merges, before = part if merges is None else merges.unionByName(part), n
        n = clusters.count()
        if n == before:
            raise ValueError("no two clusters are each other's nearest: keys repeat, or vectors hold NaN")
    kind = clusters.schema["name"].dataType.simpleString()
    return df.sparkSession.createDataFrame([], f"a {kind}, b {kind}, height double, size long") if merges is None else merges


def cut_linkage(merges: DataFrame, keys: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """(key, k, cluster, inertia): the clusters that are left when all merges but the last k - 1 are made, numbered from 0 by their least keys; the inertia is the sum of squares within all of them.

    Names point to the ones they went into, and pointers are followed by doubling, in as many joins as the logarithm of the longest chain.
    """
    order = W.orderBy(F.desc("height"), F.desc("a"), F.desc("b"))
    # The last merges are few: only those ranks are needed.
    last = merges.orderBy(F.desc("height"), F.desc("a"), F.desc("b")).limit(max(max(ks) - 1, 1)).withColumn("rank", F.row_number().over(order)).select("b", "rank")
    ranked = merges.join(F.broadcast(last), "b", "left")
    of_k = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    made = ranked.select("a", "b", "height", "rank", of_k).where("rank is null or rank >= k")
    inertia = made.groupBy("k").agg((F.sum(F.col("height") * F.col("height")) / 2).alias("inertia"))
    links = made.select("k", F.col("b").alias("name"), F.col("a").alias("to"))
    at = _kept(keys.select(F.col(key).alias("name"), of_k).join(links, ["k", "name"], "left").withColumn("to", F.coalesce("to", "name")), "pointers")
    while True:
        step = at.select("k", F.col("name").alias("to"), F.col("to").alias("further"))
        new = _kept(at.join(step, ["k", "to"]).select("k", "name", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")), "pointers")
        at = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            break
    numbers = at.select("k", "to").distinct().withColumn("cluster", F.row_number().over(W.partitionBy("k").orderBy("to")) - 1)
    rows = at.join(F.broadcast(numbers), ["k", "to"]).join(F.broadcast(inertia), "k", "left")
    return rows.select(F.col("name").alias(key), "k", "cluster", F.coalesce("inertia", F.lit(0.0)).alias("inertia"))
