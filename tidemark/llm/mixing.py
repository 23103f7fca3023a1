"""Mixing sources to target weights by systematic sampling.

The share of the mix is split over the sources by weight (water-filling under a cap), every
document gets the expected copies of its source, and a prefix sum of these, shifted by one
random offset a source, emits the document once for every integer boundary it crosses.

Documents stand in order of size within their source, so the copies fall evenly over
short and long ones and the words taken stay near the target. The prefix sum is the rank of
the document times the copies a document; the rank is a bucket offset plus a rank within
the bucket (source, size, split), so that no task sees a whole source. Splits are ranges of doc_id, so the rank is that of
(size, doc_id) with any number of them.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import n_words, table, written

#: Documents per split of the ids, and splits at most; ranks are the same for any number of splits. The driver's sketch of the ids grows with the splits alone.
SPLIT_ROWS, MOST_SPLITS = 100_000, 1024


def in_splits(docs: DataFrame, splits: int) -> DataFrame:
    """``docs`` with mix_tie, which orders rows with one doc_id or none, and mix_split, ranges of (doc_id, mix_tie), null ids last.

    The bounds of the ranges are approximate quantiles of the ids, ``splits`` - 1 at most; where all ids are null there are none.
    """
    tied = docs.withColumn("mix_tie", F.xxhash64("text"))
    if splits == 1:
        return tied.withColumn("mix_split", F.lit(0))
    keyed = tied.withColumn("mix_key", F.col("doc_id").cast("double"))
    bounds = sorted(set(keyed.approxQuantile("mix_key", [i / splits for i in range(1, splits)], 1 / (4 * splits))))
    of_tie = F.floor((F.col("mix_tie").cast("double") / F.lit(2.0**64) + 0.5) * F.lit(splits)).cast("int")
    if not bounds:
        return keyed.withColumn("mix_split", of_tie).drop("mix_key")
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="mix_key", outputCol="mix_range", handleInvalid="keep")
    split = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1) + of_tie).otherwise(F.col("mix_range").cast("int"))
    return cut.transform(keyed).withColumn("mix_split", split).drop("mix_key", "mix_range")


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """``sizes`` has (mix_source, mix_source_size), a row a source; adds mix_target.

    With sources in order of cap * size / weight, let level k = (what is left to share after
    the first k sources take their caps) / (the weights from k on). It rises while sources
    are capped and falls afterwards, so its maximum is the common level of the uncapped.
    """
    by_name = W.orderBy(F.col("mix_source").asc_nulls_last())
    ranked = sizes.withColumn("mix_rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("mix_rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("mix_weight", weight).withColumn("mix_cap", F.col("mix_source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("mix_cap") / F.col("mix_weight"), "mix_rank")
    before = F.coalesce(F.sum("mix_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("mix_weight").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("mix_source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share))
    level = F.max("mix_level").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return (
        ranked.withColumn("mix_level", (total - before) / rest)
        .withColumn("mix_target", F.least(F.col("mix_cap"), F.col("mix_weight") * level))
        .select("mix_source", "mix_source_size", "mix_target")
    )


def mix_sources(
    docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, seed: str = "mix", keep: list[str] | None = None
) -> DataFrame:
    """Every row of ``docs`` with mix_size, mix_source_size, mix_target, mix_copies, mix_taken; of its columns those in ``keep``, or all.

    Sources stand in order of code points with null last; ``weights`` repeat over them. A null
    text has size 0. A source without words has target 0 and takes no copies. Repeated rows count each. An empty table gives an empty result.
    Columns whose names begin with ``mix_`` are replaced; all others pass through.
    """
    docs = docs.select([c for c in docs.columns if not c.startswith("mix_")])
    columns = docs.columns if keep is None else [c for c in keep if c in docs.columns]
    splits = min(MOST_SPLITS, max(1, docs.count() // SPLIT_ROWS))
    sized = in_splits(docs, splits).withColumn("mix_size", n_words("text"))
    sized = sized.select(*dict.fromkeys([*columns, "doc_id", "source", "mix_tie", "mix_split", "mix_size"]))
    if "text" not in columns:
        sized = written(sized, "sized")  # words are counted once; with the texts it would be a copy of the corpus
    buckets = sized.groupBy(F.col("source").alias("mix_source"), "mix_size", "mix_split").agg(F.count(F.lit(1)).alias("mix_n"))
    sources = buckets.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("mix_n")).alias("mix_source_size"))
    targets = source_targets(sources, share, weights, cap)
    # Prefix sums in two levels: over the sizes of a source, a row a size, and over the splits of a size.
    by_size = W.partitionBy("mix_source").orderBy("mix_size").rowsBetween(W.unboundedPreceding, -1)
    by_split = W.partitionBy("mix_source", "mix_size").orderBy("mix_split").rowsBetween(W.unboundedPreceding, -1)
    smaller = buckets.groupBy("mix_source", "mix_size").agg(F.sum("mix_n").alias("mix_n")).withColumn("mix_smaller", F.coalesce(F.sum("mix_n").over(by_size), F.lit(0)))
    smaller = smaller.select(F.col("mix_source").alias("mix_of"), F.col("mix_size").alias("mix_of_size"), "mix_smaller")
    buckets = buckets.join(smaller, F.expr("mix_source <=> mix_of and mix_size = mix_of_size"))
    buckets = buckets.withColumn("mix_before", F.col("mix_smaller") + F.coalesce(F.sum("mix_n").over(by_split), F.lit(0)))
    buckets = buckets.alias("b").join(targets.alias("t"), F.expr("b.mix_source <=> t.mix_source")).select(
        F.col("b.mix_source"), F.col("b.mix_size").alias("mix_bucket_size"), F.col("b.mix_split").alias("mix_bucket_split"),
        "mix_before", "mix_source_size", "mix_target",
    )
    same = F.expr("source <=> mix_source and mix_size = mix_bucket_size and mix_split = mix_bucket_split")
    rank = F.col("mix_before") + F.row_number().over(W.partitionBy("source", "mix_size", "mix_split").orderBy(F.col("doc_id").asc_nulls_last(), "mix_tie"))
    each = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (
        sized.join(buckets, same)
        .withColumns({"mix_rank": rank, "mix_each": each, "mix_offset": offset})
        .withColumn(
            "mix_copies",
            (F.floor(F.expr("mix_rank * mix_each + mix_offset")) - F.floor(F.expr("(mix_rank - 1) * mix_each + mix_offset"))).cast("long"),
        )
        .withColumn("mix_taken", F.col("mix_copies") * F.col("mix_size"))
        .select(*columns, "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    columns = [c for c in docs.columns if not c.startswith("mix_")]
    chosen = mix_sources(docs, **how).where("mix_copies > 0")
    return chosen.select(*columns, F.explode(F.expr("sequence(1L, mix_copies)")).alias("mix_copy")).select(*columns)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, keep=["doc_id"]).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"),
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM sources
), weighed AS (
  SELECT *, (CASE (k - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM ranked
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS r,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e,
    ('0x' || substr(md5('mix:' || coalesce(s.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(r * e + u) - floor((r - 1) * e + u))::BIGINT * size)::BIGINT AS taken
FROM placed
"""
