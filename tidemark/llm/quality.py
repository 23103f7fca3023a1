"""Quality rules with adaptive thresholds.

Every text is measured once. For each language and source, the ratios of its documents go
into quantile sketches: counts by logarithmic bucket, gamma ** (i - 1) < x <= gamma ** i,
which hold any quantile to a relative error of ``ALPHA`` (Masson, Rim and Lee 2019). Sketches
merge by adding counts, so sketches of a language or of the whole corpus come from the same
rows, and their result doesn't depend on order or partitions.

A ratio of a short text says little, so each comes with the error of its sampling: the bounds of Wilson's interval at
``ERRORS`` standard errors, for the mean word length as many standard errors, with half of the mean as the deviation. The sketches hold
upper bounds (of the mean word length the mean itself). To a group's sketch its language's and the corpus's are added, scaled to a weight of ``PRIOR`` documents each, so that
a small group leans on them and a large one stands by itself. The fences of a group lie ``REACH`` quartile distances beyond its quartiles, and
a document goes if its whole interval lies beyond a fence. No cutoff of a ratio is fixed, and groups of all sizes are treated alike.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import table, written

#: Relative error of the sketches.
ALPHA = 0.01
GAMMA = (1 + ALPHA) / (1 - ALPHA)
GAMMA_LN = math.log(GAMMA)
#: Bucket of values that are not above 0.
ZERO = -100_000
#: Documents that the language's and the corpus's sketch count as in each group's.
PRIOR = 100
#: Fences lie so many quartile distances beyond the quartiles; a ratio's interval reaches so many standard errors.
REACH, ERRORS = 3.0, 3.0
#: Share metrics: what is counted, and among how many.
SHARES = {"symbol_ratio": ("n_symbols", "word_chars"), "repeat_ratio": ("n_repeat_words", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines")}
#: The metric with a lower fence too.
MEAN = "mean_word_chars"
#: Fixed rules that hold everywhere.
MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measure_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of a text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen: dict = {}
            for i, window in enumerate(windows):
                seen.setdefault(window, []).append(i)
            covered = set()
            for places in seen.values():
                if len(places) > 1:
                    for i in places:
                        covered.update((i, i + 1, i + 2))
            repeated = len(covered)
    return len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), len(lines), repeated


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(x) for x in text], columns=MEASURES)


def intervals() -> dict[str, tuple[Column, Column, Column]]:
    """Metric: lower bound, upper bound, the value that goes into its sketch."""
    m = F.col("q_m")
    many = lambda c: F.greatest(m[c], F.lit(1)).cast("double")
    z, out = ERRORS, {}
    for name, (part, whole) in SHARES.items():
        n = many(whole)
        p = F.least(m[part] / n, F.lit(1.0))
        middle, error, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
        out[name] = ((middle - error) / scale, (middle + error) / scale, (middle + error) / scale)
    mean = m["word_chars"] / many("n_words")
    error = z * mean / (2 * F.sqrt(many("n_words")))
    return out | {MEAN: (mean - error, mean + error, mean)}


def base_failed() -> Column:
    m = F.col("q_m")
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])


def sketches(measured: DataFrame) -> DataFrame:
    """(q_lang, q_source, metric, bucket, n): one sketch a metric and group, of the documents that pass the fixed rules."""
    logs = F.array(*[
        F.struct(F.lit(k).alias("metric"), F.when(v > 0, F.ceil(F.ln(v) / F.lit(GAMMA_LN))).otherwise(F.lit(ZERO)).cast("int").alias("bucket"))
        for k, (_, _, v) in intervals().items()
    ])
    long = measured.where(~base_failed()).select("q_lang", "q_source", F.explode(logs).alias("x"))
    return long.groupBy("q_lang", "q_source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).cast("double").alias("n"))


def fences(measured: DataFrame) -> DataFrame:
    """(q_lang, q_source, q_lows, q_highs): maps from metric to fence, of every group with documents that pass the fixed rules."""
    leaf = sketches(measured)
    lang = leaf.groupBy("q_lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    corpus = lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    scaled = lambda df, by: df.withColumn("n", F.lit(float(PRIOR)) * F.col("n") / F.sum("n").over(W.partitionBy(*by)))
    group = ["q_lang", "q_source", "metric"]
    groups = leaf.select(*group).distinct()
    parts = leaf.unionByName(groups.join(scaled(lang, ["q_lang", "metric"]), ["q_lang", "metric"])).unionByName(groups.join(scaled(corpus, ["metric"]), "metric"))
    w = W.partitionBy(*group)
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(F.lit(2.0) * F.pow(F.lit(GAMMA), F.col("bucket").cast("double")) / F.lit(GAMMA + 1))
    ranked = parts.groupBy(*group, "bucket").agg(F.sum("n").alias("n")).withColumns({
        "upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("n").over(w), "value": value,
    })
    # The small part spares counts that are sums of fractions.
    quartile = lambda q: F.min(F.when(F.col("upto") >= F.col("total") * F.lit(q - 1e-9), F.col("value")))
    quartiles = ranked.groupBy(*group).agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    reach = F.lit(REACH) * (F.col("q3") - F.col("q1"))
    return quartiles.groupBy("q_lang", "q_source").agg(
        F.map_from_entries(F.collect_list(F.struct("metric", (F.col("q1") - reach).alias("low")))).alias("q_lows"),
        F.map_from_entries(F.collect_list(F.struct("metric", (F.col("q3") + reach).alias("high")))).alias("q_highs"),
    )


def quality_verdicts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with q_m (the measures), q_base_failed and q_kept; of its columns those in ``keep``, or all.

    Null and empty texts measure 0 and fail the fixed rules. Null languages and sources form groups of their own, together with empty names. An empty table gives an empty result; repeated rows count each.
    If no document passes the fixed rules there are no fences, and none is needed. Columns whose names begin with ``q_`` are replaced; all others pass through.
    """
    columns = [c for c in (docs.columns if keep is None else keep) if not c.startswith("q_")]
    group = {"q_lang": F.coalesce("lang", F.lit("")), "q_source": F.coalesce("source", F.lit(""))}
    measured = docs.select(*[F.col(f"`{c}`") for c in columns], *[v.alias(k) for k, v in group.items()], measures(F.col("text")).alias("q_m"))
    measured = written(measured, "measured")  # the texts are measured once
    fine = F.lit(True)
    for k, (low, high, _) in intervals().items():
        fine = fine & (low <= F.col("q_highs")[k])
        if k == MEAN:
            fine = fine & (high >= F.col("q_lows")[k])
    return (
        measured.join(fences(measured), ["q_lang", "q_source"], "left")
        .withColumn("q_base_failed", base_failed())
        .withColumn("q_kept", ~F.col("q_base_failed") & F.coalesce(fine, F.lit(True)))
        .select(*[F.col(f"`{c}`") for c in columns], "q_m", "q_base_failed", "q_kept")
    )


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_verdicts(docs, ["doc_id"]).select(
        "doc_id", *[F.col(f"q_m.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"),
    )


_VALUE = "CASE WHEN bucket = {zero} THEN 0.0 ELSE 2.0 * pow({g!r}, bucket) / ({g!r} + 1) END".format(zero=ZERO, g=GAMMA)
_Z2 = ERRORS * ERRORS
_SHARE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, base_failed, '{k}' AS metric, least({a} / greatest({b}, 1), 1.0::DOUBLE) AS p, greatest({b}, 1)::DOUBLE AS n FROM r" for k, (a, b) in SHARES.items()
)

OP6_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), dup AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), tri AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), rep AS (
  SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY 1
), m AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM t LEFT JOIN dup ON dup.doc_id = t.doc_id LEFT JOIN cov ON cov.doc_id = t.doc_id
), r AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM m
), shares AS (
  {_SHARE_SQL}
), x AS (
  SELECT doc_id, lang, source, base_failed, metric, (p + {_Z2} / (2 * n) - {ERRORS} * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n))) / (1 + {_Z2} / n) AS lower,
    (p + {_Z2} / (2 * n) + {ERRORS} * sqrt(p * (1 - p) / n + {_Z2} / (4 * n * n))) / (1 + {_Z2} / n) AS upper, upper AS v FROM shares
  UNION ALL SELECT doc_id, lang, source, base_failed, '{MEAN}', w - e, w + e, w FROM (
    SELECT *, word_chars / greatest(n_words, 1) AS w, {ERRORS}::DOUBLE * w / (2 * sqrt(greatest(n_words, 1)::DOUBLE)) AS e FROM r)
), leaf AS (
  SELECT lang, source, metric, CASE WHEN v > 0 THEN ceil(ln(v) / {GAMMA_LN!r})::INT ELSE {ZERO} END AS bucket, count(*)::DOUBLE AS n FROM x WHERE NOT base_failed GROUP BY ALL
), by_lang AS (
  SELECT lang, metric, bucket, {PRIOR} * sum(n) / sum(sum(n)) OVER (PARTITION BY lang, metric) AS n FROM leaf GROUP BY lang, metric, bucket
), by_corpus AS (
  SELECT metric, bucket, {PRIOR} * sum(n) / sum(sum(n)) OVER (PARTITION BY metric) AS n FROM leaf GROUP BY metric, bucket
), groups AS (
  SELECT DISTINCT lang, source FROM r
), c AS (
  SELECT lang, source, metric, bucket, sum(n) AS n FROM (
    SELECT * FROM leaf UNION ALL SELECT g.lang, g.source, b.metric, b.bucket, b.n FROM groups g JOIN by_lang b ON b.lang = g.lang UNION ALL SELECT g.lang, g.source, b.metric, b.bucket, b.n FROM groups g, by_corpus b)
  GROUP BY ALL
), s AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total, {_VALUE} AS value FROM c
), q AS (
  SELECT lang, source, metric, min(value) FILTER (upto >= total * (0.25 - 1e-9)) AS q1, min(value) FILTER (upto >= total * (0.75 - 1e-9)) AS q3 FROM s GROUP BY ALL
), v AS (
  SELECT x.doc_id, bool_and(coalesce(x.lower <= q3 + {REACH} * (q3 - q1) AND (x.metric <> '{MEAN}' OR x.upper >= q1 - {REACH} * (q3 - q1)), true)) AS fine
  FROM x LEFT JOIN q ON q.lang = x.lang AND q.source = x.source AND q.metric = x.metric GROUP BY 1
)
SELECT r.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  base_failed, NOT base_failed AND fine AS kept FROM r JOIN v ON v.doc_id = r.doc_id
"""
