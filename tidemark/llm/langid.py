"""Language identification by a string kernel.

A text is the set of its byte n-grams of ``ORDERS`` lengths (a blended spectrum), in lower case and with zero bytes behind its end, each hashed to one of
``DIMENSIONS`` presence bits. The kernel of two texts is the size of their common set over
the root of the product of their sizes. Of a bounded sample of labelled rows some are Nyström landmarks; one ridge regression for
each language against the rest is fitted on the sample's kernel with the landmarks. A batch of
texts is scored by the product of its presence matrix with landmarks times weights, which is its
kernel matrix with the landmarks times the weights, reassociated so that the landmarks are multiplied once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fold, table
from tidemark.llm.hashing import chunks

ORDERS, DIMENSIONS_LOG2 = (2, 3, 4), 15
DIMENSIONS = 1 << DIMENSIONS_LOG2
#: Labelled rows that are fitted, and landmarks; more only where a language would be without one. These and the number of languages bound all that the driver holds.
MOST_ROWS, LANDMARKS = 1600, 256
RIDGE = 1e-4
UNKNOWN = "und"


def presence(raws: list[bytes]) -> np.ndarray:
    """(texts, DIMENSIONS) of 0 and 1."""
    gap = bytes(max(ORDERS) - 1)
    data = np.frombuffer(b"".join([x + gap for x in raws]), np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in raws])
    text = np.repeat(np.arange(len(raws)), sizes + len(gap))
    inside = np.repeat(np.cumsum(sizes + len(gap)) - len(gap), sizes + len(gap)) > np.arange(len(data))
    out = np.zeros((len(raws), DIMENSIONS), np.float32)
    key, n = np.zeros(len(data), np.uint32), len(data)
    for order in range(1, max(ORDERS) + 1):
        last = data[order - 1 :] if order > 1 else data
        key = key[: n - order + 1] << np.uint32(8) | last
        if order in ORDERS:
            bits = (key * np.uint32(2654435761) + np.uint32(order * 0x9E3779B1 % 2**32)) * np.uint32(2246822519) >> np.uint32(32 - DIMENSIONS_LOG2)
            use = inside[: len(bits)]
            out[text[: len(bits)][use], bits[use]] = 1
    return out


def _lower(texts: pd.Series) -> list[str]:
    return [(x or "").lower() for x in texts]


@F.pandas_udf(T.BinaryType())
def presence_bits(texts: pd.Series) -> pd.Series:
    return pd.Series([np.packbits(row.astype(bool)).tobytes() for _, raws in chunks(_lower(texts)) for row in presence(raws)], dtype=object)


def _kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    root = np.sqrt(np.maximum(rows.sum(1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(1), 1))[None, :]
    return rows @ landmarks.T / root


def fit(bits: list[bytes], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, DIMENSIONS x languages weights): the score of a language is presence @ weights / sqrt(size)."""
    names = sorted(set(langs))
    packed = np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1)
    unpack = lambda x: np.unpackbits(x, axis=1).astype(np.float32)
    # Landmarks in turn from every language, one of each at least.
    turns = sorted(range(len(langs)), key=lambda i, seen={}: (seen.setdefault(langs[i], []).append(i) or len(seen[langs[i]]), langs[i]))  # noqa: B006
    marks = unpack(packed[turns[: max(LANDMARKS, len(names))]])
    kernel = np.concatenate([_kernel(unpack(packed[i : i + 128]), marks) for i in range(0, len(packed), 128)]).astype(float)
    target = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    own = _kernel(marks, marks).astype(float)
    left = kernel.T @ kernel + RIDGE * len(langs) * own + 1e-8 * np.eye(len(marks))
    weights = np.linalg.solve(left, kernel.T @ target)
    scaled = marks / np.sqrt(np.maximum(marks.sum(1), 1))[:, None]
    return names, (scaled.T @ weights).astype(np.float32)


def training_sample(docs: DataFrame, held: int = 0, parts: int = 5) -> DataFrame:
    """(lang, bits) of at most MOST_ROWS rows outside the held-out fold, or one a language if these are more: as many of each language as there are, up to an equal share."""
    rows = docs.where((fold("doc_id", parts) != held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    sizes = [(r["lang"], r["n"]) for r in sizes.collect()]
    if not sizes:
        return rows.select("lang", F.lit(0).alias("k"), F.lit(None).cast("binary").alias("bits")).limit(0)
    share = max(1, MOST_ROWS // len(sizes))
    # Twice the share by hash and some more, so that no language comes out with fewer, then exactly the share.
    cuts = docs.sparkSession.createDataFrame([(k, min(1.0, (2.0 * share + 40) / n)) for k, n in sizes], "lang string, part double")
    place = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(F.broadcast(cuts), "lang").withColumn("place", place).where("place < part")
    some = some.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("k") <= share)
    return some.select("lang", "k", presence_bits("text").alias("bits"))


def identify(docs: DataFrame, held: int = 0, parts: int = 5) -> DataFrame:
    """Every row of ``docs`` with li_lang and li_score (0 to 1).

    Learned from the text and lang of rows with fold(doc_id) != ``held``. Null texts and texts without a letter are ``und`` with
    score 0, and so is every text if no row is labelled. An empty table gives an empty result. Columns whose
    names begin with ``li_`` are replaced; all others pass through.
    """
    docs = docs.select([c for c in docs.columns if not c.startswith("li_")])
    sample = training_sample(docs.select("doc_id", "text", "lang"), held, parts).orderBy("lang", "k").collect() if "lang" in docs.columns else []
    if not sample:
        return docs.withColumns({"li_lang": F.lit(UNKNOWN), "li_score": F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(fit([bytes(r["bits"]) for r in sample], [r["lang"] for r in sample]))

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, weights = model.value
        for texts in batches:
            out = []
            for _, raws in chunks(_lower(texts)):
                rows = presence(raws)
                margin = rows @ weights / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]
                best = margin.argmax(1)
                out += [(names[i], min(1.0, max(0.0, (float(m) + 1) / 2))) for i, m in zip(best, margin.max(1))]
            yield pd.DataFrame(out, columns=["lang", "score"])

    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn("li_p", predict("text")).select(
        "*", F.when(known, F.col("li_p.lang")).otherwise(UNKNOWN).alias("li_lang"), F.when(known, F.col("li_p.score")).otherwise(0.0).alias("li_score")
    ).drop("li_p")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("li_lang").alias("lang_pred"), F.col("li_score").alias("score"))
