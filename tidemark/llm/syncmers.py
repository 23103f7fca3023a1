"""Document fingerprints from closed syncmers (Edgar 2021).

A run of ``K`` code points is an anchor if the least hash among its runs of ``S`` code points is that of the first
or the last of them. That depends on the run alone, so equal passages have equal anchors wherever they
stand. A fingerprint is the anchors' positions and hashes in order; two fingerprints are as alike
as the anchors that can be matched in the same order on both sides. Texts shorter than ``K`` have one anchor, the whole text. Texts with
fewer than ``K - S`` runs may have no syncmer; theirs is the run of least hash. So only empty texts have no anchor.

Every document is also compared with the next one in descending order of id. Documents are
cut into slices by quantiles of the id; the first document of each slice also goes to the slice before it, so
that all neighbours meet in one pass over sorted slices.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.hashing import BASE, mix

K, S = 32, 8
#: Documents of a slice, and the most and least slices.
SLICE_ROWS, MOST_SLICES, LEAST_SLICES = 4000, 10_000, 24

_FIRST = -(1 << 63)


def anchors(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(positions, 32-bit hashes) of the closed syncmers of a text, or of its run of least hash if it has none."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < K:
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        whole = int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:4], "little")
        return np.zeros(1, np.uint32), np.array([whole], np.uint32)
    h, step, power = points + np.uint64(1), 1, BASE
    while step < S:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % 2**64
    h = mix(h)
    least, covered, width = h, 1, K - S + 1
    while 2 * covered <= width:
        least = np.minimum(least[:-covered], least[covered:])
        covered *= 2
    if covered < width:
        least = np.minimum(least[: covered - width], least[width - covered :])
    at = np.flatnonzero((h[: len(least)] == least) | (h[width - 1 :] == least))
    none = not len(at)
    if none:
        at = np.arange(len(least))
    out = np.zeros(len(at), np.uint64)
    for j in range(0, K, S):
        out = mix(out + h[np.minimum(at + j, len(h) - 1)])
    if none:
        first = np.argmin(out)
        at, out = at[first : first + 1], out[first : first + 1]
    return at.astype(np.uint32), (out >> np.uint64(32)).astype(np.uint32)


def as_string(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The fingerprint: base64 of little-endian (position, hash) pairs."""
    return base64.b64encode(np.column_stack(found).astype("<u4").tobytes()).decode("ascii")


def from_string(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _ranked(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys that tell repeated hashes apart by their rank, and the anchors' order by key."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order].astype(np.uint64)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    return s << np.uint64(32) | (np.arange(len(s)) - first).astype(np.uint64), order


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Twice the longest common chain of anchors over the number of anchors; 1 for two empty fingerprints.

    Anchors match by hash and by rank among those of one hash: the second of them in one text matches the second in the other, and no other. So a chain has one match an
    anchor at most, however often a hash repeats, and takes n log n steps for any text; anchors 1, 2, 1 and 2, 1 have the chain (2) or (1), not (2, 1).
    """
    n = len(a[0]) + len(b[0])
    if not len(a[0]) or not len(b[0]):
        return 1.0 if n == 0 else 0.0
    (ka, oa), (kb, ob) = _ranked(a[1]), _ranked(b[1])
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    ia, jb = oa[i], ob[j]
    chain = jb[np.argsort(ia)]
    if (np.diff(chain) > 0).all():
        return 2 * len(chain) / n
    tails: list[int] = []
    for x in chain.tolist():
        at = bisect_left(tails, x)
        tails[at : at + 1] = [x]
    return 2 * len(tails) / n


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first code points of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _keyed(docs: DataFrame, *columns) -> DataFrame:
    """Rows with key and tie, which order them, and key_d, a number in the same order: rows without a doc_id lie below all others, by a hash of their text."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    number = F.when(F.col("doc_id").isNull(), F.lit(-(2.0**64)) + tie / 2).otherwise(F.col("doc_id").cast("double"))
    return docs.select(*columns, F.coalesce("doc_id", F.lit(_FIRST)).alias("key"), tie.alias("tie"), number.alias("key_d"))


def in_slices(docs: DataFrame) -> DataFrame:
    """(doc_id, text, slice, extra) in partitions sorted by slice and descending id, extra rows, which only follow others, last."""
    ids = _keyed(docs)
    n = ids.count()
    slices = max(1, min(MOST_SLICES, max(LEAST_SLICES, n // SLICE_ROWS), n))
    bounds = ids.approxQuantile("key_d", [i / slices for i in range(1, slices)], 1 / (4 * slices)) if slices > 1 else []
    cut = Bucketizer(splits=[-float("inf"), *sorted(set(bounds)), float("inf")], inputCol="key_d", outputCol="slice", handleInvalid="keep")
    # At most MOST_SLICES rows.
    tops = sorted((r["slice"], r["top"]["key"], r["top"]["tie"]) for r in cut.transform(ids).groupBy("slice").agg(F.max(F.struct("key", "tie")).alias("top")).collect())
    sent = [(key, tie, tops[(i + 1) % len(tops)][0]) for i, (_, key, tie) in enumerate(tops)]
    sent = docs.sparkSession.createDataFrame(sent, "key long, tie long, also double")
    placed = cut.transform(_keyed(docs, "doc_id", F.coalesce("text", F.lit("")).alias("text"))).join(F.broadcast(sent), ["key", "tie"], "left")
    own = F.struct(F.col("slice"), F.lit(False).alias("extra"))
    copies = F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("also").alias("slice"), F.lit(True).alias("extra"))))
    rows = placed.select("doc_id", "text", "key", "tie", F.explode(copies).alias("s")).select("doc_id", "text", "key", "tie", F.col("s.slice").cast("int").alias("slice"), "s.extra")
    # By ranges, so that each slice has a task of its own.
    return rows.repartitionByRange(slices, "slice").sortWithinPartitions("slice", "extra", F.desc("key"), F.desc("tie")).drop("key", "tie")


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last = None
    for frame in batches:
        out = []
        for doc_id, text, piece, extra in zip(frame["doc_id"], frame["text"], frame["slice"], frame["extra"]):
            now = (doc_id, text, anchors(text), piece, extra)
            if last is not None and not last[4] and last[3] == piece:
                changed = edited(last[1], text)
                found = anchors(changed)
                out.append((
                    last[0], len(last[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_string(last[2]), as_string(found),
                    likeness(last[2], found), likeness(last[2], now[2]),
                ))
            last = now
        out = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty, with an empty fingerprint; two empty fingerprints are alike (1), an empty one and another are not (0). A null doc_id
    comes last; rows with the same doc_id follow each other in any fixed order. The last document is followed by the first, a single one by itself. An empty table gives an empty
    result. Columns other than doc_id and text are not read.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    # Ids go through Python as text: beside nulls pandas would make them floating-point numbers.
    rows = in_slices(docs).withColumn("doc_id", F.col("doc_id").cast("string"))
    found = rows.mapInPandas(_compare, schema.replace("doc_id long", "doc_id string"))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
