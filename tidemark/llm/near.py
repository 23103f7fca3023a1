"""MinHash near-dedup by BagMinHash signatures (Ertl 2018).

A document is the multiset of its five-word shingles. For each shingle, points of a Poisson
process lie in (time, weight, component); a signature component is the least time of
its points whose weight is below the shingle's count. Weights are cut into dyadic intervals
[0, 1), [1, 2), [2, 4), ..., each a process of its own, seeded by shingle and interval, that
runs until its time exceeds the signature's largest component. Two signatures then agree in a
component with the probability of the weighted Jaccard similarity of the multisets.

Signatures are cut into bands. Documents that share a band are first compared, by multiset overlap
of all their shingles, with one pivot of that band, which shares most bands with others. Where a cluster of documents, joined by shared
bands, is then still in several classes, those outside of its largest class are compared with the whole cluster, in blocks of a
bounded number of bytes: an inverted index of a block gives the overlaps of one text with all of the block's at once, and
only links between classes leave it. So no link is lost, and no pairs are written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD, table, written
from tidemark.llm.hashing import chunks, mix, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Bands of so many components: a pair at the threshold shares a band with probability 1 - (1 - 0.8 ** 5) ** 24 > 0.9999.
BANDS, ROWS = 24, 5
#: Bytes of text in a block of compared texts, and of those they are compared with.
QUERY_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20

_STEP = np.uint64(0xD1B54A32D192ED03)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(raws: list[bytes], components: int) -> np.ndarray:
    """(texts, components) least times; infinity throughout for a text without words."""
    hashes, n_runs = shingle_hashes(raws, WIDTH)
    times = np.full((len(raws), components), np.inf)
    docs, values, weights, at = [], [], [], 0
    for i, n in enumerate(n_runs):
        if n:
            value, count = np.unique(hashes[at : at + n], return_counts=True)
            docs.append(np.full(len(value), i))
            values.append(value)
            weights.append(count)
            at += n
    if not docs:
        return times
    doc, value, weight = np.concatenate(docs), np.concatenate(values), np.concatenate(weights)
    low, level, state = 0, 0, []
    while len(doc):
        high = max(1, 2 * low)
        state.append((doc, mix(value + np.uint64((level + 1) * int(_STEP) % 2**64)), np.full(len(doc), float(low)), np.full(len(doc), float(high - low)), weight))
        more = weight > high
        doc, value, weight, low, level = doc[more], value[more], weight[more], high, level + 1
    doc, seed, base, rate, weight = (np.concatenate(x) for x in zip(*state))
    now, drawn, flat = np.zeros(len(doc)), 0, times.reshape(-1)
    while len(doc):
        k = 1 if len(doc) > 4000 else 16  # points drawn at once
        steps = np.arange(drawn + 1, drawn + k + 1, dtype=np.uint64)
        bits = mix(seed[:, None] + steps[None, :] * _STEP)
        t = now[:, None] + np.cumsum(-np.log(_uniform(bits)) / rate[:, None], axis=1)
        other = mix(bits ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        at = doc[:, None] * components + ((other & np.uint64(0xFFFFFFFF)) * np.uint64(components) >> np.uint64(32)).astype(np.int64)
        below = base[:, None] + (other >> np.uint64(32)).astype(np.float64) * 2.0**-32 * rate[:, None] < weight[:, None]
        np.minimum.at(flat, at[below], t[below])
        now, drawn = t[:, -1], drawn + k
        on = now < times.max(axis=1)[doc]
        doc, seed, base, rate, weight, now = (x[on] for x in (doc, seed, base, rate, weight, now))
    return times


def band_keys(raws: list[bytes], bands: int = BANDS, rows: int = ROWS) -> list[np.ndarray]:
    """The keys of each text's bands; none for a text without words."""
    times = signatures(raws, bands * rows)
    bits = times.view(np.uint64).reshape(len(raws), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(raws), bands)).copy()
    for j in range(rows):
        keys = mix(keys * _STEP + bits[:, :, j])
    empty = np.isinf(times[:, 0])
    return [np.zeros(0, np.int64) if e else x for e, x in zip(empty, keys.view(np.int64))]


@F.pandas_udf(T.ArrayType(T.LongType()))
def text_bands(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([x for _, raws in chunks(texts.tolist()) for x in band_keys(raws)], dtype=object)


def multiset_overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted distinct values, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes([(text or "").encode("utf-8", "replace")], WIDTH)[0], return_counts=True)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    out, last, held = [], None, None
    for x, y in zip(a, b):
        if x is not last:
            last, held = x, _counted(x)
        out.append(multiset_overlap(held, _counted(y)))
    return pd.Series(out, dtype=float)


def block_links(rows: pd.DataFrame, similar: float) -> pd.DataFrame:
    """(a, b): for every query of a block a document of each other class that it is linked to."""
    members, queries = rows[~rows["query"]], rows[rows["query"]]
    comp, rep = members["comp"].to_numpy(np.int64), members["rep"].to_numpy(np.int64)
    bags = [_counted(x) for x in members["text"]]
    size = np.array([b[1].sum() for b in bags], np.int64)
    value = np.concatenate([np.zeros(0, np.uint64), *[b[0] for b in bags]])
    count = np.concatenate([np.zeros(0, np.int64), *[b[1] for b in bags]])
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    order = np.argsort(value, kind="stable")
    value, count, owner = value[order], count[order], owner[order]
    out = []
    for one, own, text in zip(queries["rep"], queries["comp"], queries["text"]):
        mine, n = _counted(text)
        low, high = np.searchsorted(value, mine, "left"), np.searchsorted(value, mine, "right")
        lengths = high - low
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(low, lengths)
        both = np.bincount(owner[at], np.minimum(np.repeat(n, lengths), count[at]), len(bags))
        near = (both / np.maximum(size + n.sum() - both, 1) >= similar) & (comp != own)
        _, first = np.unique(comp[near], return_index=True)
        out += [(one, other) for other in rep[near][first]]
    return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the least id of the connected component of every id in ``links`` (a, b).

    Each round points every node at its least neighbour, follows the pointers twice, and contracts: links go on between the nodes
    reached, so that stars are done in one round and the links left shrink with every round.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = edges.select(F.col("a").alias("id"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("id"), F.col("a").alias("near")))
        first = written(ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("up")), "pointers")
        second = first.select(F.col("id").alias("up"), F.col("up").alias("root"))
        roots = written(first.join(second, "up").select("id", "root"), "pointers")
        if labels is None:
            labels = roots.select("id", F.col("root").alias("comp"))
        else:
            moved = roots.select(F.col("id").alias("comp"), "root")
            labels = written(labels.join(moved, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
        to = edges.join(roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(to.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels


def _links_within_clusters(buckets: DataFrame, labels: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Links between the classes, given by ``labels``, of documents that shared bands connect."""
    stars = buckets.join(buckets.groupBy("band").agg(F.min("rep").alias("a")), "band").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    clusters = components(stars).select(F.col("id").alias("rep"), F.col("comp").alias("cluster"))
    named = clusters.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "cluster", F.coalesce("comp", "rep").alias("comp"))
    bytes_of = texts.select("rep", F.octet_length("text").cast("long").alias("bytes"))
    sized = written(named.join(bytes_of, "rep"), "clusters")
    classes = sized.groupBy("cluster", "comp").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    summed = classes.groupBy("cluster").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max(F.struct("n", "comp", "bytes"))["bytes"].alias("largest_bytes"),
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_comps"),
    ).where("n_comps > 1")
    blocks = lambda b, size: F.ceil(b / F.lit(size)).cast("int")
    plan = summed.select("cluster", "largest", blocks(F.col("bytes") - F.col("largest_bytes"), QUERY_BYTES).alias("n_q"), blocks(F.col("bytes"), BLOCK_BYTES).alias("n_m"))
    rows = sized.join(plan, "cluster")
    every = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    asked = rows.where("comp <> largest").select("cluster", mine("n_q").alias("i"), F.explode(every("n_m")).alias("j"), "rep", "comp", F.lit(True).alias("query"))
    held = rows.select("cluster", F.explode(every("n_q")).alias("i"), mine("n_m").alias("j"), "rep", "comp", F.lit(False).alias("query"))
    both = asked.union(held).join(texts.select("rep", "text"), "rep")
    return both.groupBy("cluster", "i", "j").applyInPandas(lambda x: block_links(x, similar), "a long, b long")


def _node(text: str) -> Column:
    """The node of a text, a hash of its md5: equal texts are one node, whatever their doc_ids."""
    return F.xxhash64(F.unhex(F.md5(text)))


def _row_classes(docs: DataFrame, similar: float) -> DataFrame:
    """(doc_id, node, class_id, best) of every row of ``docs``; node is null for texts without words, best is the (doc_id, node) that stays of a class."""
    ids = docs.select("doc_id", _node("text").alias("node"), text_bands(F.col("text")).alias("bands"))
    signed = written(ids, "signatures")
    worded = signed.where(F.size("bands") > 0)
    reps = written(worded.groupBy(F.col("node").alias("rep")).agg(F.min("doc_id").alias("of"), F.first("bands").alias("bands")), "representatives")
    member = reps.select("rep", F.explode("bands").alias("band"))
    shared = member.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(member.join(shared.select("band"), "band").select("band", "rep").distinct(), "bands")
    wanted = reps.select("rep", "of").join(buckets.select("rep").distinct(), "rep")
    named = docs.select("doc_id", _node("text").alias("node"), "text")
    found = named.join(wanted, (F.col("node") == F.col("rep")) & F.col("doc_id").eqNullSafe(F.col("of")))
    texts = written(found.select("rep", "text").dropDuplicates(["rep"]), "candidate-texts")

    weight = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    weighed = buckets.join(weight, "band")
    shares = weighed.groupBy("rep").agg(F.sum("n").alias("shares"))
    pivots = weighed.join(shares, "rep").groupBy("band").agg(F.max_by("rep", F.struct("shares", "rep")).alias("pivot"))
    pairs = buckets.join(pivots, "band").where("rep <> pivot").select(F.col("rep").alias("b"), F.col("pivot").alias("a")).distinct()
    a, b = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    close = written(pairs.join(b, "b").join(a, "a").where(similarity("ta", "tb") >= similar).select("a", "b"), "verified")
    links = close.union(written(_links_within_clusters(buckets, components(close), texts, similar), "verified"))
    labels = components(links).withColumnRenamed("id", "rep")

    first = F.struct(F.col("of").isNull().alias("last"), F.col("of").alias("doc_id"), F.col("rep").alias("node"))
    classed = reps.select("rep", "of").join(labels, "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"), first.alias("first"))
    firsts = classed.groupBy("comp").agg(F.min("first").alias("best"))
    best = classed.select("rep", "comp").join(firsts, "comp").select("rep", "best")
    rows = signed.select("doc_id", F.when(F.size("bands") > 0, F.col("node")).alias("node")).join(best, F.col("node") == F.col("rep"), "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return rows.select("doc_id", "node", class_id.alias("class_id"), "best")


def _stays() -> Column:
    """Whether a row of ``_row_classes`` is the one that stays of its class, or one of its repeats."""
    return F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node")))


def near_classes(docs: DataFrame, similar: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs``: the least doc_id of its class.

    Texts are linked if they are equal or their shingle multisets overlap by
    ``similar`` or more; classes are the connected components of texts. Texts without words are in
    classes of their own, even if equal. doc_ids don't link: rows with a null or the same doc_id are classed by their texts. The class_id is null
    only where all of a class have null doc_ids. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    return _row_classes(docs, similar).select("doc_id", "class_id")


def dedup_near(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, that of the least doc_id (null last).

    Of texts without words each doc_id keeps one row a text, and all rows without a doc_id stay.
    """
    gone = _row_classes(docs, SIMILARITY).where(~_stays()).select(F.col("doc_id").alias("nd_of"), F.col("node").alias("nd_text")).distinct()
    keyed = docs.withColumn("nd_node", F.coalesce(_node("text"), F.lit(0)))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("nd_of")) & (F.col("nd_node") == F.col("nd_text")), "left_anti")
    alone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    return kept.where(~alone).dropDuplicates(["doc_id", "nd_node"]).union(kept.where(alone)).drop("nd_node")


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _row_classes(docs, SIMILARITY).select("doc_id", "class_id", _stays().alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), runs AS (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM words)
), bags AS (
  SELECT doc_id, s, count(*) AS n FROM runs GROUP BY doc_id, s
), sizes AS (
  SELECT doc_id, sum(n) AS size FROM bags GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS n_both FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE n_both >= 0.8 * (x.size + y.size - n_both)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.node
)
SELECT doc_id, min(node) AS class_id, doc_id = min(node) AS kept FROM reach GROUP BY doc_id
"""
