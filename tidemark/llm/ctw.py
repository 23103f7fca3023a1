"""Scoring texts by context-tree weighting over bytes.

A text is its bytes (A-Z in lower case) and an end symbol, 0xFF, which UTF-8 never has; what
stands before its first byte counts as end symbols too. Each byte is eight binary decisions, and each decision has a
context tree of its own, whose nodes are the last 0 to ``DEPTH`` bytes. A node holds how often either bit followed in the training
texts; its Krichevsky-Trofimov estimate and the product of its children's weighted probabilities
are mixed half and half (Willems, Shtarkov and Tjalkens 1995). Given the training texts, a bit's probability is then the
mixture of the estimates along its path, each weighed by the posterior of its node.

Training counts the runs of DEPTH + 1 bytes of each block of documents, so that Spark moves
distinct runs and not positions, packed by block and bucket. Counts of ``FAN`` blocks at a time are merged until so many groups
of blocks are left at most; what meets in a task grows with the distinct runs of a bucket, not with the number of blocks. All runs with the same two nearest context
bytes share a bucket, where the nodes of depth 2 and more are worked out; depths 0 and 1 have at most 256 * 255
nodes, which the driver broadcasts. Code lengths go back the same way, from groups of blocks to their members, and every block scores its texts.
Words of a block are counted for the base score in the same way.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, table, written

#: Bytes of context.
DEPTH = 5
#: Bytes of text in a block, and blocks at least.
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 12
#: Buckets of runs; more for many blocks.
LEAST_BUCKETS, MOST_BUCKETS = 64, 16_384
END = 255
#: Positions whose runs are sorted at once, which bounds a task's memory; groups of blocks whose counts meet in one task.
PART, FAN = 1 << 21, 64
#: Multiplier that scatters the two nearest context bytes over the buckets, and its inverse modulo 2 ** 16.
_SCATTER = 40503
_GATHER = pow(_SCATTER, -1, 1 << 16)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0 by Stirling's series at x + 8."""
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in arrays sorted by group."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def bit_nodes(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, node, zeros, ones) of runs in order of context and symbol; node: 1 and the bits of the symbol before the decision."""
    out = []
    for b in range(8):
        node = (1 << b) | (symbol >> (8 - b))
        at = _groups(context, node)
        one = (symbol >> (7 - b)) & 1
        ones = np.add.reduceat(n * one, at)
        out.append((context[at], node[at], np.add.reduceat(n, at) - ones, ones))
    return tuple(np.concatenate(x) for x in zip(*out))


class Level:
    """The nodes of one depth, looked up by context and node."""

    def __init__(self, context, node, zeros, ones, children):
        """children: sum of ln weighted probabilities of the children; None for leaves."""
        key = context << 8 | node
        order = np.argsort(key, kind="stable")
        self.key, self.zeros, self.ones = key[order], zeros[order].astype(float), ones[order].astype(float)
        estimate = log_kt(self.zeros, self.ones)
        self.weighted = estimate if children is None else np.logaddexp(estimate, children[order]) - np.log(2)
        #: Posterior of stopping at the node.
        self.stop = np.ones(len(self.key)) if children is None else np.exp(estimate - np.log(2) - self.weighted)

    def mixture(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Probability of ``bit`` at the nodes, given that of the deeper nodes; where the node is unknown it has seen nothing."""
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        found = self.key[at] == key if len(self.key) else np.zeros(len(key), bool)
        own, stop = np.full(len(key), 0.5), np.full(len(key), 0.5)
        i = at[found]
        own[found] = (np.where(bit[found], self.ones[i], self.zeros[i]) + 0.5) / (self.zeros[i] + self.ones[i] + 1)
        stop[found] = self.stop[i]
        return stop * own + (1 - stop) * deeper


def _merge(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = context << 8 | symbol
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = _groups(key)
    return key[at] >> 8, key[at] & 255, np.add.reduceat(n[order], at) if len(at) else n


def _parents(level: Level, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the nodes one depth up, sorted, and the sums of their children's ln probabilities."""
    parent = (level.key >> 8 >> step) << 8 | (level.key & 255)
    order = np.argsort(parent, kind="stable")
    parent = parent[order]
    at = _groups(parent)
    return parent[at], np.add.reduceat(level.weighted[order], at) if len(at) else np.zeros(0)


def build_levels(runs: np.ndarray, n: np.ndarray, least: int, depth: int = DEPTH) -> dict[int, Level]:
    """Depths ``least`` to ``depth`` from runs: context bytes, the nearest first, then the symbol."""
    keep = n > 0
    runs, n = runs[keep], n[keep]
    levels: dict[int, Level] = {}
    for d in range(depth, least - 1, -1):
        context, symbol, count = _merge(runs >> 8 >> 8 * (depth - d), runs & 255, n)
        nodes = bit_nodes(context, symbol, count) if len(count) else tuple(np.zeros(0, np.int64) for _ in range(4))
        children = None
        if d < depth:
            keys, sums = _parents(levels[d + 1], 8)
            children = sums[np.searchsorted(keys, nodes[0] << 8 | nodes[1])] if len(keys) else np.zeros(0)
        levels[d] = Level(*nodes, children)
    return levels


def code_log10(runs: np.ndarray, levels: dict[int, Level], depth: int = DEPTH) -> np.ndarray:
    """log10 of the probability of the last byte of each run."""
    symbol, total = runs & 255, np.zeros(len(runs))
    for b in range(8):
        node, bit = (1 << b) | (symbol >> (8 - b)), ((symbol >> (7 - b)) & 1).astype(bool)
        p = np.full(len(runs), 0.5)
        for d in range(depth, -1, -1):
            p = levels[d].mixture((runs >> 8 >> 8 * (depth - d)) << 8 | node, bit, p)
        total += np.log10(p)
    return total


def top_levels(part: pd.DataFrame, depth: int = DEPTH) -> dict[int, Level]:
    """Depths 0 and 1 from (context, node, zeros, ones, children) of depth 1."""
    context, node = part["context"].to_numpy(np.int64), part["node"].to_numpy(np.int64)
    zeros, ones = part["zeros"].to_numpy(np.int64), part["ones"].to_numpy(np.int64)
    one = Level(context, node, zeros, ones, part["children"].to_numpy(float) if depth > 1 else None)
    keys, sums = _parents(one, 8)
    order = np.argsort(node, kind="stable")
    at = _groups(node[order])
    add = lambda x: np.add.reduceat(x[order], at) if len(at) else x
    return {1: one, 0: Level(np.zeros(len(at), np.int64), node[order][at], add(zeros), add(ones), sums)}


class Block:
    """The bytes of some texts in lower case, each behind ``depth`` end symbols and followed by one."""

    def __init__(self, texts: list[str | None], depth: int = DEPTH, part: int = PART):
        self.depth, self.part = depth, part
        self.raws = [(x or "").encode("utf-8", "replace").lower() for x in texts]
        end = bytes([END])
        self.data = np.frombuffer(b"".join([part for x in self.raws for part in (end * depth, x, end)]), np.uint8)
        #: Where each text's end symbols begin.
        self.bounds = np.cumsum([0] + [len(x) + 1 + depth for x in self.raws])

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(run, number of the text) of every scored position, at most ``part`` at a time. A run: context bytes, the nearest first, then the symbol."""
        depth, data, bounds = self.depth, self.data, self.bounds
        for low in range(depth, len(data), self.part):
            high = min(low + self.part, len(data))
            runs = data[low:high].astype(np.int64)
            for j in range(1, depth + 1):
                runs |= data[low - j : high - j].astype(np.int64) << 8 * (depth + 1 - j)
            first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, high, "left")
            text = np.repeat(np.arange(first, last), np.diff(np.clip(bounds[first : last + 1], low, high)))
            scored = np.arange(low, high) - bounds[text] >= depth
            yield runs[scored], text[scored]


def scattered(runs: np.ndarray) -> np.ndarray:
    """Runs with the two nearest context bytes scattered, so that buckets of equal numbers of byte pairs are ranges."""
    return ((runs >> 32) * _SCATTER & 0xFFFF) << 32 | runs & 0xFFFFFFFF


def gathered(runs: np.ndarray) -> np.ndarray:
    return ((runs >> 32) * _GATHER & 0xFFFF) << 32 | runs & 0xFFFFFFFF


def summed(runs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs in order, and the sums of their numbers."""
    order = np.argsort(runs, kind="stable")
    runs = runs[order]
    at = _groups(runs)
    return runs[at], np.add.reduceat(n[order], at) if len(at) else n


def run_counts(block: Block, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct scattered runs of a block in order, and how often they stand in texts that aren't ``held`` out."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for runs, text in block.parts():
        key = scattered(runs) << 1 | held[text]
        key.sort()
        run = key >> 1
        at = _groups(run)
        found.append((run[at], np.add.reduceat(~key & 1, at) if len(at) else at))
    return found[1] if len(found) == 2 else summed(*(np.concatenate(x) for x in zip(*found)))


def sums_by_text(block: Block, runs: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For every text the sum of its runs' values; ``runs`` are scattered, distinct and in order."""
    out = np.zeros(len(block.raws))
    for own, text in block.parts():
        own = scattered(own)
        order = np.argsort(own)
        own = own[order]
        at = _groups(own)
        place = np.searchsorted(runs, own[at])
        each = np.empty(len(own), np.float32)
        each[order] = np.repeat(value[place], np.diff(np.append(at, len(own))))
        out += np.bincount(text, each, len(out))
    return out


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _pack_runs(runs: np.ndarray) -> bytes:
    return _pack(np.diff(runs, prepend=0))


def _unpack_runs(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob, np.int64))


def _block_counts(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """(block, bucket, kind, items, counts): distinct runs and words of a block with their counts in its training texts."""
    block, held_out = Block(frame["text"].tolist()), frame["held_out"].to_numpy(bool)
    runs, n = run_counts(block, held_out)
    words: Counter = Counter()
    other: set = set()
    for raw, held in zip(block.raws, held_out):
        (other.update if held else words.update)(raw.split())
    for w in other:
        words.setdefault(w, 0)
    mine: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in words:
        mine[zlib.crc32(w) % buckets].append(w)
    out, at = [], np.searchsorted((runs >> 32) * buckets >> 16, np.arange(buckets + 1))
    for k in range(buckets):
        i, j = at[k], at[k + 1]
        if j > i:
            out.append((k, "run", _pack_runs(runs[i:j]), _pack(n[i:j])))
        if mine[k]:
            out.append((k, "word", _pack_words(mine[k]), _pack(np.array([words[w] for w in mine[k]], np.int64))))
    out = pd.DataFrame(out, columns=["bucket", "kind", "items", "counts"])
    out.insert(0, "block", int(frame["block"].iloc[0]))
    return out


def _pack_words(words: list[bytes]) -> bytes:
    return zlib.compress(b"\n".join(words), 1)


def _unpack_words(blob: bytes) -> list[bytes]:
    return zlib.decompress(blob).split(b"\n")


def _runs_of(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of all rows with the sums of their counts."""
    runs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = frame[frame["kind"] == "run"]
    # Eight rows at a time, so that no more than the sums and a few rows are unpacked at once.
    for i in range(0, len(own), 8):
        some = own.iloc[i : i + 8]
        parts = [(runs, n), *((_unpack_runs(x), _unpack(c, np.int64)) for x, c in zip(some["items"], some["counts"]))]
        runs, n = summed(*(np.concatenate(x) for x in zip(*parts)))
    return runs, n


def _words_of(frame: pd.DataFrame) -> Counter:
    words: Counter = Counter()
    own = frame[frame["kind"] == "word"]
    for items, counts in zip(own["items"], own["counts"]):
        for w, n in zip(_unpack_words(items), _unpack(counts, np.int64).tolist()):
            words[w] += n
    return words


def _merged(frame: pd.DataFrame, fan: int) -> pd.DataFrame:
    """A bucket's counts over some blocks, as those of one."""
    block, bucket, out = int(frame["block"].iloc[0]) // fan, int(frame["bucket"].iloc[0]), []
    runs, n = _runs_of(frame)
    if len(runs):
        out.append((block, bucket, "run", _pack_runs(runs), _pack(n)))
    if words := _words_of(frame):
        out.append((block, bucket, "word", _pack_words(list(words)), _pack(np.array(list(words.values()), np.int64))))
    return pd.DataFrame(out, columns=["block", "bucket", "kind", "items", "counts"])


def _bucket_tops(frame: pd.DataFrame) -> pd.DataFrame:
    """Depth 1 nodes over a bucket's runs; under context -1 the number of training words and of distinct ones."""
    runs, n = _runs_of(frame)
    two = build_levels(gathered(runs), n, 2)[2]
    keys, sums = _parents(two, 8)
    parent = (two.key >> 16) << 8 | (two.key & 255)
    order = np.argsort(parent, kind="stable")
    at = _groups(parent[order])
    add = lambda x: np.add.reduceat(x[order], at).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    nodes = pd.DataFrame({"context": keys >> 8, "node": keys & 255, "zeros": add(two.zeros), "ones": add(two.ones), "children": sums})
    counts = [x for x in _words_of(frame).values() if x]
    return pd.concat([nodes, pd.DataFrame({"context": [-1], "node": [-1], "zeros": [sum(counts)], "ones": [len(counts)], "children": [0.0]})])


VALUES = "block int, bucket int, kind string, items binary, values binary"


def _for_members(frame: pd.DataFrame, runs: np.ndarray, value: np.ndarray, words: dict[bytes, int]) -> pd.DataFrame:
    """(block, bucket, kind, items, values): the values of each row's runs, the counts of its words."""
    out = []
    for block, bucket, kind, items in zip(frame["block"], frame["bucket"], frame["kind"], frame["items"]):
        if kind == "run":
            out.append((block, bucket, kind, items, _pack(value[np.searchsorted(runs, _unpack_runs(items))])))
        else:
            out.append((block, bucket, kind, items, _pack(np.array([words[w] for w in _unpack_words(items)], np.int64))))
    return pd.DataFrame(out, columns=["block", "bucket", "kind", "items", "values"])


def _bucket_values(frame: pd.DataFrame, top: dict[int, Level]) -> pd.DataFrame:
    """For every row's runs log10 of their probabilities, for its words their counts."""
    runs, n = _runs_of(frame)
    plain, levels = gathered(runs), build_levels(gathered(runs), n, 2) | top
    value = np.concatenate([np.zeros(0, np.float32), *(code_log10(plain[i : i + PART], levels).astype(np.float32) for i in range(0, len(plain), PART))])
    return _for_members(frame, runs, value, _words_of(frame))


def _passed_down(members: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The values of a group of blocks, for each of them."""
    runs, value, words = np.zeros(0, np.int64), np.zeros(0, np.float32), {}
    for kind, items, values in zip(known["kind"], known["items"], known["values"]):
        if kind == "run":
            runs, value = _unpack_runs(items), _unpack(values, np.float32)
        else:
            words = dict(zip(_unpack_words(items), _unpack(values, np.int64).tolist()))
    return _for_members(members, runs, value, words)


def _block_scores(frame: pd.DataFrame, known: pd.DataFrame, n_tokens: int, n_distinct: int, n_ends: int) -> pd.DataFrame:
    block = Block(frame["text"].tolist())
    got = known[known["kind"] == "run"].sort_values("bucket")
    runs, value = (np.concatenate([np.zeros(0, kind), *map(unpack, got[c])]) for c, kind, unpack in (("items", np.int64, _unpack_runs), ("values", np.float32, lambda x: _unpack(x, np.float32))))
    sums = sums_by_text(block, runs, value)
    got = known[known["kind"] == "word"]
    words = [w for x in got["items"] for w in _unpack_words(x)]
    where = dict(zip(words, range(len(words))))
    c = np.concatenate([*(_unpack(x, np.int64) for x in got["values"]), [n_ends]]).astype(float)
    logs = np.log10((c + 0.5) / (n_tokens + 0.5 * (n_distinct + 1)))
    out = []
    for raw in block.raws:
        i = np.append(np.fromiter(map(where.__getitem__, raw.split()), np.int64), len(words))
        out.append((len(i), int((c[i] > 0).sum()), logs[i].sum(), len(raw) + 1))
    out = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "n_bytes"])
    return pd.DataFrame({"doc_id": frame["doc_id"].array, "held_out": frame["held_out"].array, **out, "score": sums})


def ctw_scores(docs: DataFrame, parts: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    bits_per_byte is the code length over the number of bytes and the end. Texts with fold(doc_id) == ``held`` are not learned from. A null text is empty: its end is scored all the same. Repeated
    rows count and are scored each. A null doc_id belongs to the fold of the empty text. An empty table gives an empty result; without training texts every byte has probability 1/256.
    Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + DEPTH + 1)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-int(size) // BLOCK_BYTES))
    buckets = min(LEAST_BUCKETS * max(1, blocks // 500), MOST_BUCKETS)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    # Ids go through Python as text: beside nulls pandas would make them floating-point numbers.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (fold("doc_id", parts) == held).alias("held_out"), block.alias("block"))
    schema = "block int, bucket int, kind string, items binary, counts binary"
    counts = [written(rows.groupBy("block").applyInPandas(lambda x: _block_counts(x, buckets), schema), "ctw-counts")]
    fan = FAN
    while blocks > fan:
        blocks = -(-blocks // fan)
        counts.append(written(counts[-1].groupBy("bucket", F.floor(F.col("block") / fan)).applyInPandas(lambda x: _merged(x, fan), schema), "ctw-counts"))
    nodes = counts[-1].groupBy("bucket").applyInPandas(_bucket_tops, "context long, node long, zeros long, ones long, children double")
    # At most 256 * 255 + 1 rows.
    nodes = nodes.groupBy("context", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).toPandas()
    n_ends = docs.where(fold("doc_id", parts) != held).count()
    words = nodes[nodes["context"] < 0]
    n_tokens, n_distinct = int(words["zeros"].sum()) + n_ends, int(words["ones"].sum()) + (n_ends > 0)
    top = spark.sparkContext.broadcast(top_levels(nodes[nodes["context"] >= 0]))
    values = counts.pop().groupBy("bucket").applyInPandas(lambda x: _bucket_values(x, top.value), VALUES)
    while counts:
        members = counts.pop().withColumn("group", F.floor(F.col("block") / fan).cast("int"))
        of_groups = values.withColumnRenamed("block", "group").withColumn("block", F.lit(0))
        values = members.groupBy("bucket", "group").cogroup(of_groups.groupBy("bucket", "group")).applyInPandas(_passed_down, VALUES)
    scored = rows.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(
        lambda a, b: _block_scores(a, b, n_tokens, n_distinct, n_ends),
        "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, n_bytes long, score double",
    )
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (F.col("score") * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return ctw_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
