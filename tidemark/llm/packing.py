"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents become pieces of at most ``capacity`` tokens. Packing is bulk-synchronous. In each superstep the pieces of
the longest lengths not yet placed, a band of lengths, meet the gaps of all open sequences. Both are ranked by size: counts by
size and split and ranks within these give every piece and every gap its place in one order without a task that holds a whole
size. A sweep over the prefix counts says at which level of that order a gap opens and a piece closes it, so that each piece finds its
successor, the smallest gap left that holds it; pieces that want the same gap have different ranks and so different levels, and
one grouping by level brings them together. What finds no gap opens sequences, as many pieces to each as fit. Then the gaps are
updated, and the next band follows.

The driver holds counts by size (at most ``capacity`` of them, whatever the corpus) and the number of sequences; pieces and gaps are rows
in written tables, so a superstep can be repeated if executors are lost.
"""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import joined_ids, recalled, table, written

CAPACITY, END_ID = 2048, 0
#: Rows per split of a size; ranks are the same for any number of splits.
SPLIT_ROWS = 100_000
#: Words and parts of words whose ids a task keeps, and the longest of them.
CACHE_WORDS, CACHE_BYTES = 300_000, 64
#: Texts that are parted together, fewer where little is kept.
BATCH = 1024
_ID = np.dtype("<u4")

PIECES = T.ArrayType(T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
]))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: ASCII punctuation but apostrophes, and letters of Latin alphabets in lower case.
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LATIN = re.compile("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f]+")


class WordIds:
    """Ids of texts by a lower-casing BPE tokenizer that drops white space, word by word.

    It splits at white space before anything else, so the ids of a text are those of its
    words; words come back often, and their ids are kept. Arrow parts the texts of a batch and numbers their different words, each of which is looked up once. A new word of Latin letters, with or without punctuation behind them, has one
    or two parts that the tokenizer's own model encodes directly, many parts in one call: the id of a part's last
    token, and no other, ends a word. Any other new word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        # The model's character for each byte, as the tokenizer's byte-level step has it; blanks only part words.
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        by_byte = {}
        for c in range(0x80, 0x180):
            for byte, shown in zip(chr(c).encode(), visible.pre_tokenize_str(chr(c))[0][0]):
                by_byte[byte] = shown
        self.shown = "".join(chr(b) if b < 0x80 else by_byte.get(b, "\ufffe") for b in range(256))
        #: Ids of words and of parts of words, and those of the generation before, from which words come back when they are met again.
        self.known: dict[bytes, bytes] = {b"": b""}
        self.before: dict[bytes, bytes] = {}

    def _encode_parts(self, parts: list[bytes]) -> None:
        for i in range(0, len(parts), 1000):
            some = parts[i : i + 1000]
            text = codecs.charmap_decode(b" ".join(some), "strict", self.shown)[0]
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            assert len(cuts) == len(some)
            blob, start = ids.tobytes(), 0
            for part, end in zip(some, cuts.tolist()):
                self.known[part] = blob[start:end]
                start = end

    def _learn(self, new: list[bytes]) -> None:
        """Adds words in lower case; those with letters beyond ASCII may still have capitals."""
        plain, split, rest = list(filter(bytes.isalpha, new)), [], []
        for word in filterfalse(bytes.isalpha, new):
            core = word.rstrip(_PUNCTUATION)
            if core.isalpha():  # ASCII letters
                split.append((word, core.lower(), word[len(core) :]))
            else:
                rest.append((word, core))
        whole = []
        for word, core in rest:
            if core and not core.isascii() and _LATIN.fullmatch(lower := core.decode().lower()):
                split.append((word, lower.encode(), word[len(core) :]))
            else:
                whole.append(word)
        wanted = {x[1] for x in split}.union([x[2] for x in split]).difference(self.known, plain)
        self._encode_parts(plain + recalled(wanted, self.known, self.before))
        known = self.known
        for word, core, tail in split:
            known[word] = known[core] + known[tail]
        for word, x in zip(whole, self.tokenizer.encode_batch_fast([w.decode() for w in whole], add_special_tokens=False)):
            known[word] = np.array(x.ids, "<u4").tobytes()

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        some = max(1, min(BATCH, CACHE_WORDS // 200))
        for i in range(0, len(texts), some):
            raws = [(x or "").encode("utf-8", "replace") for x in texts[i : i + some]]
            # The tokenizer lower-cases too, but for its special tokens, which are in lower case and begin with "<|".
            lower = pa.array([b" ".join([w if b"<|" in w else w.lower() for w in x.split()]) if b"<|" in x else x.lower() for x in raws], pa.large_string())
            if len(self.known) > CACHE_WORDS // 2:  # what has not been met for a generation goes
                self.before, self.known = self.known, {b"": b""}
            yield from joined_ids(pc.ascii_split_whitespace(lower), self._ids_of, _ID)

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        known = self.known
        found = list(map(known.get, words))
        new = recalled([word for word, x in zip(words, found) if x is None], known, self.before)
        self._learn(new)
        found = [known[word] if x is None else x for word, x in zip(words, found)]
        for word in new:
            if len(word) > CACHE_BYTES:
                del known[word]
        return found


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each Python process, which serves many tasks."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _pieces_of(ids: bytes, capacity: int, end_id: int) -> list[tuple[int, int, int, int]]:
    ids += end_id.to_bytes(4, "little")
    step = 4 * capacity
    return [(i // step, i // 4, len(x) // 4, zlib.crc32(x)) for i in range(0, len(ids), step) if (x := ids[i : i + step])]


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty and gives one piece of the end id alone."""
    path = path or vocabulary()

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = word_ids(path)
        for texts in batches:
            yield pd.Series([_pieces_of(x, capacity, end_id) for x in words.batch(texts.tolist())], dtype=object)

    pieces = pieces.asNondeterministic()  # else a filter for empty arrays would run it once more
    return docs.select("doc_id", pieces(F.col("text")).alias("p")).select("doc_id", F.explode("p").alias("p")).select("doc_id", "p.*")


def next_band(lengths: list[int], capacity: int) -> list[int]:
    """The lengths that the next superstep places, from the longest on: those of which equally many fill a sequence, if these are few, or those of like length."""
    longest = max(lengths)
    fit = capacity // longest
    low = capacity // (fit + 1) if fit <= 4 else int(longest * 0.7)
    return [x for x in lengths if x > low]


def sweep(gaps: dict[int, int], pieces: dict[int, int]) -> tuple[list[tuple], list[tuple], dict[int, int]]:
    """One sweep over prefix counts, from the largest size downwards, for pieces of about one length.

    A gap that holds several of the longest pieces is cut into as many slots, no more than the pieces need; each slot takes a piece at most. A slot opens a level, a piece
    closes the highest one, so that it gets the smallest slot that is open, its successor. Returns (gap, slots, length of
    all slots but the last, level of the first of these, level of the last slots) by gap, (length, first level, pieces with a slot) by length,
    and the numbers of pieces without one. The k-th slot of a level, by size, belongs to its k-th piece.
    """
    longest, n = max(pieces), sum(pieces.values())
    most = 1
    while sum(min(g // longest, most) * c for g, c in gaps.items()) < n and most < max(gaps, default=0) // longest:
        most *= 2
    slots = {g: max(1, min(g // longest, most)) for g in gaps if g >= min(pieces)}
    opened: dict[int, list] = {}
    for g in sorted(slots):
        m = slots[g]
        if m > 1:
            opened.setdefault(longest, []).append((g, True, gaps[g] * (m - 1)))
        opened.setdefault(g - (m - 1) * longest, []).append((g, False, gaps[g]))
    level, first, last, closed, left = 0, {}, {}, [], {}
    for size in sorted({*opened, *pieces}, reverse=True):
        for g, whole, count in opened.get(size, ()):
            (first if whole else last)[g] = level
            level += count
        if size in pieces:
            taken = min(pieces[size], level)
            closed.append((size, level, taken))
            level -= taken
            if taken < pieces[size]:
                left[size] = pieces[size] - taken
    return [(g, m, longest, first.get(g, 0), last[g]) for g, m in slots.items()], closed, left


def ranked(rows: DataFrame, size: str, order: list[str], split: Column | None) -> DataFrame:
    """``rows`` with pk_rank, their places from 0 among those of equal ``size`` in order of split and ``order``, from counts by size and split. Without a split the counts aren't needed."""
    if split is None:
        return rows.withColumn("pk_rank", (F.row_number().over(W.partitionBy(size).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumn("pk_split", split)
    sizes = rows.groupBy(F.col(size).alias("pk_size"), F.col("pk_split").alias("pk_of")).agg(F.count(F.lit(1)).alias("pk_n"))
    before = F.coalesce(F.sum("pk_n").over(W.partitionBy("pk_size").orderBy("pk_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("pk_size", "pk_of", before.alias("pk_before"))
    rank = F.col("pk_before") + F.row_number().over(W.partitionBy(size, "pk_split").orderBy(*order)) - 1
    joined = rows.join(sizes, F.expr(f"{size} = pk_size and pk_split = pk_of"))
    return joined.withColumn("pk_rank", rank.cast("long")).drop("pk_size", "pk_split", "pk_of", "pk_before")


def superstep(pieces: DataFrame, gaps: DataFrame | None, counts: dict[int, int], n_sequences: int, capacity: int) -> tuple[DataFrame, DataFrame, int]:
    """Places all pieces (length, pk_rank) of the lengths in ``counts``; returns their rows (length, pk_rank, sequence_id, offset), the gaps left and the number of sequences."""
    spark = pieces.sparkSession
    # At most one row a size, whatever the corpus.
    by_size = {r["gap"]: r["n"] for r in gaps.groupBy("gap").agg(F.count(F.lit(1)).alias("n")).collect()} if gaps is not None else {}
    opened, closed, left = sweep(by_size, counts)
    levels, unplaced, parts = [], 0, []
    fit = capacity // max(left) if left else 1
    for length, level, taken in closed:
        levels.append((length, level, taken, unplaced, n_sequences, fit))
        unplaced += left.get(length, 0)
    # What differs between supersteps is in small tables, not in expressions, so that the compiled code serves all of them.
    levels = spark.createDataFrame(levels, "pk_of int, pk_level long, pk_taken long, pk_unplaced long, pk_new long, pk_fit int")
    band = pieces.join(F.broadcast(levels), F.col("length") == F.col("pk_of"))
    if sum(taken for _, _, taken in closed):
        splits = max(1, n_sequences // SPLIT_ROWS)
        slots = [(*x, splits, n_sequences) for x in opened]
        slots = spark.createDataFrame(slots, "pk_gap int, pk_slots int, pk_slot long, pk_first long, pk_last long, pk_splits long, pk_total long")
        held = gaps.join(F.broadcast(slots), F.col("gap") == F.col("pk_gap"))
        split = F.expr("cast(floor(sequence_id * pk_splits / pk_total) as int)") if splits > 1 else None
        held = ranked(held, "gap", ["sequence_id"], split).withColumn("pk_no", F.explode(F.expr("sequence(0, pk_slots - 1)")))
        own = held.select(
            F.expr("if(pk_no < pk_slots - 1, pk_first + pk_rank * (pk_slots - 1) + pk_no, pk_last + pk_rank)").alias("level"),
            F.expr("struct(-if(pk_no < pk_slots - 1, pk_slot, gap - (pk_slots - 1) * pk_slot) as size, sequence_id, gap, pk_no)").alias("slot"),
        )
        asked = band.where("pk_rank < pk_taken").select(F.expr("pk_level - 1 - pk_rank").alias("level"), F.expr("struct(-length as size, length, pk_rank)").alias("asks"))
        # One exchange brings the slots and pieces of a level together: one of a size at most, so no more than there are sizes.
        met = own.unionByName(asked, allowMissingColumns=True).groupBy("level").agg(F.sort_array(F.collect_list("slot")).alias("slot"), F.sort_array(F.collect_list("asks")).alias("asks"))
        asked = met.select(F.explode(F.arrays_zip("slot", "asks")).alias("x")).where("x.slot is not null and x.asks is not null").select("x.asks.length", "x.asks.pk_rank", "x.slot.sequence_id", "x.slot.gap", "x.slot.pk_no")
        earlier = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("pk_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        parts.append(asked.select("length", "pk_rank", "sequence_id", (F.lit(capacity) - F.col("gap") + earlier).cast("long").alias("offset")))
    if left:
        place = F.col("pk_unplaced") + F.col("pk_rank") - F.col("pk_taken")
        new = band.where("pk_rank >= pk_taken").withColumn("pk_place", place).withColumn("sequence_id", F.expr("pk_new + pk_place div pk_fit"))
        earlier = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("pk_place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        parts.append(new.select("length", "pk_rank", "sequence_id", earlier.cast("long").alias("offset")))
        n_sequences += -(-unplaced // fit)
    placed = written(parts[0] if len(parts) == 1 else parts[0].union(parts[1]), "placed")
    room = placed.select("sequence_id", F.lit(None).cast("int").alias("gap"), "length")
    if gaps is not None:
        room = gaps.select("sequence_id", "gap", F.lit(0).alias("length")).union(room)
    rest = room.groupBy("sequence_id").agg((F.coalesce(F.max("gap"), F.lit(capacity)) - F.sum("length")).cast("int").alias("gap"))
    return placed, written(rest.where("gap > 0"), "gaps"), n_sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, a written table with doc_id, piece, length and ids_crc32, with sequence_id and offset.

    Which of several pieces of one length goes where is settled by a hash of doc_id, piece and ids; repeated rows are packed each. An empty table gives an
    empty result. Columns of the names sequence_id and offset are replaced.
    """
    pieces = pieces.drop("sequence_id", "offset")
    counts = {r["length"]: r["n"] for r in pieces.groupBy(F.col("length").cast("int").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    bits = max(1, (sum(counts.values()) // SPLIT_ROWS).bit_length())
    hashed = pieces.withColumn("pk_hash", F.xxhash64("doc_id", "piece", "ids_crc32", "start"))
    rows = ranked(hashed, "length", ["pk_hash", "doc_id", "piece"], F.shiftrightunsigned("pk_hash", 64 - bits).cast("int"))
    rows = written(rows.drop("pk_hash"), "ranked-pieces")
    keys, gaps, n_sequences, placed = rows.select(F.col("length").cast("int").alias("length"), "pk_rank"), None, 0, None
    while counts:
        band = next_band(list(counts), capacity)
        some, gaps, n_sequences = superstep(keys, gaps, {x: counts.pop(x) for x in band}, n_sequences, capacity)
        placed = some if placed is None else placed.union(some)
    placed = placed.select(F.col("length").alias("pk_length"), F.col("pk_rank").alias("pk_of"), "sequence_id", "offset")
    return rows.join(placed, F.expr("length = pk_length and pk_rank = pk_of")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row a piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(cut(docs, path, capacity, end_id), "pieces"), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
