"""Token ids as files of a static range asymmetric numeral system.

The ids of all documents, in order of doc_id, are one sequence, cut into files by ranges of doc_id. How often each id occurs in the whole corpus
gives one frequency table, which all files share. A file holds blocks that are coded independently of each other. Within a block ``LANES`` coders take ids in
turn and write into one stream of 32-bit words; every ``STEPS`` turns a checkpoint keeps the coders' states and the place in the stream, so that
decoding can begin there, and a checksum of the ids up to the next one. Blocks and checkpoints are decoded next to each other as rows of one array.

    file:       magic | block, block, ... | documents | directory of blocks | trailer
    block:      states at the checkpoints, words
    documents:  doc_id, whether it is null, number of ids
    directory:  place, bytes, ids, words and checksum of the bytes of every block; places in the stream and checksums of the ids at the checkpoints
    trailer:    counts, checksum of documents and directory, checksum of the table

Ids are counted by Spark (a row an id of the vocabulary reaches the driver); a file is written and read by one task and is as long as about ``FILE_IDS`` ids,
or as its longest document. Files have names of their own for every attempt of a task; the table of files, written by Spark, names those that count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bytebpe import byte_ids
from tidemark.llm.common import new_folder, opened, table, written

END_ID = 2
MAGIC, VERSION = b"tidemark rANS\n", 1
#: Bits of the frequencies' sum. Coders in a block, turns between checkpoints, checkpoints in a block. Ids in a file.
BITS, LANES, STEPS, CHECKPOINTS, FILE_IDS = 20, 32, 512, 4, 1 << 22
BLOCK_IDS = LANES * STEPS * CHECKPOINTS
#: Least state of a coder; a state has 63 bits at most and gives away 32 at once.
LOW = np.uint64(1 << 31)
_TRAILER = struct.Struct("<IIQQIIQ")
#: Ids that are coded or decoded side by side, documents of a batch that a reader gives, and those that a task takes from a batch at a time.
SIDE_IDS, READ_ROWS, SLICE_ROWS = 1 << 20, 2000, 2000
TABLE = "frequencies.bin"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Table:
    """Frequencies of all ids, with sum 2 ** BITS, and where each begins."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, np.int64)
        total, whole = max(int(counts.sum()), 1), 1 << BITS
        if np.count_nonzero(counts) > whole >> 1:
            raise ValueError("too many ids for the table")
        # At least 1 for an id that occurs; the commonest ids give what that takes.
        own = np.where(counts > 0, np.maximum(np.floor(counts / total * whole).astype(np.int64), 1), 0)
        if not counts.any():
            own[0] = whole
        over = int(own.sum()) - whole
        order = np.argsort(-own, kind="stable")
        if over < 0:
            own[order[0]] -= over
        while over > 0:
            for i in order:
                cut = min(over, int(own[i]) // 2)
                own[i] -= cut
                over -= cut
                if not over:
                    break
        self._set(own)

    def _set(self, own: np.ndarray) -> None:
        self.own = own.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.own)[:-1])).astype(np.uint64)
        self.id_at = np.repeat(np.arange(len(own), dtype=np.uint32), own.astype(np.int64))
        self.data = own.astype("<u4").tobytes()
        self.crc = zlib.crc32(self.data)

    @classmethod
    def read(cls, data: bytes) -> Table:
        out = cls.__new__(cls)
        out._set(np.frombuffer(data, "<u4").astype(np.int64))
        if len(out.id_at) != 1 << BITS:
            raise ValueError("the table is damaged")
        return out


def encode_blocks(ids: np.ndarray, shared: Table) -> list[dict]:
    """The blocks of a sequence of ids: states, words, places and checksums at the checkpoints. Blocks are coded side by side."""
    out = []
    if len(ids) and int(ids.max()) >= len(shared.own):
        raise ValueError("an id is not in the table")
    for at in range(0, len(ids), SIDE_IDS):
        some = ids[at : at + SIDE_IDS].astype(np.int64)
        blocks = -(-len(some) // BLOCK_IDS)
        # Rows are turns, columns the coders of all blocks. The last block is filled up with the commonest id, some bits each.
        filled = np.full(blocks * BLOCK_IDS, int(shared.own.argmax()), np.int64)
        filled[: len(some)] = some
        turns = filled.reshape(blocks, -1, LANES).transpose(1, 0, 2).reshape(-1, blocks * LANES)
        n = len(turns)
        state = np.full(blocks * LANES, LOW, np.uint64)
        words, given = np.zeros(turns.shape, np.uint32), np.zeros(turns.shape, bool)
        states = np.zeros((n // STEPS, blocks * LANES), np.uint64)
        bits, half = np.uint64(BITS), np.uint64(32)
        for t in range(n - 1, -1, -1):
            own, start = shared.own[turns[t]], shared.start[turns[t]]
            if not own.all():
                raise ValueError("an id is not in the table")
            full = state >= own << np.uint64(63 - BITS)
            given[t], words[t] = full, state.astype(np.uint32)
            state = np.where(full, state >> half, state)
            times, rest = np.divmod(state, own)
            state = (times << bits) + rest + start
            if t % STEPS == 0:
                states[t // STEPS] = state
        for b in range(blocks):
            lanes = slice(b * LANES, (b + 1) * LANES)
            mine = given[:, lanes]
            stream = words[:, lanes][mine]  # in the order in which the decoder asks
            # The words that a turn gave away are read after it, so those before a checkpoint's turn are behind the reader.
            places = np.concatenate(([0], np.cumsum(mine.sum(1))))[:-1:STEPS]
            whole = filled[b * BLOCK_IDS : (b + 1) * BLOCK_IDS].astype("<u4")
            n_ids = min(BLOCK_IDS, len(some) - b * BLOCK_IDS)
            parts = [zlib.crc32(whole[i : min(i + STEPS * LANES, n_ids)].tobytes()) for i in range(0, BLOCK_IDS, STEPS * LANES)]
            out.append({"states": states[:, lanes].astype("<u8").tobytes(), "words": stream.astype("<u4").tobytes(), "places": places, "crcs": parts, "n_ids": n_ids})
    return out


def decode_parts(states: np.ndarray, streams: list[np.ndarray], shared: Table) -> np.ndarray:
    """The ids of runs of ``STEPS`` turns that begin at checkpoints: states (run, lane), the words of every run from its place on; a row a run."""
    n = len(states)
    state = states.astype(np.uint64).ravel()
    lengths = np.array([len(x) for x in streams], np.int64)
    words = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(lengths)[:-1])) if n else np.zeros(0, np.int64)
    out = np.zeros((STEPS, n * LANES), np.uint32)
    mask, bits, half = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for t in range(STEPS):
        slot = state & mask
        ids = shared.id_at[slot]
        out[t] = ids
        state = shared.own[ids] * (state >> bits) + slot - shared.start[ids]
        low = (state < LOW).reshape(n, LANES)
        place = at[:, None] + np.cumsum(low, axis=1) - 1
        took = low.sum(1)
        flat = low.ravel()
        # A damaged stream may ask beyond its end; the checksums tell.
        state[flat] = (state[flat] << half) | words[np.minimum(place[low], len(words) - 1)]
        at = at + took
    return out.reshape(STEPS, n, LANES).transpose(1, 0, 2).reshape(n, -1)


def file_bytes(documents: list[tuple[int | None, int]], ids: np.ndarray, shared: Table) -> bytes:
    """A whole file of documents (doc_id, number of ids) and their ids."""
    blocks = encode_blocks(ids, shared)
    body, directory, at = [MAGIC], [], len(MAGIC)
    for x in blocks:
        data = x["states"] + x["words"]
        directory.append(struct.pack("<QQIII", at, len(data), x["n_ids"], len(x["words"]) // 4, zlib.crc32(data)) + np.asarray(x["places"], "<u4").tobytes() + np.asarray(x["crcs"], "<u4").tobytes())
        body.append(data)
        at += len(data)
    keys = np.array([0 if d is None else d for d, _ in documents], "<i8").tobytes() + np.array([d is None for d, _ in documents], np.uint8).tobytes() + np.array([n for _, n in documents], "<u8").tobytes()
    tail = keys + b"".join(directory)
    return b"".join([*body, tail, _TRAILER.pack(VERSION, len(blocks), len(documents), len(ids), zlib.crc32(tail), shared.crc, at), MAGIC])


class Reader:
    """A file, of which only the parts asked for are read."""

    ENTRY = 28 + 8 * CHECKPOINTS

    def __init__(self, source, size: int, shared: Table):
        self.source, self.shared = source, shared
        end = _TRAILER.size + len(MAGIC)
        head = self._read(size - end, end)
        version, n_blocks, n_documents, self.n_ids, crc, table_crc, at = _TRAILER.unpack(head[: _TRAILER.size])
        if head[_TRAILER.size :] != MAGIC or version != VERSION or table_crc != shared.crc:
            raise ValueError("no file of this kind, or of another table")
        tail = self._read(at, size - end - at)
        if zlib.crc32(tail) != crc:
            raise ValueError("the directory is damaged")
        self.keys = np.frombuffer(tail, "<i8", n_documents)
        self.nulls = np.frombuffer(tail, np.uint8, n_documents, 8 * n_documents).astype(bool)
        self.lengths = np.frombuffer(tail, "<u8", n_documents, 9 * n_documents).astype(np.int64)
        self.entries = []
        for i in range(n_blocks):
            place = 17 * n_documents + i * self.ENTRY
            self.entries.append((*struct.unpack_from("<QQIII", tail, place), np.frombuffer(tail, "<u4", CHECKPOINTS, place + 28), np.frombuffer(tail, "<u4", CHECKPOINTS, place + 28 + 4 * CHECKPOINTS)))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file: only the blocks that hold them are read, only from the checkpoint before on, and all checksums of what is decoded are compared."""
        stop = self.n_ids if stop is None else stop
        if stop <= start:
            return np.zeros(0, np.uint32)
        run, out = STEPS * LANES, []
        first, last = start // run, (stop - 1) // run
        side = max(1, SIDE_IDS // run)
        for low in range(first, last + 1, side):
            states, streams, crcs, lengths, block, data = [], [], [], [], None, b""
            for r in range(low, min(low + side, last + 1)):
                b, k = divmod(r, CHECKPOINTS)
                at, size, n_ids, n_words, crc, places, own = self.entries[b]
                if b != block:
                    block, data = b, self._read(at, size)
                    if zlib.crc32(data) != crc:
                        raise ValueError("a block is damaged")
                held = np.frombuffer(data, "<u8", CHECKPOINTS * LANES).reshape(CHECKPOINTS, LANES)
                words = np.frombuffer(data, "<u4", n_words, 8 * CHECKPOINTS * LANES)
                states.append(held[k])
                streams.append(words[places[k] : places[k + 1] if k + 1 < CHECKPOINTS else n_words])
                crcs.append(int(own[k]))
                lengths.append(max(0, min(run, n_ids - k * run)))
            for row, crc, n in zip(decode_parts(np.stack(states), streams, self.shared), crcs, lengths):
                row = row[:n]
                if zlib.crc32(row.astype("<u4").tobytes()) != crc:
                    raise ValueError("ids differ from their checksum")
                out.append(row)
        return np.concatenate(out)[start - first * run : stop - first * run]


_tables: dict[str, Table] = {}


def write_table(root: str, shared: Table) -> None:
    system, path = opened(root)
    with system.open_output_stream(f"{path}/{TABLE}", compression=None) as out:
        out.write(shared.data)


def read_table(root: str) -> Table:
    """Read once by each Python process."""
    if root not in _tables:
        _tables.clear()
        system, path = opened(root)
        with system.open_input_stream(f"{path}/{TABLE}", compression=None) as source:
            _tables[root] = Table.read(source.read())
    return _tables[root]


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark's batches have as many rows whatever their length; here a task turns some of them at a time into Python's objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)
        pa.default_memory_pool().release_unused()


def tokenised(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, int, int]:
    """(doc_id, tie, ids) of every document, written; the number of the vocabulary's ids; bytes of an id.

    The ids have ``end_id`` behind them and are little-endian integers of 16 bits if that suffices for the vocabulary, otherwise of 32. A null text is empty. The tie orders rows of one doc_id, or of none.
    """
    path = path or vocabulary()
    known = byte_ids(path)
    size, width = max(known.size, end_id + 1), known.kind.itemsize

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = byte_ids(path), end_id.to_bytes(width, "little")
        for batch in sliced(batches):
            ids = pa.array([x + end for x in known.batch(batch.column("text").to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    kind = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.BinaryType())])
    rows = docs.select("doc_id", "text").mapInArrow(encode, kind)
    return written(rows.select("doc_id", F.xxhash64("ids").alias("tie"), "ids"), "token-ids"), size, width


def count_ids(tokens: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each id occurs in all of ``tokens``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in sliced(batches):
            total += np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), f"<u{width}"), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row an id of the vocabulary
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


def write_files(tokens: DataFrame, root: str, n_ids: int, width: int, file_ids: int = FILE_IDS) -> DataFrame:
    """(part, number, file, bytes, n_documents, n_ids) of the files into which ``tokens`` are written in order of doc_id, null ids last; the order of files is that of part and number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, (system, path), part = read_table(root), opened(root), TaskContext.get().partitionId()
        held, documents, size, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{number:04d}-{uuid.uuid4().hex}.rans"
            data = file_bytes(documents, np.frombuffer(b"".join(held), f"<u{width}"), shared)
            with system.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "file": name, "bytes": len(data), "n_documents": len(documents), "n_ids": size}])

        for batch in sliced(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                held.append(ids)
                documents.append((doc_id, len(ids) // width))
                size += len(ids) // width
                if size >= file_ids:
                    yield flush()
                    held, documents, size, number = [], [], 0, number + 1
        if documents:
            yield flush()

    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    ranged = tokens.repartitionByRange(max(1, -(-n_ids // file_ids)), *order).sortWithinPartitions(*order)
    return ranged.select("doc_id", "ids").mapInArrow(write, "part long, number long, file string, bytes long, n_documents long, n_ids long")


def read_files(files: DataFrame, root: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of the documents in ``files``, a written table; start counts the ids before it in all files. Without ``with_ids`` they are decoded and summed up, but not given."""
    n_files = files.count()
    before = F.sum("n_ids").over(W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    placed = files.select("file", "bytes", F.coalesce(before, F.lit(0)).alias("before")).repartitionByRange(max(1, n_files), "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, (system, path) = read_table(root), opened(root)
        for batch in batches:
            for name, size, first in zip(*[batch.column(c).to_pylist() for c in ("file", "bytes", "before")]):
                with system.open_input_file(f"{path}/{name}") as source:
                    held = Reader(source, size, shared)
                    ids = memoryview(held.ids().astype("<u4").tobytes())
                ends = np.cumsum(held.lengths)
                starts = ends - held.lengths
                for i in range(0, len(ends), READ_ROWS):
                    some = slice(i, i + READ_ROWS)
                    parts = [ids[4 * a : 4 * b] for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(held.keys[some], pa.int64(), mask=held.nulls[some]), pa.array(starts[some] + first), pa.array(held.lengths[some]),
                            pa.array([zlib.crc32(x) for x in parts], pa.int64()), *([pa.array([bytes(x) for x in parts], pa.binary())] if with_ids else []),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])],
                    )

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes the ids of ``docs`` in a new folder; its URI and the written table of its files.

    doc_id is an integer of 64 bits at most. Rows of one doc_id stand in order of a hash of their ids, those without one are the last; repeated rows count each. An empty table gives no files. Other
    columns than doc_id and text are not read.
    """
    tokens, size, width = tokenised(docs.select("doc_id", "text"), path, end_id)
    counts = count_ids(tokens, size, width)
    root = new_folder(docs.sparkSession, "rans")
    write_table(root, Table(counts))
    return root, written(write_files(tokens, root, int(counts.sum()), width, file_ids), "rans-files")


def op13_binary_output(spark, sf_dir: str) -> DataFrame:
    root, files = write_ids(table(spark, sf_dir, "documents"))
    return read_files(files, root, with_ids=False)
