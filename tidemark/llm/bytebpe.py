"""Ids of texts by a byte-level BPE tokenizer, part by part."""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Parts whose ids a process keeps, and the longest of them in bytes.
CACHE_PARTS, CACHE_BYTES = 300_000, 32
#: Texts that are parted together, and about how many characters of them; new parts that the model encodes in a call.
BATCH, BATCH_CHARS, CALL = 2048, 1 << 21, 100
#: Stands behind each text of a batch.
END = "\U0010ffff"
_LETTER, _NUMBER, _OTHER, _WHITE, _END = range(1, 6)
_SPACE, _APOSTROPHE = 0x20, 0x27


class ByteIds:
    """The standard pattern of a byte-level tokenizer parts a text where letters, numbers, other characters and white space meet; BPE never joins parts. Here all texts of a batch are parted at once, by
    the classes of their characters, which the tokenizer's own byte-level step tells. Parts come back often: Arrow numbers a batch's different ones behind those kept, and
    new ones are encoded by the tokenizer's model, many in one call. What is kept are arrays, so that it takes about 50 bytes a part and no objects. Texts that may hold special tokens are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.parting = pre_tokenizers.ByteLevel(add_prefix_space=False)
        # The model's character for each byte, as the tokenizer's byte-level step has it; bytes that no UTF-8 text holds only part words.
        visible, shown = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), {}
        for c in [*range(0x800), *range(0x800, 0x10000, 0x40), *range(0x10000, 0x110000, 0x10000)]:
            if not 0xD800 <= c < 0xE000:
                shown.update(zip(chr(c).encode(), visible.pre_tokenize_str(chr(c))[0][0]))
        self.shown = "".join(shown.get(b, " ") for b in range(256))
        #: Bytes that each id stands for, which tell where a part ends among the ids of many.
        self.bytes_of = np.zeros(self.size + 1, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        #: Ids take 16 bits where that suffices for the vocabulary, otherwise 32.
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        #: Classes of characters, 0 for those not met yet.
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[ord(END)] = _END
        #: Parts that are kept, as UTF-8; their ids, one part's after the other's; how many each has; the batch that met each last.
        self.parts = pa.array([END.encode()], pa.large_binary())  # which has no ids, and is met in every batch
        self.ids, self.n_ids, self.met = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.batches = 0

    def _class_of(self, char: str) -> int:
        for beside, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
            if len(self.parting.pre_tokenize_str(beside + char)) == 1:
                return kind
        return _WHITE

    def _starts(self, codes: np.ndarray) -> np.ndarray:
        """Which characters begin a part; each text has END behind it."""
        kinds = self.classes[codes]
        if not kinds.all():
            for c in np.unique(codes[kinds == 0]).tolist():
                self.classes[c] = self._class_of(chr(c))
            kinds = self.classes[codes]
        starts = np.ones(len(codes), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        # A single space, or the last of some white space, goes to what is behind it unless the text ends there.
        starts[1:] &= (codes[:-1] != _SPACE) | (kinds[1:] >= _WHITE)
        starts[1:] |= kinds[1:] == _END
        starts[1:-1] |= (kinds[1:-1] == _WHITE) & (kinds[2:] < _WHITE)
        starts[1:] |= kinds[:-1] == _END
        at = np.flatnonzero(starts[:-1] & (codes[:-1] == _APOSTROPHE))  # an END is the last
        if len(at):
            one, two = codes[at + 1], codes[np.minimum(at + 2, len(codes) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            starts[at[short | long] + 1] = False
            starts[at[short] + 2] = True
            starts[at[long] + 3] = True
        return starts

    def _parted(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts, each text's END among them, and the places of the ENDs."""
        joined = END.join([*texts, ""])
        raw, codes = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), "<u4")
        at = np.flatnonzero(self._starts(codes))
        ends = np.flatnonzero(codes[at] == ord(END))
        if len(raw) > len(codes):  # from characters to bytes
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[at]
        return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw))), pa.py_buffer(raw)]), ends

    def _encoded(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts that stand one behind the other in ``raw``, and how many each has."""
        n, ends = len(lengths), np.cumsum(lengths)
        # A byte that no text has stands behind each part, and shows as a blank.
        spread = np.full(len(raw) + n, 0xFF, np.uint8)
        spread[np.arange(len(raw)) + np.repeat(np.arange(n), lengths)] = raw
        found, start = [np.zeros(0, "<u4")], 0
        for i in range(0, n, CALL):
            last = min(i + CALL, n) - 1
            stop = int(ends[last]) + last
            text = codecs.charmap_decode(spread[start:stop], "strict", self.shown)[0]
            found.append(np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            start = stop + 1
        ids = np.concatenate(found)
        upto = np.cumsum(self.bytes_of[ids])
        cuts = np.searchsorted(upto, ends)
        assert not n or (upto[cuts] == ends).all()
        return ids.astype(self.kind), np.diff(cuts + 1, prepend=0)

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``parts``, one's after the other's, and how many each has."""
        kept = len(self.parts)
        coded = pa.concat_arrays([self.parts, parts]).dictionary_encode()
        every, at = coded.dictionary, coded.indices.to_numpy()[kept:]
        offsets = np.frombuffer(every.buffers()[1], np.int64, len(every) + 1, 8 * every.offset)
        lengths = np.diff(offsets)
        new = slice(int(offsets[kept]), int(offsets[-1]))
        new_ids, n_new = self._encoded(np.frombuffer(every.buffers()[2], np.uint8)[new], lengths[kept:])
        ids, n_ids = np.concatenate((self.ids, new_ids)), np.concatenate((self.n_ids, n_new))
        starts, n = np.cumsum(n_ids) - n_ids, n_ids[at]
        out = ids[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self._keep(every, lengths, ids, n_ids, at)
        return out, n

    def _keep(self, every: pa.Array, lengths: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, at: np.ndarray) -> None:
        """Keeps the parts of a batch and those kept before; of too many, the half that was met last."""
        self.batches += 1
        met = np.concatenate((self.met, np.zeros(len(every) - len(self.met), np.int64)))
        met[at] = self.batches
        stay = lengths <= CACHE_BYTES
        if np.count_nonzero(stay) > CACHE_PARTS:
            short = np.flatnonzero(stay)
            stay[:] = False
            stay[short[np.argsort(-met[short], kind="stable")[: CACHE_PARTS // 2]]] = True
        self.parts, self.ids, self.n_ids, self.met = every.filter(pa.array(stay)), ids[np.repeat(stay, n_ids)], n_ids[stay], met[stay]

    def _grouped(self, texts: list[str | None]) -> Iterator[list[str]]:
        some, chars = [], 0
        for text in texts:
            some.append(text or "")
            chars += len(some[-1])
            if len(some) == BATCH or chars >= BATCH_CHARS:
                yield some
                some, chars = [], 0
        if some:
            yield some

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian integers of ``kind``."""
        for some in self._grouped(texts):
            whole = ["<|" in x or END in x for x in some]
            parts, ends = self._parted(["" if w else x for w, x in zip(whole, some)])
            ids, n = self._ids_of(parts)
            start = 0
            for w, text, end in zip(whole, some, np.cumsum(n)[ends].tolist()):
                yield self._encode(text) if w else ids[start:end].tobytes()
                start = end

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind).tobytes()


_loaded: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """One for each Python process, which serves many tasks."""
    if path not in _loaded:
        _loaded[path] = ByteIds(path)
    return _loaded[path]
