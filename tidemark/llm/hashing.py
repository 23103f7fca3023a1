"""Vectorised hashes of words and of runs of words, over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Odd multiplier of the word hash, and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are hashed at once, and texts at most; a longer text is hashed alone.
CHUNK_BYTES, CHUNK_TEXTS = 1 << 20, 256

_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        grown = []
        for base in (BASE, _INVERSE):
            steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _up, _down = grown
    return _up[:n], _down[:n]


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts in UTF-8) of about CHUNK_BYTES each, CHUNK_TEXTS at most."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and (size + len(raw) > CHUNK_BYTES or len(held) == CHUNK_TEXTS):
            yield first, held
            first, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    data = np.frombuffer(b"\n".join([*raws, b""]), np.uint8)
    blank = _BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * up[ends])
    bounds = np.cumsum([len(x) + 1 for x in raws])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_hashes(raws: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the number of them in each text.

    A text of fewer words but not none has one run, of all its words.
    """
    words, counts = word_hashes(raws)
    factors = [np.uint64(pow(BASE, 2 * j + 3, 1 << 64)) for j in range(width)]
    parts, at = [], 0
    n_runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    whole = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for j, f in enumerate(factors):
        whole += words[j : len(words) - width + 1 + j] * f if len(whole) else whole
    whole = mix(whole)
    for n in counts:
        if n >= width:
            parts.append(whole[at : at + n - width + 1])
        elif n:
            short = words[at : at + n]
            parts.append(mix(np.array([sum(int(w) * int(f) for w, f in zip(short, factors)) + int(n) & (1 << 64) - 1], np.uint64)))
        at += n
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), n_runs
