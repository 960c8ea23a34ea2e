"""Word hashes and shingle sets of whole texts, computed on the texts' bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
#: One odd 64-bit value for each byte, those of A-Z as of a-z, 0 for the six white-space bytes.
_VALUE = (np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1))[_LOWER]
_VALUE[_SPACE] = 0
_BASE, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes and each text's offset into them (with the end of the last)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def word_places(texts: pa.Array, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, where each word begins in them, and each text's first word (with the end).

    `gaps` marks the bytes that are in no word.
    """
    data, at = raw_bytes(texts)
    begins = ~gaps[data]
    if len(data):
        after = begins[:-1].copy()
        heads = at[1:-1]
        after[heads[(heads > 0) & (heads < len(data))] - 1] = False  # a text's first byte follows no word
        begins[1:] &= ~after
    starts = np.flatnonzero(begins)
    return data, starts, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z), and each text's first word (with the end)."""
    data, starts, at = word_places(texts, gaps)
    return hash_words(data, starts, gaps), at


def hash_words(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray = _SPACE) -> np.ndarray:
    values = np.where(gaps, U64(0), _VALUE)
    out, ends, at = np.zeros(len(starts), U64), np.append(starts[1:], len(data)), 0
    while at < len(starts):  # in blocks, as each byte takes several words of memory
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        begins, spans = starts[at:to], (ends - starts)[at:to]
        within = np.arange(begins[0], ends[to - 1]) - np.repeat(begins, spans)
        raw = values[data[begins[0] : ends[to - 1]]] * powers(_BASE, int(spans.max()))[within]
        out[at:to] = np.add.reduceat(raw, begins - begins[0])
        at = to
    return mix(out)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: `width` words, or all words of a shorter text."""
    words, at = word_hashes(texts)
    factors = powers(_STEP, width)
    n = max(0, len(words) - width + 1)
    grams = np.zeros(n, U64)
    for j in range(width):
        grams += words[j : j + n] * factors[j]
    grams = mix(grams)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield mix((words[a:b] * factors[: b - a]).sum(keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)
