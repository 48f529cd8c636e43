"""Numpy kernels over Arrow string buffers: words, lines and their hashes without a Python object a word.

All of them work on one chunk of whole texts: ``data`` holds the UTF-8 bytes of the texts one after
another and ``offsets`` their limits. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of spans that are hashed at once. A longer span is hashed by itself.
HASH_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word when words are ASCII letters and digits and whatever is not ASCII.
_SIGN = np.ones(256, bool)
_SIGN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """The first n powers of the word multiplier modulo 2**64; the table grows to the longest word met."""
    global _powers
    if len(_powers) < n:
        table = np.full(max(n, 2 * len(_powers), 256), _MULTIPLIER, np.uint64)
        table[0] = 1
        _powers = np.cumprod(table, dtype=np.uint64)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and limits of the texts of an Arrow array."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = texts.buffers()
    offsets = np.frombuffer(limits, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, data, offsets) of runs of rows with about ``limit`` bytes."""
    data, offsets = buffers(texts)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, signs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of each text's first word (one more than texts).

    Words are parted by ASCII white space, or with ``signs`` by whatever is ASCII but no letter or digit.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~(_SIGN if signs else _SPACE)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    filled = np.flatnonzero(lengths)
    out = np.zeros(len(starts), np.uint64)
    total = np.cumsum(lengths[filled])
    low = 0
    while low < len(filled):
        # the places of all bytes at once would take forty times the text
        high = max(int(np.searchsorted(total, (total[low - 1] if low else 0) + HASH_BYTES, "right")), low + 1)
        own = filled[low:high]
        size = lengths[own]
        first = np.cumsum(size) - size
        within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        at = within + np.repeat(starts[own], size)
        out[own] = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * powers(int(size.max()))[within], first)
        low = high
    return mix(out + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words that lie within one text, and the index of each text's first window."""
    per_text = np.diff(first)
    windows = np.maximum(per_text - k + 1, 0)
    limits = np.concatenate(([0], np.cumsum(windows)))
    at = np.arange(int(limits[-1]), dtype=np.int64) + np.repeat(first[:-1] - limits[:-1], windows)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = out * _STEP + words[at + j]
    return mix(out), limits


def owners(limits: np.ndarray) -> np.ndarray:
    """The text of each item, from the index of each text's first item."""
    return np.repeat(np.arange(len(limits) - 1), np.diff(limits))
