"""Words and word hashes of a batch of texts as flat numpy arrays. Bounded memory: callers pass slices of a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000
_LONG_WORD = 256
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `limit` bytes of text each (one row at least)."""
    limit = limit or SLICE_BYTES
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start, n = 0, len(sizes)
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the rows, one after the other, and n + 1 offsets. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if len(texts) == 0 or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word (bytes other than 0x20 and 0x09-0x0D), and the index of each row's first word (n + 1)."""
    blank = _BLANK[data]
    after, before = np.ones(len(data), bool), np.ones(len(data), bool)
    after[1:], before[:-1] = blank[:-1], blank[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    after[inner], before[inner - 1] = True, True
    starts = np.flatnonzero(~blank & after)
    lengths = np.flatnonzero(~blank & before) + 1 - starts
    return starts, lengths, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, eight bytes a step; long words by blake2b."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    h = mix64(lengths.astype(np.uint64) * np.uint64(_ODD[0]))
    todo, step = np.flatnonzero(lengths <= _LONG_WORD), 0
    while len(todo):
        rest = np.minimum(lengths[todo] - step, 8)
        h[todo] = mix64(h[todo] ^ (eight[starts[todo] + step] & _KEEP[rest]))
        step += 8
        todo = todo[lengths[todo] > step]
    for i in np.flatnonzero(lengths > _LONG_WORD):
        raw = data[starts[i]:starts[i] + lengths[i]].tobytes()
        h[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)[0]
    return h


def _factor(k: int) -> np.uint64:
    """Odd factor of the k-th word of a shingle."""
    return np.uint64((_ODD[k % 5] + 2 * (k // 5)) % 2**64)


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's word shingles, lower-cased (A-Z). Fewer words than `size`: the whole
    sequence is the one shingle; no words: empty."""
    for a, b in slices(texts):
        data, offsets = text_bytes(texts[a:b])
        data = _LOWER[data]
        starts, lengths, first = blank_words(data, offsets)
        h = word_hashes(data, starts, lengths)
        n = len(h)
        rolled = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size if n >= size else 0):
            rolled += h[k:n - size + 1 + k] * _factor(k)
        rolled = mix64(rolled)
        for i in range(b - a):
            lo, hi = int(first[i]), int(first[i + 1])
            if hi - lo >= size:
                yield np.unique(rolled[lo:hi - size + 1])
            elif hi > lo:
                short = np.array([hi - lo], np.uint64)
                for k in range(hi - lo):
                    short = short + h[lo + k:lo + k + 1] * _factor(k)
                yield mix64(short)
            else:
                yield np.zeros(0, np.uint64)
