"""64-bit hashes of words and word shingles over Arrow string arrays, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE_BYTES = 4 << 20
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def slices(texts: pa.Array, most: int = _SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes; nulls become empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + n > most:
            yield texts.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield texts.slice(at)


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered if asked), and how many each text has."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = offsets[0]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[base : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = (offsets - base).astype(np.int64)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    if lower:
        data = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    begins[edge] = inside[edge]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(inside).astype(np.int32)
    first = np.searchsorted(at, start)  # where each word begins among the characters of words
    length = np.diff(np.append(first, len(at)))
    depth = np.arange(len(at), dtype=np.int32) - np.repeat(first.astype(np.int32), length)
    h = np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[depth], first)
    counts = np.diff(np.searchsorted(start, bounds))
    return mixed(h ^ (length.astype(np.uint64) * _STEP)), counts


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash (63 bits) of each run of k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    s = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        s = mixed(s * _STEP + h[i : len(h) - k + 1 + i])
    return s >> np.uint64(1)


def shingles_by_text(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its k-word runs in order; one of the whole text if it has fewer words."""
    h, counts = word_hashes(texts)
    s = shingle_hashes(h, k)
    ends = np.cumsum(counts)
    for e, n in zip(ends.tolist(), counts.tolist()):
        if n >= k:
            yield s[e - n : e - k + 1]
        else:
            yield shingle_hashes(h[e - n : e], n) if n else s[:0]
