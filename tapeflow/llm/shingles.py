"""Word shingles of whole texts as 64-bit hashes, for many texts at once on the bytes of an Arrow column.

Words are runs without the six ASCII white-space characters. A text of k or more words has the hashes of its windows of
k words; one of 1 to k-1 words has the one hash of all its words; a null or empty text, or one of white space, has none.
Hashes are the same on every machine and in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tapeflow.llm.common import mix64, words64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, one after the other, and where each begins (one more than texts)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, in order, and the number of words of each text."""
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at) - 1, dtype=np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[at] = True
    starts = inside & (first[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (first[1:] | np.concatenate((~inside[1:], [True])))
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    value = (total[end] - total[begin]) * _powers(_BASE_INVERSE, len(data))[begin]
    counts = np.diff(np.searchsorted(begin, at))
    return mix64(value ^ ((end - begin).astype(np.uint64) * _LENGTH)), counts


def shingles(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles."""
    words, counts = word_hashes(*text_bytes(column))
    factors = words64(7, k)
    padded = np.concatenate((words, np.zeros(k, dtype=np.uint64)))
    windows = np.zeros(len(words), dtype=np.uint64)
    for i in range(k):
        windows += padded[i : i + len(words)] * factors[i]
    windows = mix64(windows)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(windows[at : at + n - k + 1]))
        elif n:
            short = np.array([n], dtype=np.uint64) * _LENGTH + (words[at : at + n] * factors[:n]).sum(dtype=np.uint64)
            out.append(mix64(short))
        else:
            out.append(windows[:0])
        at += n
    return out


def minhash(sets: list[np.ndarray], t: int) -> np.ndarray:
    """(texts, t) of 32-bit minima under t hash functions; zeros for an empty set."""
    out = np.zeros((len(sets), t), dtype=np.uint32)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    every = np.concatenate([sets[i] for i in full])
    at = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    salt, factor = words64(11, t), words64(13, t)
    for i in range(t):
        out[full, i] = np.minimum.reduceat((every ^ salt[i]) * factor[i], at) >> np.uint64(32)
    return out


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: a wrapping sum and an exclusive or of two mixes of its members."""
    a = (mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64)
    b = np.bitwise_xor.reduce(mix64(s * _LENGTH), initial=np.uint64(0)).astype(np.int64)
    return int(a), int(b)
