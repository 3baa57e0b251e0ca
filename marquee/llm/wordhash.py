"""Word hashes of whole Arrow text columns, computed with numpy inside a task.

Words are runs of bytes outside space and 0x09-0x0D; A-Z may be lowered. A
word's hash is a polynomial over random byte values modulo 2**64, taken from
running sums, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_SPAN = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers from a rule."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_PRIME) + _U(salt)) | _U(1)


_VALUES = mix(np.arange(256, dtype=_U) + _U(77))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, _SPAN + 1)
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            steps = np.full(size, base, dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def row_groups(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` bytes at a time, one row at least."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield low, high
        low = high


def words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of each row (n + 1 of them)."""
    if not len(body):
        none = np.empty(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    gap = _SPACE[body]
    edge = np.empty(len(body) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = gap[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & ~gap)
    edge[:-1] = gap
    edge[offsets] = True
    ends = np.flatnonzero(edge[1:] & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    values = _VALUES[_LOWER] if lower else _VALUES
    out = np.empty(len(starts), dtype=_U)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + _SPAN, side="right")))
        s0 = starts[low]
        n = int(ends[high - 1] - s0)
        up, down = _powers(n)
        sums = np.empty(n + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(values[body[s0 : s0 + n]] * up[:n], out=sums[1:])
        s, e = starts[low:high] - s0, ends[low:high] - s0
        out[low:high] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        low = high
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word windows, and the first window of each row.

    A row with fewer words than ``size`` but at least one has one window of all its words.
    """
    counts = np.diff(first)
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(at[-1], dtype=_U)
    m = seeds(size, 5)
    if len(hashes) >= size:
        full = np.zeros(len(hashes) - size + 1, dtype=_U)
        for k in range(size):
            full += mix(hashes[k : k + len(full)] * m[k])
        rows = np.repeat(np.arange(len(counts)), np.where(counts >= size, per_row, 0))
        inside = np.arange(len(rows)) - np.repeat(
            np.cumsum(np.where(counts >= size, per_row, 0)) - np.where(counts >= size, per_row, 0),
            np.where(counts >= size, per_row, 0),
        )
        out[at[rows] + inside] = full[first[rows] + inside]
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[first[row] : first[row + 1]]
        out[at[row]] = mix(np.array([len(own)], dtype=_U)) + np.add.reduce(mix(own * m[: len(own)]))
    return mix(out), at
