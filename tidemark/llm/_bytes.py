"""Hashes of words and shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[32, *range(9, 14)]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the rolling hash, and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(size, base, dtype=np.uint64)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(column: pa.Array | pa.ChunkedArray, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of at most ``chunk`` bytes or one row; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, times a power of the inverse, hash any stretch of ``data``."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch, alike for like bytes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, and the bounds of each row's words. Words are runs of bytes that are no white space."""
    if lower:
        data = _LOWER[data]
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = inside[at]
    at = offsets[1:][np.diff(offsets) > 0] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return stretch(prefix_sums(data), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row; the caller leaves out those that pass the end of a text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out += mix(hashes[i : i + n] * _PLACE[i] + np.uint64(i))
    return mix(out)


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` words in a row as a whole sequence, ``n`` being less than the words of a shingle."""
    many = len(hashes) - n + 1
    if many <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(many, n, dtype=np.uint64)
    for i in range(n):
        total += mix(hashes[i : i + many] * _PLACE[i] + np.uint64(n * 1000))
    return mix(total)


def short(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence of words shorter than a shingle."""
    return sequences(hashes, len(hashes))[0]
