"""Array helpers over Arrow text columns: bytes, words, hashes and window minima, without a Python loop for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one pass of array work takes at most (a longer document is a block of its own).
BLOCK_BYTES = 2_000_000

_rng = np.random.default_rng(20240229)
_BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls and grown by doubling."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about `size` bytes: first, end, their bytes and their offsets from 0."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without space, tab, LF, VT, FF, CR), and the n + 1 offsets of the documents in the list of words."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=inside[1:-1])
    edge = np.zeros(len(data) + 1, bool)  # a document begins here
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def windows_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive codes (n - width + 1 of them)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h *= _BASE
        h += codes[j : j + n]
    return mix(h)


def byte_windows_hash(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive bytes (n - width + 1 of them)."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE, n))


def window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values, by doubling."""
    have, low = 1, x
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def minimizers(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `width` consecutive keys, the place of its smallest key by the upper 32 bits (the leftmost of equals).

    The choice depends on the run's keys alone. Returns the chosen places in order, without repetition, and for each run
    the index of its choice in that list.
    """
    if len(keys) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    placed = (keys >> np.uint64(32) << np.uint64(32)) | np.arange(len(keys), dtype=np.uint64)
    place = (window_minimum(placed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(place), bool)
    np.not_equal(place[1:], place[:-1], out=new[1:])
    return place[new], np.cumsum(new) - 1
