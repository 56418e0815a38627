"""Vectorised text kernels over Arrow string columns.

A whole chunk of documents is handled as one byte array: words are found with
a byte-class table, hashed by differences of one running polynomial sum, and
windows of words are combined from the word hashes, so that no Python loop
runs over words.  All hashes are unsigned 64 bit with wrap-around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

if TaskContext.get() is not None:  # a worker gives memory back when a batch is done
    pa.set_memory_pool(pa.system_memory_pool())

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, 3 modulo 4
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def _byte_values() -> np.ndarray:
    """A random value for each byte; A-Z share the values of a-z."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    values[65:91] = values[97:123]
    return values


VALUES = _byte_values()


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to words; `excluded` holds inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in excluded:
        table[low : high + 1] = False
    return table


#: Anything but space and the control white space 09-0D.
NON_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Digits, a-z (and A-Z, which are folded) and everything outside ASCII.
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = _geometric(_BASE, size)
                self.down = _geometric(_BASE_INVERSE, size)
        return self.up, self.down


def _geometric(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    have = 1
    while have < size:
        take = min(have, size - have)
        out[have : have + take] = out[:take] * _U(pow(base, have, 1 << 64))
        have += take
    return out


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that any bits of the result may be used."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h = h * _U(0xBF58476D1CE4E5B9)
        h = h ^ (h >> _U(27))
        h = h * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `limit` bytes; at least one each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """The words of a chunk: byte ranges, hashes, and where each document's begin."""

    __slots__ = ("_hashes", "_sums", "_values", "data", "ends", "first", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, values: np.ndarray = VALUES) -> None:
        self.data, self.offsets = data, offsets
        inside = table[data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = offsets[:-1]
        cut = cut[cut < len(data)]
        start[cut] = inside[cut]
        cut = cut[cut > 0] - 1
        end[cut] = inside[cut]
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._values, self._sums, self._hashes = values, None, None

    @property
    def sums(self) -> np.ndarray:
        """The running polynomial sums, made when first asked for."""
        if self._sums is None:
            up, _ = _POWERS.get(len(self.data) + 1)
            with np.errstate(over="ignore"):
                self._sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
                np.cumsum(self._values[self.data] * up[: len(self.data)], out=self._sums[1:])
        return self._sums

    @property
    def hashes(self) -> np.ndarray:
        """The hash of each word; the sums, eight bytes for each byte of text, are let go."""
        if self._hashes is None:
            _, down = _POWERS.get(len(self.data) + 1)
            with np.errstate(over="ignore"):
                self._hashes = mix((self.sums[self.ends] - self.sums[self.starts]) * down[self.starts])
            self._sums = None
        return self._hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_words(column, table: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for chunks of a string column."""
    data, offsets = column_bytes(column)
    for i, j in chunks(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words; run i starts at word i."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for k in range(1, width):
            out *= _U(_STEP)
            out += hashes[k : k + n]
        return mix(out + _U(width))


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each segment of a sequence of word hashes, whatever its length."""
    up, down = _POWERS.get(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gapped_hashes(values: np.ndarray, starts: np.ndarray, holes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`segment_hashes` of each segment without its word at `holes`."""
    up, down = _POWERS.get(len(values) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=sums[1:])
        before = sums[holes] - sums[starts]
        after = (sums[ends] - sums[holes + 1]) * _U(_BASE_INVERSE)
        return mix((before + after) * down[starts] + (ends - starts - 1).astype(np.uint64))


def whole(hashes: np.ndarray) -> np.ndarray:
    """The one hash of a sequence of words that is shorter than a window."""
    return windows(hashes, len(hashes)) if len(hashes) else np.empty(0, dtype=np.uint64)


def member(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array."""
    if not len(sorted_values) or not len(values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def binary_array(parts: list[np.ndarray]) -> pa.Array:
    """One binary value for each array, without a copy for each."""
    sizes = np.array([p.nbytes for p in parts], dtype=np.int64)
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    data = np.concatenate([np.ascontiguousarray(p).view(np.uint8).ravel() for p in parts]) if parts else np.empty(0, dtype=np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column as one array, and the offsets of its rows."""
    d, o = column_bytes(column)
    size = np.dtype(dtype).itemsize
    return np.frombuffer(d.tobytes(), dtype=dtype), o // size


#: What A-Z become; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def distinct(words: Words, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(number of each word, the distinct words as strings) of a chunk; exact, since the strings themselves are compared."""
    return distinct_slices(LOWER[words.data] if lower else words.data, words.starts, words.ends)


def distinct_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    size = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=size[1:])
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.repeat((starts - size[:-1]).astype(kind), np.diff(size)) + np.arange(size[-1], dtype=kind)
    column = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(size), pa.py_buffer(data[at])]).dictionary_encode()
    return column.indices.to_numpy(zero_copy_only=False).astype(np.int64), column.dictionary
