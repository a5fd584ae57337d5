"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A column is worked on in chunks of whole rows (about CHUNK bytes, or one
longer row). Within a chunk, words are found and hashed with a few numpy
passes over the bytes, so no Python code runs once a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U64 = np.uint64
_GOLD = 0x9E3779B97F4A7C15


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker, which waits for further tasks, gives memory that it doesn't use back to the system."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = x + U64(_GOLD)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Powers:
    """p**i and p**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 12)
            with np.errstate(over="ignore"):
                self.up, self.down = (
                    np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, b, U64))])
                    for b in (self.base, self.inverse)
                )
        return self.up, self.down


_BYTES, _WORDS, _WORDS2 = Powers(0xD6E8FEB86659FD93), Powers(0xCA5A826395121157), Powers(0x8EBC6AF09C88C6E3)
_OF_BYTE = mix(np.arange(1, 257, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: The word classes of the contracts, over bytes (all bytes of non-ASCII characters belong to words).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


@dataclass
class Chunk:
    """Whole rows lo..hi of a column: their bytes, and where each row starts (one more than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[Chunk]:
    """Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(pc.cast(column, pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte ranges, hashes, and the number of the first word of each row."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(chunk: Chunk, kind: np.ndarray, lower: bool = False) -> Words:
    data = _LOWER[chunk.data] if lower else chunk.data
    inside = kind[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[chunk.offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _BYTES.get(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(_OF_BYTE[data] * up[:n], out=total[1:])
        value = mix((total[end] - total[start]) * down[start])
    return Words(data, start, end, value, np.searchsorted(start, chunk.offsets))


class Sequences:
    """Hashes of any ranges of consecutive words, from prefix sums of their hashes."""

    def __init__(self, hashes: np.ndarray, second: bool = False):
        powers = _WORDS2 if second else _WORDS
        if second:
            hashes = mix(hashes ^ U64(0x5851F42D4C957F2D))
        up, self.down = powers.get(len(hashes) + 1)
        self.total = np.zeros(len(hashes) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[start + length] - self.total[start]) * self.down[start] + mix(np.asarray(length, U64)))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All the numbers of the given ranges, one range after another."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.arange(total) - np.repeat(ends - length, length) + np.repeat(start, length)


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
