"""Words, hashes and shingles of whole texts, vectorised over the bytes of an Arrow column.

A word is a run of bytes other than space and \\t-\\r; A-Z count as a-z. Texts are taken in pieces of
about a quarter of a megabyte (a longer text is a piece of its own), so memory follows the longest text, not the
batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 18
SPACES = bytes([0x20, *range(0x09, 0x0E)])

Batches = Iterator[pa.RecordBatch]

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: its powers repeat as late as possible
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_U = np.uint64


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20_240_101).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_FOLDED = _byte_values()
_EXACT = np.random.default_rng(20_240_102).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def id_crc32(id_column: str) -> Column:
    """crc32 of an id written as text; NULL for a NULL id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


def given_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, whose freed memory goes back to the machine as the task ends: Spark keeps the worker processes
    for later tasks, and allocators would keep the size of the largest batches in each of them."""

    def trimmed(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
        if trim:
            trim(0)

    return trimmed


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)  # those of usual pieces stay beside those of a long text
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return run(_BASE), run(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse; sizes are rounded up so that few are kept."""
    return _powers(max(2 * PIECE_BYTES, 1 << int(n).bit_length()))


@dataclass
class Piece:
    """Some rows of a column: their bytes end to end, and where each row begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a column of texts (NULL: empty) into pieces of at most ``most`` bytes or one row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield Piece(at, values[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def prefix_hash(data: np.ndarray, folded: bool = False) -> np.ndarray:
    """Sums from which the hash of any range comes by one subtraction and one product."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if folded else _EXACT)[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


@dataclass
class Words:
    """The words of a piece: where they are, and how many each row has."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # of each row's words among all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words(piece: Piece) -> Words:
    ink = ~_IS_SPACE[piece.data]
    full = piece.bounds[:-1] < piece.bounds[1:]
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    for mask, at in ((begin, piece.bounds[:-1][full]), (end, piece.bounds[1:][full] - 1)):
        mask[at] = ink[at]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, piece.bounds))


def word_hashes(piece: Piece, found: Words) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    return range_hash(prefix_hash(piece.data, folded=True), found.starts, found.ends)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles of ``n`` words, as sorted hashes.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    for piece in pieces(column):
        found = words(piece)
        w = word_hashes(piece, found)
        rolled = w.copy()
        for j in range(1, n):
            rolled[: len(w) - j] = mix(rolled[: len(w) - j] * _U(0xD6E8FEB86659FD93) + w[j:])
        for a, b in zip(found.bounds[:-1], found.bounds[1:]):
            if b - a >= n:
                yield np.unique(rolled[a : b - n + 1])
            elif b > a:
                short = w[a : a + 1]
                for j in range(a + 1, b):
                    short = mix(short * _U(0xD6E8FEB86659FD93) + w[j : j + 1])
                yield short + _U(b - a)  # never taken for a shingle of other length
            else:
                yield w[:0]


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for NULL. Each word with the space behind it becomes one letter, so no word
    is held and the text does not leave Spark."""
    space = "\\x20\\x09-\\x0D"
    words = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{space}]++", "")
    return F.length(F.regexp_replace(words, f"[^{space}]++[{space}]*+", "x")).cast("long")
