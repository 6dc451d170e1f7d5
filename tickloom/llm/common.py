"""Shared pieces: whole texts as byte arrays, word finding, hashing, shared storage.

Texts reach Python in Arrow batches.  A batch is cut into slices of a few MB
(one document at least), so memory is bounded by the slice or the longest
document, never by the partition.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import passing as passing  # for the operators of this subpackage
from ..shipping import ship as ship

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20
#: Rows of a side (languages, sources) up to which it is broadcast.
SMALL_ROWS = 100_000
#: Word separators: space and the ASCII controls 9 to 13.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same as a regular expression for one word.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once and kept in the shared folder, without their lineage."""
    return table(df, "settled")


def replaced(df: DataFrame, old: DataFrame | None) -> DataFrame:
    """The rows settled; then the table that they came from, which nothing else reads, goes."""
    new = settled(df)
    if old is not None:
        forget(old)
    return new


def forget(*tables: DataFrame) -> None:
    """Deletes tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(df.place)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A settled table of few rows, to be broadcast if they are indeed at most so many; else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def table(df: DataFrame, name: str) -> DataFrame:
    """The rows as a compressed table in the shared folder: for wide rows."""
    spark = df.sparkSession
    path = passing(spark, name)
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows.place = path
    return rows


def fresh(taken: list[str], name: str) -> str:
    """`name`, lengthened until it clashes with no column (in any letter case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


# ---------------------------------------------------------------- text arrays


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their bounds; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most so many bytes, or one document.

    After the last one unused memory goes back: idle workers would keep it.
    """
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    give_back()


def give_back() -> None:
    """Hands the unused memory of Arrow, and of the C library where it can, to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(way: str, n: int) -> np.ndarray:
    """The first n powers; kept for slices, made anew for longer texts."""
    most = SLICE_BYTES + 1
    if n > len(_powers[way]):
        steps = np.full(max(n, most), _BASE if way == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        powers = np.cumprod(steps)
        if n > most:
            return powers
        _powers[way] = powers
    return _powers[way][:n]


class Words:
    """The words of the documents `bounds` cuts `data` into.

    start, end: byte bounds of each word; first: index of each document's
    first word, with the total last; doc: each word's document.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        self.data, self.bounds = data, bounds
        self.apart = apart = _IS_SEPARATOR[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = apart[:-1], apart[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        before[inner] = True
        after[inner - 1] = True
        self.start = np.flatnonzero(before & ~apart)
        self.end = np.flatnonzero(after & ~apart) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self._sums: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; the same bytes give the same hash in any document."""
        if self._sums is None:
            n = len(self.data)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * _power("up", n), out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * _power("down", len(self.data) + 1)[start])

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of k words within a document."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * _BASE + hashes[i : n + i]
        left = np.repeat(self.first[1:], self.counts)[:n] - np.arange(n)
        at = np.flatnonzero(left >= k)
        return at, mix(h[at])


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; faster than np.unique on large integer arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
