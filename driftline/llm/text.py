"""Whole texts as flat byte arrays: the vectorised base of the word and byte operators.

A column of texts is taken as one byte array with row offsets. Words are ``[^\\x20\\x09-\\x0D]+``; a null text counts as
empty. Hashes are 64 bits: a random odd multiplier for each byte value and position, summed modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once inside a task; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20


#: Rows of an Arrow batch that carries whole texts.
ROWS = 500


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python ROWS at a time or fewer.

    Spark counts batches in rows, 10,000 of them; of long texts that is far more than a worker, and the executor that
    fills the batch, should hold.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ROWS:
        conf.set(key, str(ROWS))
    return df


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def noise(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


BYTE_NOISE = noise(256, 11)
_PLACES = [noise(64, 12)]


def places(n: int) -> np.ndarray:
    """Multipliers for positions 0 to n - 1, kept between calls."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = noise(max(n, 2 * len(_PLACES[0])), 12)
    return _PLACES[0][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``mask`` within each row."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def segment_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``data[start:end]`` for each non-empty, ordered, disjoint segment."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    part = data[np.repeat(starts, lengths) + at]
    sums = np.add.reduceat(BYTE_NOISE[part] * places(int(lengths.max()))[at], first)
    return mix(sums + lengths.astype(np.uint64))


class Words:
    """The words of a run of texts: byte spans, hashes and the word offsets of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | edge[1:n]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:n]
        self.inside = inside
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.row = np.searchsorted(self.starts, offsets)
        self.hashes = segment_hash(data, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.row))

    def window_hash(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all windows of ``width`` words that lie in one text."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        total = np.zeros(len(at), np.uint64)
        for k, factor in enumerate(noise(width, 13)):
            total += self.hashes[at + k] * factor
        return at, mix(total)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
