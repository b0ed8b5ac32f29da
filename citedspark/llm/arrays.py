"""Whole texts as byte arrays inside a task: words, their hashes and their documents.

Spark deals out the rows; these helpers turn the text column of an Arrow batch into numpy
arrays, so that a task works on bytes without a Python object for each word. Batches are cut
between rows into slices of about `limit` bytes; a longer text makes a slice of its own, so
memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
#: Powers of a base that a worker keeps at most; it keeps as many as its longest slice asked for.
KEPT_POWERS = 1 << 22
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8: powers keep all 64 bits apart


def _byte_values() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_VALUES = _byte_values()
_POWERS: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def whole_text(documents: DataFrame, text: str = "text") -> Column:
    """The text column, a null as the empty text."""
    return F.coalesce(documents[text], F.lit(""))


def carried(documents: DataFrame, text: str = "text") -> DataFrame:
    """row (a struct of all other columns) and text, so that names cannot clash with new columns."""
    others = [documents[name].alias(name) for name in documents.columns if name != text]
    return documents.select(F.struct(*others).alias("row"), documents[text].alias("text"))


def carried_columns(documents: DataFrame, text: str = "text") -> list[Column]:
    """The columns of `documents` again, from what `carried` made."""
    return [F.col("text").alias(text) if name == text else F.col("row")[name].alias(name) for name in documents.columns]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches with about `limit` bytes of text each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.nan_to_num(lengths.astype(np.float64)))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0.0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last
        del batch
        pa.default_memory_pool().release_unused()
    _give_back()


def _give_back() -> None:
    """Return freed memory to the machine at a task's end; the worker stays for later tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if array.null_count:
        array = pc.fill_null(array, "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, size: int) -> np.ndarray:
    """Powers of the base; those for a longer text than KEPT_POWERS are made anew and not kept."""
    key = f"{base:x}"
    known = _POWERS.get(key)
    if known is None or len(known) < size:
        steps = np.full(1 << max(16, (size - 1).bit_length()) if size <= KEPT_POWERS else size, base, np.uint64)
        steps[0] = 1
        known = np.cumprod(steps, dtype=np.uint64)
        if len(known) <= KEPT_POWERS:
            _POWERS[key] = known
    return known[:size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the bytes, for `range_hashes`."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * _powers(_BASE, len(data)), out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, equal for equal bytes wherever they stand."""
    back = _powers(pow(_BASE, -1, 1 << 64), len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of every run of `size` bytes, equal to those of `range_hashes`."""
    values = sums[size:] - sums[:-size]
    values *= _powers(pow(_BASE, -1, 1 << 64), len(values))
    values += np.uint64(size)
    return mixed(values)


class Words:
    """Words of a slice: byte ranges, document (row in the slice) and hash of each."""

    def __init__(self, array: pa.Array, member: np.ndarray, lower: bool = True) -> None:
        raw, self.offsets = text_bytes(array)
        self.data = LOWER[raw] if lower else raw
        size = len(self.data)
        inside = member[self.data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = self.offsets[:-1]
        edges = edges[edges < size]
        begins[edges] = inside[edges]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        lasts = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        closes[lasts] = inside[lasts]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        #: Word ranges of the rows: words of row i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))
        self.hashes = range_hashes(prefix_sums(self.data), self.starts, self.ends)


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `width` words; of the whole sequence where it is shorter."""
    counts = np.diff(words.first)
    rows, hashes = [], []
    total = len(words.hashes)
    if total >= width:
        value = np.zeros(total - width + 1, np.uint64)
        for step in range(width):
            value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + words.hashes[step : total - width + 1 + step])
        whole = words.row[: total - width + 1] == words.row[width - 1 :]
        rows.append(words.row[: total - width + 1][whole])
        hashes.append(value[whole])
    for length in range(1, width):
        short = np.flatnonzero(counts == length)
        value = np.full(len(short), length, np.uint64)
        for step in range(length):
            value = mixed(value * np.uint64(0xD6E8FEB86659FD93) + words.hashes[words.first[short] + step])
        rows.append(short)
        hashes.append(value)
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.uint64), *hashes])


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs, sorted by both."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]
