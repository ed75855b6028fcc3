"""Whole-batch text handling in numpy: buffers, words and their hashes.

An Arrow string column is one byte buffer with offsets. The functions here find and
hash all words of such a buffer with array operations, so no Python code runs per word.
Null texts count as empty everywhere in this package.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time; working arrays take some thirty times as much.
SLICE_BYTES = 4 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # not with this C library
    _LIBC = None

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of column ``text`` (or one row)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        begun, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > most:
                yield batch.slice(begun, row - begun)
                begun, held = row, 0
            held += size
        if begun < len(sizes):
            yield batch.slice(begun)
    give_back()


def give_back() -> None:
    """Return memory that was freed but kept for reuse, as a worker serves one stage after another."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def verdicts(judge: Callable[[pa.Array], np.ndarray], most: int):
    """An Arrow function of texts alone, which gives ``judge``'s flag for each, a slice at a time."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            batch = pa.record_batch([column], ["text"])
            flags = [judge(part.column("text")) for part in text_slices([batch], most)]
            yield pa.array(np.concatenate([np.zeros(0, bool), *flags]))
    return F.arrow_udf(run, "boolean")


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, row offsets with one more entry than rows)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true within the (first, last) ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


#: Everything but blank, tab, line feed, vertical tab, form feed and carriage return.
NOT_BLANK = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and all bytes of longer characters.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NEWLINE_FREE = ~byte_class((0x0A, 0x0A))


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[0x41:0x5B] = values[0x61:0x7B]  # A-Z hash like a-z
    return values


_VALUES = _byte_values()
_EXACT = np.random.default_rng(20240502).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """(starts, ends, row) of the maximal runs of ``inside`` bytes; none crosses a row."""
    flags = inside[data]
    before = np.empty_like(flags)
    before[1:] = flags[:-1]
    bounds = offsets[:-1][offsets[:-1] < len(data)]
    before[bounds] = False
    after = np.empty_like(flags)
    after[:-1] = flags[1:]
    if len(flags):
        after[-1] = False
        after[bounds[bounds > 0] - 1] = False
    starts = np.flatnonzero(flags & ~before)
    ends = np.flatnonzero(flags & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *,
                fold_case: bool = True) -> np.ndarray:
    """A 64-bit hash of every span's bytes: a polynomial taken from prefix sums."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers = np.full(len(data), _BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_VALUES if fold_case else _EXACT)[data] * powers, out=sums[1:])
    powers[:] = _INVERSE
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    return mix((sums[ends] - sums[starts]) * powers[starts])


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its word shingles.

    Words are runs of non-blank bytes, A-Z lower-cased. A row of fewer words than
    ``width`` has one shingle, the whole sequence; a row without words has none.
    """
    data, offsets = buffer_of(column)
    starts, ends, row = spans(data, offsets, NOT_BLANK)
    hashes = span_hashes(data, starts, ends)
    rows = len(column)
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    sets = []
    rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * _BASE + hashes[k:k + len(rolled)]
    rolled = mix(rolled)
    for i in range(rows):
        a, n = first[i], counts[i]
        if n >= width:
            sets.append(np.unique(rolled[a:a + n - width + 1]))
        elif n:
            value = np.uint64(n)
            with np.errstate(over="ignore"):
                for h in hashes[a:a + n]:
                    value = value * _INVERSE + h
            sets.append(mix(np.array([value], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
