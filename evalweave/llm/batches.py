"""Arrow batches as flat NumPy arrays: words, ragged lists and bounded slices of texts.

A worker never works on a whole Arrow batch at once: ``text_slices`` cuts it into runs of rows of a
few megabytes (one longer text is a run of its own), which bounds the temporary arrays.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Texts(NamedTuple):
    """The UTF-8 bytes of some texts, one after another; text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray


class Words(NamedTuple):
    """Words of some texts: byte spans, and the first word of each text in ``first`` (one entry more)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def trim_memory() -> None:
    """Give freed memory back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def release_memory() -> None:
    gc.collect()
    trim_memory()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same map over batches, with its memory given back at the end of the task.

    Python workers outlive their tasks; what one stage needed must not stand beside what the next one does.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def texts_of(column: pa.Array) -> Texts:
    """Flat bytes of a string column; null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = column.cast(pa.large_string())
    if not len(wide):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, data = wide.buffers()
    bounds = np.frombuffer(offsets, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[bounds[0] : bounds[-1]], bounds - bounds[0])


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of whole rows with at most ``limit`` bytes of text, or one row that is longer."""
    for batch in batches:
        bounds = texts_of(batch.column(column)).bounds
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            part = batch.slice(begin, end - begin)
            yield part, texts_of(part.column(column))
            begin = end


def words_of(texts: Texts, fold_case: bool = False, cuts: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes other than space and ``\\x09-\\x0D``, never across two texts.

    ``cuts`` marks the bytes (and the end) before which a run ends besides.
    """
    data = _FOLD[texts.data] if fold_case else texts.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(texts.bounds), np.int64))
    ink = ~_WHITE[data]
    cut = np.zeros(len(data) + 1, dtype=bool) if cuts is None else cuts.copy()
    cut[texts.bounds] = True
    opens, closes = ink.copy(), ink.copy()
    opens[1:] &= ~ink[:-1] | cut[1:-1]
    closes[:-1] &= ~ink[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, texts.bounds))


def spans_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings of disjoint ascending spans, as an Arrow array."""
    if not len(starts):
        return pa.array([], pa.large_binary())
    offsets = np.empty(2 * len(starts), np.int64)
    offsets[0::2], offsets[1::2] = starts, ends
    both = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))],
    )
    return both.take(pa.array(np.arange(0, len(offsets), 2)))


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact ids of equal values, and the value of each id."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs ``starts[i], starts[i] + 1, ...`` of the given lengths, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i, empty segments included."""
    return np.diff(offsets_of(values)[bounds])


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the published splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, pa.Array) else pa.array(c, type=f.type)
        for c, f in zip(columns, schema, strict=True)
    ]
    return pa.RecordBatch.from_arrays(
        [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema, strict=True)],
        schema=schema,
    )
