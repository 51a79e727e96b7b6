"""Reductions of score vectors.

vectors of a few hundred entries at most and for masks; and Arrow-batched NumPy kernels for the
wide ones, where an interpreted lambda per element costs about eight times as much.

A lambda body is evaluated once per element, so whatever it shares over the elements (a maximum,
a normaliser) is bound first with ``bind``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tolerance of "this row already sums to one", and the floor inside a logarithm.
SUM_TOLERANCE = 2e-3
LOG_FLOOR = 1e-12
_BLOCK_VALUES = 4_000_000


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside nested lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logsumexp(scores: Column) -> Column:
    return bind(
        F.array_max(scores).cast("double"),
        lambda top: top
        + F.log(
            F.aggregate(
                scores, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top)
            )
        ),
    )


def softmax(scores: Column) -> Column:
    return bind(
        logsumexp(scores),
        lambda norm: F.transform(scores, lambda v: F.exp(v.cast("double") - norm)),
    )


def entropy(scores: Column) -> Column:
    """Entropy of softmax(scores) in nats; a score of -inf adds nothing."""
    return bind(
        logsumexp(scores),
        lambda norm: F.aggregate(
            scores,
            F.lit(0.0),
            lambda acc, v: acc
            - F.when(
                v.cast("double") != float("-inf"),
                F.exp(v.cast("double") - norm) * (v.cast("double") - norm),
            ).otherwise(F.lit(0.0)),
        ),
    )


def topk(values: Column, k: int) -> Column:
    """The k largest entries as ``array<struct<index,value>>``; ties go to the lower index.

    Only entries that reach the k-th largest value are ever turned into structs.
    """
    kth = F.coalesce(F.get(F.sort_array(values, asc=False), F.lit(k - 1)), F.array_min(values))
    return bind(
        kth,
        lambda floor: F.transform(
            F.slice(
                F.array_sort(
                    F.filter(
                        F.transform(
                            values,
                            lambda v, i: F.when(
                                v >= floor, F.struct((-v).alias("neg"), i.alias("index"))
                            ),
                        ),
                        lambda s: s.isNotNull(),
                    )
                ),
                1,
                k,
            ),
            lambda s: F.struct(s["index"].alias("index"), (-s["neg"]).alias("value")),
        ),
    )


def percentile(values: Column, q: float) -> Column:
    """Percentile of an array's entries with linear interpolation."""

    def between(ordered: Column, rank: Column) -> Column:
        low = F.get(ordered, F.floor(rank).cast("int"))
        high = F.get(ordered, F.ceil(rank).cast("int"))
        return low + (high - low) * (rank - F.floor(rank))

    return bind(
        F.sort_array(values),
        lambda ordered: bind(F.lit(q) * (F.size(ordered) - 1), lambda rank: between(ordered, rank)),
    )


def mask_positions(mask: Column) -> Column:
    return F.filter(
        F.transform(mask, lambda flag, i: F.when(flag, i)), lambda i: i.isNotNull()
    )


def masked(values: Column, mask: Column) -> Column:
    """The entries whose mask is true, in order."""
    return F.transform(
        F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda z: z["m"]),
        lambda z: z["v"],
    )


def changed_positions(current: Column, previous: Column) -> Column:
    """Positions that differ from ``previous``; every position when there is no previous."""
    everywhere = F.transform(current, lambda _, i: i)
    differing = mask_positions(F.zip_with(current, previous, lambda a, b: ~a.eqNullSafe(b)))
    return F.when(previous.isNull(), everywhere).otherwise(differing)


def _blocks(column: pa.Array):
    """(rows, 2-D float64 block) pairs of equal-width rows, each of a bounded size."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    widths = np.diff(offsets)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        step = max(1, _BLOCK_VALUES // max(1, int(width)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            if part[-1] - part[0] == len(part) - 1:
                block = flat[offsets[part[0]] : offsets[part[-1] + 1]].reshape(len(part), width)
            else:
                block = flat[offsets[part][:, None] + np.arange(width)[None, :]]
            yield part, block.astype(np.float64)


def _ranked(block: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the k largest entries per row, ties to the lower column; NaN ranks first."""
    width = block.shape[1]
    block = np.where(np.isnan(block), np.inf, block)
    if k >= width:
        return np.argsort(-block, axis=1, kind="stable")[:, :k]
    floor = np.partition(block, width - k, axis=1)[:, width - k][:, None]
    # Entries above the floor always belong; equal ones fill up from the left.
    above = block > floor
    room = k - above.sum(axis=1, keepdims=True)
    equal = block == floor
    keep = above | (equal & (np.cumsum(equal, axis=1) <= room))
    columns = np.nonzero(keep)[1].reshape(len(block), k)
    order = np.argsort(-np.take_along_axis(block, columns, axis=1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, axis=1)


def _lists(parts: list[tuple[np.ndarray, np.ndarray]], count: int, kind: pa.DataType) -> pa.Array:
    """A list array of ``count`` rows from (rows, matrix) parts."""
    lengths = np.zeros(count, np.int32)
    for rows, matrix in parts:
        lengths[rows] = matrix.shape[1]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    flat = np.empty(offsets[-1], kind.to_pandas_dtype())
    for rows, matrix in parts:
        flat[offsets[rows][:, None] + np.arange(matrix.shape[1])[None, :]] = matrix
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


LOGIT_FIELDS = (
    "selected_token_probability double, top_k_token_ids array<int>, "
    "top_k_probabilities array<double>, entropy double"
)


def logit_columns(scores: pa.Array, selected: pa.Array, k: int) -> list[pa.Array]:
    """Columns of LOGIT_FIELDS; probabilities are over the whole score vector."""
    count = len(scores)
    chosen, entropies = np.full(count, np.nan), np.full(count, np.nan)
    ids, probabilities = [], []
    if selected.null_count:
        raise ValueError("a score row has no selected token")
    wanted = selected.to_numpy(zero_copy_only=False)
    for rows, block in _blocks(scores):
        if block.shape[1] == 0:
            raise ValueError("a score row holds no values")
        if wanted[rows].min() < 0 or wanted[rows].max() >= block.shape[1]:
            raise ValueError("a selected token lies outside its score row")
        shifted = block - block.max(axis=1, keepdims=True)
        log_p = shifted - np.log(np.exp(shifted).sum(axis=1, keepdims=True))
        p = np.exp(log_p)
        entropies[rows] = -np.where(p > 0, p * np.where(p > 0, log_p, 0.0), 0.0).sum(axis=1)
        chosen[rows] = p[np.arange(len(rows)), wanted[rows].astype(np.int64)]
        best = _ranked(block, min(k, block.shape[1]))
        ids.append((rows, best))
        probabilities.append((rows, np.take_along_axis(p, best, axis=1)))
    return [
        pa.array(chosen),
        _lists(ids, count, pa.int32()),
        _lists(probabilities, count, pa.float64()),
        pa.array(entropies),
    ]


ROUTE_FIELDS = (
    "experts int, expert_ids array<int>, looks_normalized boolean, entropy_kept double, "
    "entropy_softmax double, margin_kept double, margin_softmax double"
)


def route_columns(scores: pa.Array, selected: int) -> list[pa.Array]:
    """Columns of ROUTE_FIELDS: top experts, and entropy and margin under both normalisations.

    Whether scores are kept or soft-maxed is decided per event, over all its tokens. Working both
    out here makes that a plain aggregate afterwards instead of a second pass joined back.
    """
    count = len(scores)
    experts = np.zeros(count, np.int32)
    ids = []
    normal = np.zeros(count, bool)
    entropies = {"kept": np.full(count, np.nan), "soft": np.full(count, np.nan)}
    margins = {"kept": np.full(count, np.nan), "soft": np.full(count, np.nan)}
    for rows, block in _blocks(scores):
        width = block.shape[1]
        if width == 0:
            raise ValueError("a router row holds no scores")
        k = min(selected, width)
        experts[rows] = width
        with np.errstate(invalid="ignore"):
            normal[rows] = (block.min(axis=1) >= 0) & (
                np.abs(block.sum(axis=1) - 1.0) <= SUM_TOLERANCE
            )
        raised = np.exp(block - block.max(axis=1, keepdims=True))
        best = _ranked(block, k)
        ids.append((rows, best))
        for reading, p in (("kept", block), ("soft", raised / raised.sum(axis=1, keepdims=True))):
            entropies[reading][rows] = -(np.log(np.maximum(p, LOG_FLOOR)) * p).sum(axis=1)
            lead = np.take_along_axis(p, best[:, :2], axis=1)
            margins[reading][rows] = lead[:, 0] - lead[:, 1] if k > 1 else lead[:, 0]
    return [
        pa.array(experts),
        _lists(ids, count, pa.int32()),
        pa.array(normal),
        *(pa.array(values[reading]) for values in (entropies, margins) for reading in ("kept", "soft")),
    ]


def map_columns(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[str],
    fields: str,
    kernel: Callable[..., list[pa.Array]],
) -> DataFrame:
    """``keep`` columns plus the kernel's columns over ``inputs``, one Arrow batch at a time.

    A map over batches rather than a scalar UDF: it takes its input as finished columns, where the
    optimizer may push a lambda expression into a UDF's arguments and then fail to find the UDF
    again. Nothing but ``keep`` and ``inputs`` crosses to Python.
    """
    names = list(keep)
    used = df.select(*names, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([used.schema[c] for c in names] + added.fields)
    output = [*names, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel(*[batch.column(f"_in{i}") for i in range(len(inputs))])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], output)

    return used.mapInArrow(run, schema)
