"""Whitening components of whole-number vectors by shifted CholeskyQR over distributed rows.

The fit list X holds every distinct vector once, centred on its exact mean. One pass over its rows sums
the Gram matrix of Q = X T for a triangular T that starts as the identity. The Cholesky factor R of that
Gram matrix, shifted by a multiple of the rounding unit while Q is far from orthogonal, is applied by a
triangular solve on the next pass (T becomes ``T R**-1``), and the factors are composed to one R with
X = Q R. Some passes make Q orthogonal to rounding; directions in which X has no variance stay zero. What
is left of the last Gram matrix is taken into R by its symmetric root, and the SVD of R gives the
principal directions and variances of X, without the squared condition number of the covariance itself.

Only sums of a fixed size (width squared) ever reach the driver. Sums of whole numbers are exact.

Defined results: a vector that is null, empty or holds a null takes no part, nor does one of another
width than most have (ties: the wider); there are as many components as directions with variance,
``most`` at most, so a fit list of one vector, or an empty table, gives no rows; repeated rows are
whitened each. Widths above some thousands need their Gram matrix to fit a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.llm.batches import lean
from evalweave.session import stage

#: Rows that a task turns into doubles at a time.
HELD = 2048
ROUNDING = float(np.finfo(float).eps)
#: Passes after which an orthogonalisation that does not settle is an error.
MOST_PASSES = 12


@dataclass(frozen=True)
class Whitening:
    """Exact ``rows`` and column ``sums`` of the fit list; ``components`` are unit rows by falling ``variances``."""

    rows: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.rows, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances)[:, None]).T

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sums over a row of ``(rows * x - sums) ** 2``, exact."""
        gap = scaled_gap(x, self.rows, self.sums)
        largest = int(np.abs(gap).max(initial=0))
        if largest * largest * x.shape[1] >= 2**63:
            raise ValueError("a squared deviation does not fit a long")
        return (gap * gap).sum(axis=1)


def scaled_gap(x: np.ndarray, rows: int, sums: np.ndarray) -> np.ndarray:
    if int(np.abs(x).max(initial=0)) * rows >= 2**62:
        raise ValueError("rows times an entry does not fit a long")
    return x * np.int64(rows) - sums


def centred(x: np.ndarray, rows: int, sums: np.ndarray) -> np.ndarray:
    """Deviations from the mean: whole numbers to the last step, so no digits of large entries are lost."""
    return scaled_gap(x, rows, sums) / rows


def matrices(column: pa.Array) -> Iterator[np.ndarray]:
    """Equally long lists as whole-number rows, a bounded number at a time."""
    for at in range(0, len(column), HELD):
        part = column.slice(at, HELD)
        yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def summed(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum of ``kernel(rows)``, ``size`` numbers, over all rows; every task adds up its own rows first."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for batch in batches:
            for x in matrices(batch.column(0)):
                total += kernel(x).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["sums"])

    parts = df.select("x").mapInArrow(run, f"sums array<{kind}>")
    whole = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    found = whole.orderBy("at").toArrow()
    return found.column("v").to_numpy()


def cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with ``R.T R`` = ``gram`` + ``shift``, the shift raised till there is one."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, ROUNDING * float(np.trace(gram)))


def solved(factors: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """``rows R1**-1 R2**-1 ...`` by triangular solves, one column after another."""
    for r in factors:
        out = np.array(rows.T)
        for j in range(len(r)):
            out[j] -= r[:j, j] @ out[:j]
            out[j] /= r[j, j]
        rows = out.T
    return rows


def triangular_factor(fit: DataFrame, rows: int, sums: np.ndarray) -> np.ndarray:
    """R with X = Q R, Q's columns orthonormal or (where X has no variance) zero, X the centred fit list."""
    width = len(sums)
    factors: list[np.ndarray] = []
    for _ in range(MOST_PASSES):

        def gram_of(x: np.ndarray, factors: tuple[np.ndarray, ...] = tuple(factors)) -> np.ndarray:
            q = solved(list(factors), centred(x, rows, sums))
            return q.T @ q

        gram = summed(fit, gram_of, width * width, "double").reshape(width, width)
        gram = (gram + gram.T) / 2
        values, vectors = np.linalg.eigh(gram)
        most = float(values[-1])
        if most <= 0:
            return np.zeros((width, width))
        # Either a direction is orthonormal by now, or nothing but rounding is left of it.
        settled = (np.abs(values - 1) <= 1e-8) | (np.abs(values) <= 1e-8)
        if factors and settled.all():
            root = np.sqrt(np.where(values > 0.5, values, 0))[:, None] * vectors.T
            for r in reversed(factors):
                root = root @ r
            return root
        # The first passes are shifted (11 (mn + n(n + 1)) u |X|^2 is the published bound), later ones only if singular.
        clear = values[0] > width * ROUNDING * 1e3 * most
        bound = 11 * (rows * width + width * (width + 1)) * ROUNDING * most
        factors.append(cholesky(gram, 0.0 if clear else min(bound, 1e-3 * most)))
    raise ValueError("the rows did not become orthogonal")


def train(df: DataFrame, vector: str, most: int = 16) -> tuple[DataFrame, Whitening | None]:
    """The stored vectors (all columns, ``vector`` as longs) that take part, and their whitening."""
    x = F.col(f"`{vector}`").cast("array<bigint>")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull())
    stored = stage(df.filter(whole).withColumn(vector, x), "whitening-rows")
    common = stored.groupBy(F.size(f"`{vector}`").alias("width")).count()
    width = common.orderBy(F.desc("count"), F.desc("width")).first()
    if width is None:
        return stored, None
    stored = stored.filter(F.size(f"`{vector}`") == width["width"])
    fit = stage(stored.select(F.col(f"`{vector}`").alias("x")).distinct(), "whitening-fit")
    rows = fit.count()
    sums = summed(fit, lambda x: x.sum(axis=0), width["width"], "long")
    r = triangular_factor(fit, rows, sums)
    singular, components = np.linalg.svd(r)[1:]
    variances = singular**2 / rows
    total = float(variances.sum())
    there = singular > singular[0] * 1e-10 * len(singular)
    count = min(most, int(there.sum()))
    return stored, Whitening(rows, sums, components[:count], variances[:count], total) if count else None


def identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    count = len(model.variances)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return w.T @ w / model.rows

    fit = df.select(F.col(f"`{vector}`").alias("x")).distinct()
    found = summed(fit, covariance, count * count, "double").reshape(count, count)
    return float(np.abs(found - np.eye(count)).max())


ADDED = [
    T.StructField("component", T.IntegerType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
]


def with_components(df: DataFrame, key: str, vector: str, model: Whitening | None) -> DataFrame:
    """``key, component, deviation, whitened, explained``: one row per vector and component, from 1."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *ADDED])
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        count = len(own.variances)
        for batch in batches:
            at = 0
            for x in matrices(batch.column(1)):
                row = np.repeat(np.arange(len(x)), count)
                columns = [
                    batch.column(0).slice(at, len(x)).take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(own.deviation(x)[row]),
                    pa.array(own.whitened(x).ravel()),
                    pa.array(np.tile(own.variances / own.total, len(x))),
                ]
                at += len(x)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("x")).mapInArrow(run, schema)
