"""Any user-supplied predictor as a distributed batch job."""

from __future__ import annotations

import gc
import traceback
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evalweave.operators.workers import lean


@dataclass(frozen=True)
class Prediction:
    text: str
    token_ids: Sequence[int]
    input_token_count: int = 0
    raw_text: str | None = None
    error: str | None = None


class Predictor(Protocol):
    def __call__(self, prompts: list[str], seeds: list[int]) -> list[Prediction]: ...


RESULT_FIELDS = [
    T.StructField("input_token_count", T.LongType()),
    T.StructField("final_text", T.StringType()),
    T.StructField("final_token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("raw_response", T.StringType()),
    T.StructField("response_error", T.StringType()),
]

#: Rows whose prompts and results are Python objects at a time.
ROWS_HELD = 256

#: The engine this Python worker holds: at most one, under the token of the call it was built for.
_HELD: dict[str, Any] = {}


def _predictor(token: str, factory: Callable[[], Predictor]) -> Predictor:
    """The engine of one ``batch_infer`` call, built once per worker; any other engine goes before."""
    if token not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[token] = factory()
    return _HELD[token]


def batch_infer(
    runs: DataFrame,
    factory: Callable[[], Predictor],
    *,
    name: str,
    batch_size: int = 1,
    prompt: str = "prompt",
    seed: str = "seed",
    tasks: int | None = None,
) -> DataFrame:
    """``runs`` plus the predictor's results. One narrow stage: rows stay where they are.

    ``factory`` builds the engine once per Python worker. Results are attached to their own row, so
    nothing depends on a global order; a predictor that returns too few results fails the task. Text,
    raw text and error of a row are passed on as the predictor gives them; without an error, a raw
    text that is not given is the text. A worker holds one engine at a time, and never one of another call.
    ``tasks`` spreads the rows evenly first, for an engine that is slow next to reading. Only prompts and
    seeds of at most ``ROWS_HELD`` rows (or one batch) are Python objects at a time.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be greater than zero")
    if tasks is not None:
        runs = runs.repartition(tasks, "run_id")
    schema = T.StructType(runs.schema.fields + RESULT_FIELDS)
    token = f"{name}-{uuid.uuid4().hex}"

    held = max(ROWS_HELD // batch_size, 1) * batch_size

    @lean
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _predictor(token, factory)
        for batch in batches:
            for begin in range(0, batch.num_rows, held):
                rows = batch.slice(begin, held)
                results: list[Prediction] = []
                for start in range(0, rows.num_rows, batch_size):
                    part = rows.slice(start, batch_size)
                    made = engine(part.column(prompt).to_pylist(), [int(s) for s in part.column(seed).to_pylist()])
                    if len(made) != part.num_rows:
                        raise ValueError(f"{len(made)} results for {part.num_rows} prompts")
                    results.extend(made)
                yield pa.RecordBatch.from_arrays([*rows.columns, *_columns(results)], schema.names)

    return runs.mapInArrow(predict, schema)


def _columns(results: list[Prediction]) -> list[pa.Array]:
    return [
        pa.array([int(r.input_token_count) for r in results], pa.int64()),
        pa.array([r.text for r in results], pa.string()),
        pa.array([list(map(int, r.token_ids)) for r in results], pa.list_(pa.int32())),
        pa.array([_raw(r) for r in results], pa.string()),
        pa.array([r.error for r in results], pa.string()),
    ]


def _raw(result: Prediction) -> str | None:
    """The raw text as given; where none is given, the text of a result without error."""
    return result.text if result.raw_text is None and not result.error else result.raw_text


ERROR_SCHEMA = (
    "model_name string, model_kind string, error_type string, message string, traceback string, "
    "failed_at string"
)


class RunFailed(RuntimeError):
    """Some models of a run failed; the others completed, with so many rows each."""

    def __init__(self, failed: Sequence[str], completed: dict[str, int]):
        super().__init__(f"failed for: {', '.join(failed)}")
        self.failed, self.completed = list(failed), completed


def failure_row(spark: SparkSession, model: str, kind: str, error: Exception) -> DataFrame:
    """What is kept of a model whose job broke: one row of ``ERROR_SCHEMA``."""
    whole = "".join(traceback.format_exception(error))
    stamp = datetime.now(UTC).isoformat()
    return spark.createDataFrame(
        [(model, kind, type(error).__name__, str(error), whole, stamp)], ERROR_SCHEMA
    )
