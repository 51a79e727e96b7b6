"""The same telemetry as Structured Streaming jobs with keyed state.

Steps of a run must arrive in order across micro-batches; inside one they are sorted here. A step
that comes late is an error, as nothing after it could be right.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evalweave.session import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"


def _positions(marked: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Per list of a flat run of lists, the places of its marked cells."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(row)) - (np.cumsum(lengths) - lengths)[row]
    ends = np.cumsum(np.bincount(row[marked], minlength=len(lengths))).tolist()
    flat = place[marked].tolist()
    return [flat[low:high] for low, high in itertools.pairwise([0, *ends])]


def _changed(cells: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Places of every canvas that differ from the canvas before it; all where one starts, as the first must.

    A place that only one of the two has differs.
    """
    offset = np.cumsum(lengths) - lengths
    past = np.where(starts, 0, np.roll(lengths, 1))
    widths = np.maximum(lengths, past)
    row = np.repeat(np.arange(len(widths)), widths)
    place = np.arange(len(row)) - (np.cumsum(widths) - widths)[row]
    both = (place < lengths[row]) & (place < past[row])
    at = row[both]
    marked = ~both
    marked[both] = cells[offset[at] + place[both]] != cells[offset[at - 1] + place[both]]
    return _positions(marked, widths)


def _flat(lists: list, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all lists, one after the other, and the length of each list. A null is one more number."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    cells = np.concatenate([np.empty(0, kind), *map(np.asarray, lists)])
    if cells.dtype.kind == "f":
        cells = np.where(np.isnan(cells), np.iinfo(np.int64).min, cells)
    return cells.astype(kind), lengths


#: Runs are dealt by hash to this many groups, which Python is called for one at a time. A stream's state is
#: kept by them, so a checkpoint goes with its number.
RUN_GROUPS = 1024
#: The runs of a group: name, number of the canvas, step and length of the last canvas, and all their cells.
CANVAS_STATE = (
    "runs array<string>, canvas_indexes array<int>, global_steps array<int>, sizes array<int>, cells array<bigint>"
)
CANVAS_CHANGES = (
    "run_id string, global_step int, step_index int, canvas_index int, "
    "changed_positions array<int>, accepted_positions array<int>"
)


def canvas_changes_of_runs(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Keeps, per run of a group, the canvas before and the number of the current canvas.

    What is held of a run stands as one more row before its steps, so that all runs are worked out at once.
    """
    names, indexes, last, sizes, cells = state.get if state.exists else ([], [], [], [], [])
    held = len(names)
    steps = pd.concat(list(frames), ignore_index=True)
    own = steps["run_id"].astype(object)
    names = np.array([*names, *own.where(own.notna(), None)], dtype=object)
    run = pd.factorize(names, use_na_sentinel=False)[0]
    fresh = np.arange(len(run)) >= held
    step = np.append(np.asarray(last, np.int64), steps["global_step"].to_numpy(np.int64))
    step_index = np.append(np.ones(held, np.int64), steps["step_index"].to_numpy(np.int64))
    started = np.append(np.asarray(indexes, np.int64) + 1, step_index[held:] == 0)
    order = np.lexsort((step, fresh, run))
    names, run, fresh, step, step_index, started = (x[order] for x in (names, run, fresh, step, step_index, started))

    first = np.append(True, run[1:] != run[:-1])
    late = np.flatnonzero(~first & fresh & np.append(True, ~fresh[:-1]) & (step <= np.roll(step, 1)))
    if len(late):
        at = late[0]
        raise ValueError(f"run {names[at]}: step {step[at]} came after step {step[at - 1]}")

    before = np.cumsum(started) - started
    numbers = np.cumsum(started) - np.maximum.accumulate(np.where(first, before, 0)) - 1

    past = np.split(np.asarray(cells, np.int64), np.cumsum(sizes)[:-1]) if held else []
    canvases = [*past, *steps["canvas"]]
    cells, lengths = _flat([canvases[n] for n in order.tolist()], np.int64)
    changed = _changed(cells, lengths, first | (step_index == 0))

    end = np.append(first[1:], True)
    kept = (names, numbers, step, lengths)
    state.update((*[x[end].tolist() for x in kept], cells[np.repeat(end, lengths)].tolist()))
    accepted = steps["accepted_index"].tolist()
    yield pd.DataFrame(
        {
            "run_id": names[fresh],
            "global_step": step[fresh],
            "step_index": step_index[fresh],
            "canvas_index": numbers[fresh],
            "changed_positions": [changed[n] for n in np.flatnonzero(fresh).tolist()],
            "accepted_positions": _positions(*_flat([accepted[n - held] for n in order[fresh].tolist()], np.bool_)),
        }
    )


def canvas_changes_of_run(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """The same for steps of one run, whose name is the key."""
    return canvas_changes_of_runs(key, (f.assign(run_id=key[0]) for f in frames), state)


@contextmanager
def drained(spark: SparkSession) -> Iterator[None]:
    """Settings of streams that start inside and stop when their input is read; the session's own come back.

    State is kept in RocksDB, off the heap. Batches without data are off: with timers of processing time
    there is always another one, and a stream that is to end would not.
    """
    wanted = {PROVIDER_CONF: ROCKSDB, NO_DATA_CONF: "false"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def canvas_changes_stream(steps: DataFrame, groups: int = RUN_GROUPS) -> DataFrame:
    """Canvas index, changed and accepted positions of every step, by groups of runs.

    Calling Python for one run takes several milliseconds whatever the run holds, so runs share the calls.
    A group's rows of a micro-batch lie in one task's memory.
    """
    group = F.pmod(F.xxhash64("run_id"), F.lit(groups)).cast("int")
    return steps.withColumn("_group", group).groupBy("_group").applyInPandasWithState(
        canvas_changes_of_runs, CANVAS_CHANGES, CANVAS_STATE, "append", GroupStateTimeout.NoTimeout
    )


def first_rows_stream(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key over the whole stream: of the first micro-batch that has the key; null is a key too.

    The state holds every key ever seen, one small record each, in RocksDB when run by ``run_to_files``.
    ``streaming.ledger`` tells the rows that are dropped here, with state in files.
    """
    return rows.dropDuplicates(keys)


def read_folder(
    spark: SparkSession, path: str, schema: T.StructType, *, file_format: str = "parquet", files_per_batch: int = 1000
) -> DataFrame:
    return (
        spark.readStream.format(file_format)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )


def run_to_files(stream: DataFrame, label: str, sink: str | None = None) -> DataFrame:
    """Drain what is there into an exactly-once file sink and return the sink as a table."""
    spark = stream.sparkSession
    sink = sink or shared_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", f"{sink}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
    )
    with drained(spark):
        query = writer.start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)
