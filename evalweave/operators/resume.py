"""Inference that goes on where it was stopped: each run's result is there once, however often it is tried."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from evalweave.operators.inference import Predictor, batch_infer
from evalweave.session import stage


def _outputs(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/outputs")
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def infer_batch(
    runs: DataFrame, batch: int, factory: Callable[[], Predictor], path: str, *, name: str, batch_size: int = 1
) -> None:
    """The runs of one micro-batch that no other batch has results of; replaces an earlier try of this batch.

    Results are looked up by ``run_id`` alone, so a lost checkpoint, or a manifest that is given once more
    in other files, makes nothing twice.
    """
    done = _outputs(runs.sparkSession, path)
    todo = runs.dropDuplicates(["run_id"])
    if done is not None:
        others = done.filter(done["batch"] != batch).select("run_id")
        todo = todo.join(others, "run_id", "left_anti").select(*runs.columns)
    # Stored, as the engines must not see rows change while a failed task is tried again.
    made = batch_infer(stage(todo, "runs-to-do"), factory, name=name, batch_size=batch_size)
    made.write.mode("overwrite").parquet(f"{path}/outputs/batch={batch}")


def resumable_infer(
    stream: DataFrame, factory: Callable[[], Predictor], path: str, *, name: str, batch_size: int = 1
) -> DataFrame:
    """Drains a stream of runs through an engine and returns all results.

    A micro-batch is what a stop can cost: each writes its results below its own number before the
    stream's checkpoint moves on. Called again with the same path, the job goes on behind the last
    batch that was finished.
    """

    def step(rows: DataFrame, batch: int) -> None:
        infer_batch(rows, batch, factory, path, name=name, batch_size=batch_size)

    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = _outputs(stream.sparkSession, path)
    if found is None:
        raise ValueError("the stream held no runs")
    return found.drop("batch")
