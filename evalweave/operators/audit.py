"""Checks over finished runs, and the per-component circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators.skew import lookup_join

# The telemetry components, and the files a finished run must have.
COMPONENTS = ("canvas", "logits", "moe")
RUN_FILES = ("manifest.json", "dataset.json", "inputs.jsonl")
MODEL_FILE = "outputs.jsonl"


def count_mismatches(outputs: DataFrame, expected: DataFrame, model: str = "model_id") -> DataFrame:
    """Models whose number of outputs differs from ``expected``; a missing model has a null actual."""
    actual = outputs.groupBy(model).agg(F.count(F.lit(1)).alias("actual"))
    both = expected.select(model, F.col("expected").cast("bigint").alias("expected")).join(
        actual, model, "left"
    )
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def expected_artifacts(runs: DataFrame, run: str, subdir: str) -> DataFrame:
    """(run, path) pairs every finished run must have: three run files, one file per model."""
    run_files = runs.select(run).distinct().select(
        run, F.explode(F.array(*[F.lit(f) for f in RUN_FILES])).alias("path")
    )
    model_files = runs.select(run, subdir).distinct().select(
        run, F.concat(F.col(subdir), F.lit(f"/{MODEL_FILE}")).alias("path")
    )
    return run_files.unionByName(model_files)


def missing_artifacts(expected: DataFrame, present: DataFrame, run: str) -> DataFrame:
    return expected.join(present.select(run, "path"), [run, "path"], "left_anti")


def used_folders(requested: DataFrame, present: DataFrame, folder: str) -> DataFrame:
    """Requested folders, and whether any file lies below them; a run may only take an unused one."""
    taken = present.select(F.split("path", "/")[0].alias(folder)).distinct()
    marked = taken.withColumn("used", F.lit(True))
    return requested.select(folder).distinct().join(marked, folder, "left").na.fill(False, ["used"])


def folder_below(path: Column, root: str) -> Column:
    """The folder of a file, relative to ``root``."""
    relative = F.regexp_replace(path, "^.*" + _escaped(root.rstrip("/")) + "/", "")
    return F.regexp_replace(relative, "/[^/]*$", "")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """Paths below ``root``, relative to it; the file contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*" + _escaped(root.rstrip("/")) + "/", "")
    return files.select(relative.alias("path"))


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in text)


def first_failures(status: DataFrame, run: str, order: str) -> DataFrame:
    """Per run and component the first failing position.

    A failure of a component named in COMPONENTS stops that component; one of anything else (the
    callback input, the scheduler trace) stops all of them.
    """
    own = F.col("component").isin(*COMPONENTS)
    hit = F.when(own, F.array("component")).otherwise(F.array(*[F.lit(c) for c in COMPONENTS]))
    return (
        status.filter("failed")
        .select(run, F.col(order).alias("_at"), F.explode(hit).alias("component"))
        .groupBy(run, "component")
        .agg(F.min("_at").alias("first_failure"))
    )


def rows_before_failure(
    status: DataFrame, run: str, order: str, rows: DataFrame | None = None
) -> DataFrame:
    """Telemetry rows that were written: those before their component's first failure.

    ``rows`` is any telemetry with the run, component and order columns; by default ``status``
    itself. A minimum joined back rather than a window: the scope is a whole model run, which one
    task could not hold.
    """
    rows = status if rows is None else rows
    rows = rows.filter(F.col("component").isin(*COMPONENTS))
    marked = lookup_join(
        rows, first_failures(status, run, order), [run, "component"]
    )
    return marked.filter(
        F.col("first_failure").isNull() | (F.col(order) < F.col("first_failure"))
    ).drop("first_failure")
