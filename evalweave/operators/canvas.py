"""Evolving token canvases: one row per denoising step of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.vectors import changed_positions, mask_positions
from evalweave.operators.ordered import chunk_of, scan_in_order
from evalweave.operators.tokens import detokenize


def _starts() -> Column:
    return (F.col("step_index") == 0).cast("int")


def canvas_index(steps: DataFrame, chunk: Column | None = None) -> DataFrame:
    """A new canvas starts at every ``step_index`` 0; steps before the first one have index -1."""
    chunk = chunk_of("global_step") if chunk is None else chunk
    counted = scan_in_order(
        steps, ["run_id"], ["global_step"], chunk, running={"_starts": ("sum", _starts())}
    )
    return counted.withColumn("canvas_index", (F.col("_starts") - 1).cast("int")).drop("_starts")


def canvas_changes(steps: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Adds canvas index, changed positions and accepted positions, with one shuffle on the run.

    The canvas before the first step of a canvas is forgotten. That makes the previous canvas of a
    step simply the run's previous row unless ``step_index`` is 0.
    """
    chunk = chunk_of("global_step") if chunk is None else chunk
    looked = scan_in_order(
        steps,
        ["run_id"],
        ["global_step"],
        chunk,
        running={"_starts": ("sum", _starts())},
        previous={"_before": "canvas"},
    )
    previous = F.when(F.col("step_index") != 0, F.col("_before"))
    return looked.withColumns(
        {
            "canvas_index": (F.col("_starts") - 1).cast("int"),
            "changed_positions": changed_positions(F.col("canvas"), previous),
            "accepted_positions": mask_positions(F.col("accepted_index")),
        }
    ).drop("_starts", "_before")


def canvas_steps(steps: DataFrame, vocab: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Full canvas step records with the decoded canvas text."""
    changed = canvas_changes(steps, chunk)
    keys = ["run_id", "global_step"]
    text = detokenize(steps, keys, "canvas", vocab).select(
        *keys, F.col("raw_response").alias("canvas_text")
    )
    return changed.join(text, keys, "left").select(
        "run_id",
        "canvas_index",
        "global_step",
        "step_index",
        F.col("canvas").alias("canvas_token_ids"),
        "canvas_text",
        F.col("sampled_tokens").alias("sampled_token_ids"),
        "changed_positions",
        "accepted_positions",
    )


def attach_traces(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """Steps with the scheduler trace of the same step; a step without one keeps nulls."""
    keys = ["run_id", "global_step"]
    marked = traces.withColumn("has_trace", F.lit(True))
    return steps.join(marked, keys, "left").withColumn(
        "has_trace", F.coalesce("has_trace", F.lit(False))
    )
