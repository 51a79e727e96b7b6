"""Summaries of vocabulary score vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions.vectors import LOGIT_FIELDS, logit_columns, map_columns, masked
from evalweave.operators.skew import lookup_join


def _summarized(df: DataFrame, scores: str, selected: str, top_k: int, keep: Sequence[str]) -> DataFrame:
    return map_columns(
        df, keep, [scores, selected], LOGIT_FIELDS, lambda s, chosen: logit_columns(s, chosen, top_k)
    )


def token_logits(df: DataFrame, top_k: int = 5) -> DataFrame:
    """One summary per generated token; top-k probabilities are over the whole vocabulary."""
    return _summarized(
        df, "scores", "selected_token_id", top_k, ["run_id", "token_step", "selected_token_id"]
    )


def canvas_logits(df: DataFrame, top_k: int = 5) -> DataFrame:
    """One summary per (step, position) of a canvas. Narrow: nothing is shuffled."""
    keep = [
        "run_id",
        "global_step",
        "step_index",
        "position",
        "sampled_token_id",
        "sampled_prob",
        "accepted",
    ]
    return _summarized(df, "logits", "sampled_token_id", top_k, keep)


def canvas_logit_records(positions: DataFrame) -> DataFrame:
    """Per-position summaries back to one record per step, for readers that want lists.

    A group is one canvas, whose length the model fixes.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                "position",
                "top_k_token_ids",
                "top_k_probabilities",
                "entropy",
                "sampled_token_id",
                "sampled_prob",
                "accepted",
            )
        )
    )
    steps = positions.groupBy("run_id", "global_step", "step_index").agg(ordered.alias("_p"))
    return steps.select(
        "run_id",
        "global_step",
        "step_index",
        F.col("_p.top_k_token_ids").alias("top_k_token_ids"),
        F.col("_p.top_k_probabilities").alias("top_k_probabilities"),
        F.col("_p.entropy").alias("entropy_per_position"),
        F.col("_p.sampled_token_id").alias("sampled_token_ids"),
        F.col("_p.sampled_prob").alias("sampled_token_probabilities"),
        masked(F.col("_p.sampled_prob"), F.col("_p.accepted")).alias("accepted_token_probabilities"),
    )


def score_count_mismatch(scores: DataFrame, generated: DataFrame) -> DataFrame:
    """Runs whose number of score rows differs from their number of generated tokens."""
    rows = scores.groupBy("run_id").agg(F.count(F.lit(1)).alias("score_rows"))
    tokens = generated.groupBy("run_id").agg(F.sum(F.size("final_token_ids")).alias("token_count"))
    both = rows.join(tokens, "run_id", "full_outer").na.fill(0, ["score_rows", "token_count"])
    return both.filter(F.col("score_rows") != F.col("token_count"))


def matched_scores(scores: DataFrame, mismatched: DataFrame) -> DataFrame:
    """Score rows of the runs that reconcile, for readers that go on without the others."""
    return lookup_join(scores, mismatched.select("run_id"), ["run_id"], "left_anti")


def require_matched_scores(scores: DataFrame, generated: DataFrame) -> DataFrame:
    """``scores`` if every run has a row per generated token; raises before any row is summarised."""
    wrong = score_count_mismatch(scores, generated).orderBy("run_id").first()
    if wrong is not None:
        raise ValueError(
            f"run {wrong['run_id']}: {wrong['score_rows']} score rows for {wrong['token_count']} tokens"
        )
    return scores
