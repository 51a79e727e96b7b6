"""Examples x models: run rows, output records and their pairing."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions.text import example_seed, model_kind
from evalweave.operators.skew import lookup_join
from evalweave.schemas import CONTEXT_COLUMNS, OUTPUT_SCHEMA, SCHEMA_VERSION


@dataclass(frozen=True)
class Sampling:
    """Generation settings as a user states them."""

    max_new_tokens: int = 256
    enable_thinking: bool = True
    do_sample: bool = True
    temperature: float = 1.0
    top_p: float = 0.95
    top_k: int = 64

    def __post_init__(self) -> None:
        if min(self.max_new_tokens, self.temperature, self.top_p, self.top_k) <= 0:
            raise ValueError("sampling values must be greater than zero")
        if self.top_p > 1:
            raise ValueError("top_p must not exceed one")

    def recorded(self) -> str:
        """As written to output records: the sampling values are null when decoding is greedy."""
        on = self.do_sample
        return json.dumps(
            {
                "max_new_tokens": self.max_new_tokens,
                "enable_thinking": self.enable_thinking,
                "do_sample": on,
                "temperature": self.temperature if on else None,
                "top_p": self.top_p if on else None,
                "top_k": self.top_k if on else None,
            }
        )


@dataclass(frozen=True)
class RunSpec:
    """One experiment: which models see the manifest, and from which base seed."""

    experiment_id: str
    models: Sequence[str]
    batch_size: int = 1
    max_batches: int | None = 1
    log_seed: int = 42
    top_k: int = 5
    selected_experts: int = 8
    log_tokens: bool = False
    log_logits: bool = False
    log_moe: bool = False
    log_canvas: bool = False
    diffusion_label: str = "diffusion"
    default_label: str = "autoregressive"

    def __post_init__(self) -> None:
        if not self.models:
            raise ValueError("at least one model is needed")
        if self.batch_size <= 0 or (self.max_batches is not None and self.max_batches <= 0):
            raise ValueError("batch_size and max_batches must be greater than zero")
        object.__setattr__(self, "models", tuple(dict.fromkeys(self.models)))


def recorded_sampling(df: DataFrame) -> DataFrame:
    """Per run configuration: what is recorded, and what a greedy engine is given instead."""
    on = F.col("do_sample")
    recorded = {c: F.when(on, F.col(c)) for c in ("temperature", "top_p", "top_k")}
    engine = {"temperature": 0.0, "top_p": 1.0, "top_k": -1}
    return df.withColumns(
        {f"recorded_{c}": value for c, value in recorded.items()}
        | {f"engine_{c}": F.when(on, F.col(c)).otherwise(F.lit(off)) for c, off in engine.items()}
    )


def dedupe_first_seen(df: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct names with the position of their first appearance."""
    return df.groupBy(name).agg(F.min(position).alias(position))


def unknown_names(requested: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Distinct requested names that are not known; both sides are reduced before the join."""
    return requested.select(name).distinct().join(known.select(name).distinct(), name, "left_anti")


def run_key(experiment_id: Column, model_id: Column, example_id: Column) -> Column:
    """A run id that a retry cannot change."""
    joined = F.concat(experiment_id, F.lit(":"), model_id, F.lit(":"), example_id)
    return F.substring(F.sha2(joined, 256), 1, 32)


def run_matrix(manifest: DataFrame, spec: RunSpec, revisions: dict[str, str] | None = None) -> DataFrame:
    """One row per (example, model): the context columns plus prompt and reference response.

    The models are a literal list, so each manifest row is expanded where it lies.
    """
    revisions = revisions or {}
    models = F.array(
        *[
            F.struct(F.lit(m).alias("model_id"), F.lit(revisions.get(m)).cast("string").alias("model_revision"))
            for m in spec.models
        ]
    )
    rows = manifest.withColumn("_m", F.explode(models))
    model = F.col("_m.model_id")
    text = {
        c: F.coalesce(F.col(c), F.lit(""))
        for c in ("source", "language", "prompt_label", "response_label", "violated_categories", "tag")
    }
    context = {
        "schema_version": F.lit(SCHEMA_VERSION),
        "experiment_id": F.lit(spec.experiment_id),
        "model_kind": model_kind(model, diffusion=spec.diffusion_label, default=spec.default_label),
        "model_id": model,
        "model_revision": F.col("_m.model_revision"),
        "run_id": run_key(F.lit(spec.experiment_id), model, F.col("id")),
        "example_id": F.coalesce(F.col("id"), F.lit("")),
        "row_index": F.col("row_index"),
        "prompt_sha256": F.coalesce(F.col("prompt_sha256"), F.lit("")),
        **text,
        "seed": example_seed(spec.log_seed, F.col("id")),
    }
    return rows.select(
        *[context[c].alias(c) for c in CONTEXT_COLUMNS],
        "prompt",
        F.col("response").alias("reference_response"),
    )


def pin_revisions(runs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Fill ``model_revision`` from a (model_id, revision) table; a model key is always hot."""
    found = lookup_join(
        runs, revisions.select("model_id", "revision"), ["model_id"]
    )
    return found.withColumn("model_revision", F.col("revision")).drop("revision")


def with_context(events: DataFrame, runs: DataFrame, event: str) -> DataFrame:
    """Telemetry rows as records: the event's name, all context columns of the run, the row's own.

    A run may hold any share of the rows. A row whose run is not known keeps its ``run_id`` and has
    no other context, so that no telemetry is lost.
    """
    others = [c for c in events.columns if c not in CONTEXT_COLUMNS]
    joined = lookup_join(events.select("run_id", *others), runs.select(*CONTEXT_COLUMNS), ["run_id"])
    return joined.select(F.lit(event).alias("event"), *CONTEXT_COLUMNS, *others)


PAIR_KEYS = ("experiment_id", "model_id", "example_id")


def pair_outputs(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """Results with their contexts, by key and never by position."""
    return contexts.join(results, list(PAIR_KEYS))


def unpaired(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """Contexts without a result and results without a context."""
    left = contexts.select(*PAIR_KEYS, F.lit(True).alias("_c"))
    right = results.select(*PAIR_KEYS, F.lit(True).alias("_r"))
    both = left.join(right, list(PAIR_KEYS), "full_outer")
    return both.filter(F.col("_c").isNull() | F.col("_r").isNull()).select(
        *PAIR_KEYS,
        F.when(F.col("_r").isNull(), F.lit("result")).otherwise(F.lit("context")).alias("missing"),
    )


def output_records(df: DataFrame) -> DataFrame:
    """Final records in the declared schema from run rows joined with their results."""
    derived = {
        "event": F.lit("final_output"),
        "output_token_count": F.size("final_token_ids"),
        "response": F.col("final_text"),
    }
    columns = []
    for entry in OUTPUT_SCHEMA:
        if entry.name in derived:
            value = derived[entry.name]
        elif entry.name in df.columns:
            value = F.col(entry.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(entry.dataType).alias(entry.name))
    return df.select(*columns)


def drop_prompt(ids: Column, input_tokens: Column) -> Column:
    """Generated ids of a decoder: everything after the prompt."""
    return F.slice(ids, input_tokens + 1, F.greatest(F.size(ids) - input_tokens, F.lit(0)))


def drop_prompt_if_longer(ids: Column, input_tokens: Column, generated: Column) -> Column:
    """Generated ids of a canvas: the prompt is there only if the sequence is too long for it."""
    return F.when(F.size(ids) > generated, drop_prompt(ids, input_tokens)).otherwise(ids)


def final_text(texts: Column, decoded: Column) -> Column:
    return F.coalesce(F.get(texts, F.lit(0)), decoded, F.lit(""))


def joined_errors(*errors: Column) -> Column:
    return F.nullif(F.concat_ws("; ", *errors), F.lit(""))


def render_conversation(
    turns: DataFrame, key: str, order: str, role: str, text: str, generation_prompt: str = "<model>\n"
) -> DataFrame:
    """One prompt text per conversation, its turns in order, closed by the generation prompt.

    The text is one value, so a conversation can never be larger than a value may be.
    """
    turn = F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))
    rendered = F.transform(
        F.array_sort(F.collect_list(turn)),
        lambda x: F.concat(F.lit("<"), x["r"], F.lit(">\n"), x["t"], F.lit("\n")),
    )
    return turns.groupBy(key).agg(
        F.concat(F.array_join(rendered, ""), F.lit(generation_prompt)).alias("rendered_prompt")
    )


def outputs_per_model(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("outputs"),
        F.sum("input_token_count").alias("input_tokens"),
        F.sum("output_token_count").alias("output_tokens"),
        F.count("response_error").alias("with_error"),
    )
