"""A whole experiment: manifest, one inference job per model, records, audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.text import DIFFUSION_MARK, render_single_turn
from evalweave.operators import audit, inference, runs
from evalweave.operators.dataset import (
    ManifestSpec,
    build_manifest,
    describe_manifest,
    first_batches,
    manifest_facts,
)
from evalweave.schemas import OUTPUT_SCHEMA
from evalweave.session import stage
from evalweave.sources import jsonl, tables

DEFAULT_TEMPLATE = "<user>\n{prompt}\n<model>\n"


@dataclass(frozen=True)
class Experiment:
    """What a finished run left behind."""

    root: str
    experiment_id: str
    examples: int
    completed: dict[str, int]


def trial_specs(
    data: ManifestSpec, run: runs.RunSpec, rows: int = 10
) -> tuple[ManifestSpec, runs.RunSpec]:
    """The same job over its first rows, unshuffled and without a batch cap."""
    if rows < 1:
        raise ValueError("a trial needs at least one row")
    return replace(data, max_samples=rows, shuffle=False), replace(run, max_batches=None)


def run_model(
    spark: SparkSession, answered: Callable[[], DataFrame], home: str, model: str, kind: str
) -> int | None:
    """Write a model's records below ``home`` and count them; null if it failed, its error written instead."""
    folder = model_folder(home, model)
    try:
        return jsonl.write_json(runs.output_records(answered()), f"{folder}/outputs", keep_nulls=False)
    except Exception as error:  # noqa: BLE001 - any failure of one model leaves the others running
        jsonl.write_json(inference.failure_row(spark, model, kind, error), f"{folder}/error")
        return None


def model_folder(root: str, model: str) -> str:
    return f"{root}/{model.rsplit('/', 1)[-1]}"


def run_experiment(
    spark: SparkSession,
    examples: DataFrame,
    data: ManifestSpec,
    run: runs.RunSpec,
    engines: Mapping[str, Callable[[], inference.Predictor]],
    root: str,
    *,
    revisions: dict[str, str] | None = None,
    resolved_revision: str | None = None,
    sampling: runs.Sampling | None = None,
    template: str = DEFAULT_TEMPLATE,
) -> Experiment:
    """Freeze the manifest, run every model over it, write records; raise if any model failed.

    ``<root>/<experiment>/`` receives inputs, dataset, manifest and one folder per model with its
    outputs or its error record. The inputs are checked in the shared scratch folder and published only
    when they are valid, so a refused dataset leaves the run's folder free for another try. Models run one after another, so two engines are never loaded
    on one executor at a time.
    """
    experiment = tables.experiment_id(run.experiment_id)
    folders = [model_folder("", m) for m in run.models]
    if len(set(folders)) < len(folders):
        raise ValueError("two models share the last part of their name and would share a folder")
    home = f"{root.rstrip('/')}/{experiment}"
    inputs = f"{home}/inputs"
    tables.require_unused(spark, home)
    checked = build_manifest(examples, data)
    tables.claim_run_folder(spark, home, experiment)
    manifest = stage(checked, "inputs", inputs)
    facts = manifest_facts(manifest)
    count = facts["examples"]
    dataset = describe_manifest(data, facts, inputs, resolved_revision or data.revision)
    jsonl.write_document(spark, f"{home}/dataset", dataset)
    config = {k: str(v) for k, v in {**asdict(data), **asdict(run)}.items()}
    jsonl.write_document(
        spark,
        f"{home}/manifest",
        tables.experiment_manifest(experiment, dataset, revisions or {}, config),
    )

    chosen = first_batches(manifest, run.batch_size, run.max_batches)
    rows = runs.run_matrix(chosen, run, revisions)
    generation = F.lit((sampling or runs.Sampling()).recorded())

    def answered(model: str) -> DataFrame:
        asked = rows.filter(F.col("model_id") == model).withColumns(
            {
                "rendered_prompt": render_single_turn(F.col("prompt"), template),
                "generation_configuration": generation,
            }
        )
        return inference.batch_infer(
            asked,
            engines[model],
            name=f"{experiment}/{model}",
            batch_size=run.batch_size,
            prompt="rendered_prompt",
        )

    kinds = {
        m: run.diffusion_label if DIFFUSION_MARK in m.lower() else run.default_label for m in run.models
    }
    written = {m: run_model(spark, partial(answered, m), home, m, kind) for m, kind in kinds.items()}
    completed = {m: n for m, n in written.items() if n is not None}
    if len(completed) < len(written):
        raise inference.RunFailed([m for m in written if m not in completed], completed)
    return Experiment(home, experiment, count, completed)


def read_outputs(spark: SparkSession, experiment: Experiment) -> DataFrame:
    paths = [f"{model_folder(experiment.root, m)}/outputs" for m in experiment.completed]
    return spark.read.schema(OUTPUT_SCHEMA).json(paths)


def shortfalls(
    spark: SparkSession, experiment: Experiment, models: Sequence[str], rows: int
) -> DataFrame:
    """Parts of a run that hold too few or too many records: (path, expected, actual).

    The records are counted by the folder their files lie in; a folder that is not there has a null.
    """
    outputs = [(f"{model_folder('', m)[1:]}/outputs", rows) for m in models]
    parts = [("inputs", rows), ("dataset", 1), ("manifest", 1), *outputs]
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.json")
    lines = files.text(experiment.root).select(
        audit.folder_below(F.col("_metadata.file_path"), experiment.root).alias("path")
    )
    inputs = spark.read.parquet(f"{experiment.root}/inputs").select(F.lit("inputs").alias("path"))
    expected = spark.createDataFrame(parts, "path string, expected bigint")
    return audit.count_mismatches(lines.unionByName(inputs), expected, "path")


def require_complete(spark: SparkSession, experiment: Experiment, run: runs.RunSpec, rows: int) -> None:
    """Raise unless every part of the run holds all its records."""
    wrong = shortfalls(spark, experiment, run.models, rows).orderBy("path").collect()
    if wrong:
        found = "; ".join(f"{r['path']} has {r['actual'] or 0} of {r['expected']}" for r in wrong)
        raise RuntimeError(f"incomplete run: {found}")
