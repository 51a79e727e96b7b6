"""The streaming counterparts: each drains a staged folder in several micro-batches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.operators import routing
from evalweave.operators.ordered import chunk_of
from evalweave.plans import fixtures as fx
from evalweave.plans import sql as q
from evalweave.plans.registry import ORACLES, query
from evalweave.plans.telemetry_queries import EVENT, LANE, came_steps, canvas_passes, denoising_lanes, r6
from evalweave.session import shared_path, stage
from evalweave.streaming import keyed, ledger, stateful


def _arriving(rows: DataFrame, label: str, key: str, order: str, *cuts: int, files: int = 2) -> str:
    """A stored table written again in waves of ``files``: later steps of a run arrive in later files."""
    path = shared_path(rows.sparkSession, label)
    at = F.col(order)
    for low, high in zip((None, *cuts), (*cuts, None), strict=True):
        wave = F.lit(True) if low is None else at >= low
        wave = wave if high is None else wave & (at < high)
        rows.filter(wave).repartition(files, key).write.mode("append").parquet(path)
    return path


def _files_of_a_wave(spark: SparkSession, path: str, waves: int) -> int:
    """How many files a micro-batch has to take for as many micro-batches as waves, however many files were written.

    It may take some of the next wave's: what a wave has of a key lies in one file.
    """
    return max(1, math.ceil(len(spark.read.parquet(path).inputFiles()) / waves))


@query(
    "canvas_changes_stream",
    f"""WITH {q.CANVASES} SELECT run_id, global_step, step_index, canvas_index,
      {q.ints('changed_positions')} AS changed_positions, {q.ints('accepted_positions')} AS accepted_positions
    FROM changed""",
)
def canvas_changes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = fx.steps(spark, sf_dir, "run_id", "global_step", "step_index", "canvas", "accepted_index")
    path = _arriving(steps, "steps", "run_id", "global_step", 30, files=max(2, spark.sparkContext.defaultParallelism))
    arriving = stateful.read_folder(spark, path, steps.schema, files_per_batch=_files_of_a_wave(spark, path, 2))
    done = stateful.run_to_files(stateful.canvas_changes_stream(arriving), "canvas-changes")
    return done.withColumns(
        {c: F.array_join(c, ",") for c in ("changed_positions", "accepted_positions")}
    )


@query(
    "route_change_stream",
    f"""WITH {q.CHANGES} SELECT run_id, canvas_index, layer_index, step, event_order,
      round(change_rate, 6) + 0.0 AS expert_set_change_rate FROM rates""",
)
def route_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fx.router_scores(spark, sf_dir)
    tokens = routing.stored_route_tokens(scores, [*EVENT, "step_index", "token_index"])
    routes = denoising_lanes(tokens, canvas_passes(tokens)).select(
        *LANE, F.col("step").alias("global_step"), "event_order", "token_index", "expert_ids"
    )
    path = _arriving(stage(routes, "routes"), "routes", "run_id", "global_step", 2)
    arriving = stateful.read_folder(spark, path, routes.schema, files_per_batch=2)
    overlap = stateful.run_to_files(keyed.route_overlap_stream(arriving), "route-overlap")
    rates = routing.change_rates(
        overlap, LANE, ["global_step", "event_order"], chunk_of("global_step")
    )
    return rates.withColumnRenamed("global_step", "step").withColumn(
        "expert_set_change_rate", r6(F.col("expert_set_change_rate"))
    )


@query(
    "append_stream",
    f"WITH {q.STEPS} SELECT run_id, global_step, {q.ints('sampled_tokens')} AS sampled_tokens FROM steps",
)
def append_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step records arriving as JSON files, appended exactly once."""
    steps = fx.steps(spark, sf_dir).select("run_id", "global_step", "sampled_tokens")
    path = shared_path(spark, "step-lines")
    steps.repartition(4, "run_id").write.json(path)
    arriving = stateful.read_folder(
        spark, path, steps.schema, file_format="json", files_per_batch=2
    )
    done = stateful.run_to_files(arriving, "steps-appended")
    return done.withColumn("sampled_tokens", F.array_join("sampled_tokens", ","))


@query(
    "distinct_ids_stream",
    f"WITH {q.DIRTY} SELECT DISTINCT id FROM dirty",
)
def distinct_ids_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of every id over several micro-batches; rejects are ``manifest_violations``."""
    rows = stage(fx.dirty_examples(spark, sf_dir).select("id", "position"), "ids")
    path = shared_path(spark, "id-files")
    rows.repartition(4, "position").write.parquet(path)
    arriving = stateful.read_folder(spark, path, rows.schema, files_per_batch=2)
    return stateful.run_to_files(stateful.first_rows_stream(arriving, ["id"]), "first-ids").select("id")


@query("breaker_stream", ORACLES["breaker_keep_rows"])
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuit breaker while rows arrive: components go off in the place they fail."""
    status = stage(fx.component_status(spark, sf_dir), "status")
    path = _arriving(status, "status", "model_run", "ord", 200, 2000, 20_000)
    arriving = stateful.read_folder(spark, path, status.schema, files_per_batch=2)
    return stateful.run_to_files(keyed.breaker_stream(arriving), "breaker")


@query("pending_events_stream", ORACLES["unflushed_router_events"])
def pending_events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router events, the callbacks of their steps and the ends of the runs, as they arrive."""
    scores = fx.router_scores(spark, sf_dir)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("event_order", "int"), ("module_name", "string"))]
    happened = scores.select(*EVENT).distinct().withColumn("kind", F.lit("event"))
    came = came_steps(scores).select("run_id", "step", *nothing, F.lit("step").alias("kind"))
    ends = scores.select("run_id", F.lit(9).alias("step"), *nothing, F.lit("end").alias("kind")).distinct()
    rows = stage(happened.unionByName(came).unionByName(ends), "router-rows")
    path = _arriving(rows, "router-rows", "run_id", "step", 2, 9)
    arriving = stateful.read_folder(spark, path, rows.schema, files_per_batch=2)
    return stateful.run_to_files(keyed.pending_events_stream(arriving), "pending-events").select(*EVENT)


@query(
    "id_ledger_stream",
    f"""WITH {q.DIRTY}, placed AS (SELECT id, position AS place, min(position) OVER (PARTITION BY id) AS first_place
      FROM dirty WHERE id <> '') SELECT id, place, first_place FROM placed WHERE place <> first_place""",
)
def id_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated ids over several micro-batches, each with its own place and that of the first row."""
    rows = stage(fx.dirty_examples(spark, sf_dir).select("id", F.col("position").alias("place")), "ids")
    path = _arriving(rows, "id-rows", "place", "place", 100, 300, 303)
    arriving = stateful.read_folder(spark, path, rows.schema, files_per_batch=2)
    return ledger.rejects(spark, ledger.run_ledger(arriving))
