"""Queries over telemetry: logits, expert routing, canvases, the circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import text as tx
from evalweave.functions.vectors import logsumexp, mask_positions, masked, topk
from evalweave.operators import audit, canvas, logits, routing, runs
from evalweave.operators.ordered import chunk_of
from evalweave.plans import fixtures as fx
from evalweave.plans import sql as q
from evalweave.plans.registry import query
from evalweave.session import shared_path, stage
from evalweave.sources import tables

EVENT = ["run_id", "step", "event_order", "module_name"]
ORDER = ["step", "event_order"]
LANE = ["run_id", "canvas_index", "layer_index"]


def r6(value: Column) -> Column:
    return F.round(value, 6) + F.lit(0.0)


def _join(column: str) -> Column:
    return F.array_join(column, ",")


def _millionths(values: Column | str) -> Column:
    """A list of fractions as text, in whole millionths, which every engine writes alike."""
    return F.array_join(F.transform(values, lambda v: F.round(v * 1e6).cast("bigint").cast("string")), ",")


def _millionths_sql(value: str) -> str:
    return f"CAST(CAST(round({value} * 1e6) AS BIGINT) AS VARCHAR)"


# --- logits -------------------------------------------------------------------------------------


@query(
    "vector_topk",
    """WITH cells AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i
      FROM embeddings), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS rk FROM cells)
    SELECT vec_id, CAST(rk AS INTEGER) AS rank, CAST(i AS INTEGER) AS entry, CAST(v AS DOUBLE) AS value
    FROM ranked WHERE rk <= 5""",
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = topk(F.col("embedding"), 5)
    return fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(best).alias("at", "b")
    ).select(
        "vec_id",
        (F.col("at") + 1).alias("rank"),
        F.col("b.index").alias("entry"),
        F.col("b.value").cast("double").alias("value"),
    )


@query("logsumexp", f"WITH {q.SCORES} SELECT vec_id, round(lse, 6) + 0.0 AS lse FROM lse")
def logsumexps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", r6(logsumexp(F.col("embedding"))).alias("lse")
    )


@query(
    "ar_logit_summary",
    f"""WITH {q.SCORES}, ranked AS (SELECT c.*, c.v - l.lse AS lp, exp(c.v - l.lse) AS p,
        row_number() OVER (PARTITION BY c.vec_id ORDER BY c.v DESC, c.i) AS rk
      FROM cells c JOIN lse l ON c.vec_id = l.vec_id)
    SELECT run_id, token_step, selected_token_id,
      round(sum(CASE WHEN i = selected_token_id THEN p ELSE 0 END), 6) AS selected_token_probability,
      string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_k_token_ids,
      round(sum(CASE WHEN rk = 1 THEN p ELSE 0 END), 6) AS top_probability,
      round(sum(CASE WHEN rk <= 5 THEN p ELSE 0 END), 6) AS top_k_mass,
      round(-sum(p * lp), 6) + 0.0 AS entropy
    FROM ranked GROUP BY run_id, token_step, selected_token_id""",
)
def ar_logit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.aggregate("top_k_probabilities", F.lit(0.0), lambda a, p: a + p)
    return logits.token_logits(fx.token_scores(spark, sf_dir)).select(
        "run_id",
        "token_step",
        "selected_token_id",
        F.round("selected_token_probability", 6).alias("selected_token_probability"),
        _join("top_k_token_ids").alias("top_k_token_ids"),
        F.round(F.get("top_k_probabilities", F.lit(0)), 6).alias("top_probability"),
        F.round(mass, 6).alias("top_k_mass"),
        r6(F.col("entropy")).alias("entropy"),
    )


@query(
    "ar_logit_records",
    f"""WITH {q.SCORES}, ranked AS (SELECT c.*, c.v - l.lse AS lp, exp(c.v - l.lse) AS p,
        row_number() OVER (PARTITION BY c.vec_id ORDER BY c.v DESC, c.i) AS rk
      FROM cells c JOIN lse l ON c.vec_id = l.vec_id),
    measured AS (SELECT run_id, token_step, selected_token_id,
      round(sum(CASE WHEN i = selected_token_id THEN p ELSE 0 END), 6) AS selected_token_probability,
      string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_k_token_ids,
      string_agg({_millionths_sql('p')}, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_k_probabilities,
      round(-sum(p * lp), 6) + 0.0 AS entropy
    FROM ranked GROUP BY run_id, token_step, selected_token_id), {q.contexts('scores', fx.MODELS[0])}
    SELECT 'logits_step' AS event, * FROM measured JOIN contexts USING (run_id)""",
)
def ar_logit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of runs whose scores match their tokens, with the context of its run."""
    scores = stage(fx.token_scores(spark, sf_dir), "token-scores")
    made = scores.select("run_id", F.array("selected_token_id").alias("final_token_ids"))
    summaries = logits.token_logits(logits.require_matched_scores(scores, made))
    contexts = fx.contexts(spark, sf_dir, scores, fx.MODELS[0])
    return runs.with_context(summaries, contexts, "logits_step").withColumns(
        {
            "selected_token_probability": F.round("selected_token_probability", 6),
            "top_k_token_ids": _join("top_k_token_ids"),
            "top_k_probabilities": _millionths("top_k_probabilities"),
            "entropy": r6(F.col("entropy")),
        }
    )


@query(
    "canvas_logit_summary",
    f"""WITH {q.CANVAS_SCORES}, measured AS (SELECT vec_id,
        string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS top_k_token_ids,
        round(sum(CASE WHEN rk <= 5 THEN p ELSE 0 END), 6) AS top_k_mass, round(-sum(p * lp), 6) + 0.0 AS entropy,
        CAST(max(CASE WHEN rk = 1 THEN i END) AS INTEGER) AS sampled_token_id,
        round(max(CASE WHEN rk = 1 THEN p END), 6) AS selected_token_probability,
        round(max(CASE WHEN rk = 1 THEN v END), 6) AS sampled_prob FROM ranked GROUP BY vec_id)
    SELECT run_id, global_step, step_index, position, accepted, top_k_token_ids, top_k_mass, entropy,
      sampled_token_id, selected_token_probability, sampled_prob
    FROM canvas JOIN measured USING (vec_id)""",
)
def canvas_logit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = F.aggregate("top_k_probabilities", F.lit(0.0), lambda a, p: a + p)
    return logits.canvas_logits(fx.canvas_scores(spark, sf_dir)).select(
        "run_id",
        "global_step",
        "step_index",
        "position",
        "accepted",
        _join("top_k_token_ids").alias("top_k_token_ids"),
        F.round(mass, 6).alias("top_k_mass"),
        r6(F.col("entropy")).alias("entropy"),
        "sampled_token_id",
        F.round("selected_token_probability", 6).alias("selected_token_probability"),
        F.round("sampled_prob", 6).alias("sampled_prob"),
    )


@query(
    "canvas_logit_records",
    f"""WITH {q.CANVAS_SCORES}, best AS (SELECT vec_id, i, v FROM ranked WHERE rk = 1), heads AS (SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS ids,
        string_agg({_millionths_sql('p')}, ',' ORDER BY rk) FILTER (WHERE rk <= 5) AS probs, -sum(p * lp) AS entropy
      FROM ranked GROUP BY vec_id),
    lists AS (SELECT run_id, global_step, step_index,
      string_agg(h.ids, ';' ORDER BY position) AS top_k_token_ids,
      string_agg(h.probs, ';' ORDER BY position) AS top_k_probabilities,
      string_agg({_millionths_sql('h.entropy')}, ',' ORDER BY position) AS entropy_per_position,
      string_agg(CAST(i AS VARCHAR), ',' ORDER BY position) AS sampled_token_ids,
      string_agg({_millionths_sql('v')}, ',' ORDER BY position) AS sampled_token_probabilities,
      coalesce(string_agg({_millionths_sql('v')}, ',' ORDER BY position) FILTER (WHERE accepted), '')
        AS accepted_token_probabilities
      FROM canvas JOIN best USING (vec_id) JOIN heads h USING (vec_id) GROUP BY run_id, global_step, step_index),
    indexed AS (SELECT *, CAST(sum(CASE WHEN step_index = 0 THEN 1 ELSE 0 END)
      OVER (PARTITION BY run_id ORDER BY global_step) - 1 AS INTEGER) AS canvas_index FROM lists),
    {q.contexts('canvas', fx.MODELS[1])}
    SELECT 'logits_step' AS event, * FROM indexed JOIN contexts USING (run_id)""",
)
def canvas_logit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = logits.canvas_logit_records(logits.canvas_logits(fx.canvas_scores(spark, sf_dir)))
    steps = stage(steps, "logit-steps")
    contexts = fx.contexts(spark, sf_dir, steps, fx.MODELS[1])
    records = runs.with_context(canvas.canvas_index(steps), contexts, "logits_step")
    ids = F.transform("top_k_token_ids", lambda x: F.array_join(x, ","))
    return records.withColumns(
        {
            "top_k_token_ids": F.array_join(ids, ";"),
            "top_k_probabilities": F.array_join(F.transform("top_k_probabilities", _millionths), ";"),
            "sampled_token_ids": _join("sampled_token_ids"),
            **{
                c: _millionths(c)
                for c in (
                    "entropy_per_position",
                    "sampled_token_probabilities",
                    "accepted_token_probabilities",
                )
            },
        }
    )


@query(
    "score_count_mismatch",
    """SELECT CAST(label AS VARCHAR) AS run_id, count(*) AS score_rows,
      count(*) FILTER (WHERE vec_id % 200 <> 199) AS token_count
    FROM embeddings GROUP BY label HAVING count(*) <> count(*) FILTER (WHERE vec_id % 200 <> 199)""",
)
def score_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "embeddings").withColumn("run_id", F.col("label").cast("string"))
    made = rows.select(
        "run_id",
        F.when(F.col("vec_id") % 200 == 199, F.array().cast("array<bigint>"))
        .otherwise(F.array("vec_id"))
        .alias("final_token_ids"),
    )
    return logits.score_count_mismatch(rows, made)


@query(
    "full_logits_key",
    f"""WITH {q.SCORES}, lists AS (SELECT vec_id, count(*) AS n, string_agg({_millionths_sql('v')}, ',' ORDER BY i) AS scores
      FROM cells GROUP BY vec_id)
    SELECT run_id, token_step, run_id || '/token-' || printf('%04d', token_step) AS full_logits_key,
      CAST(n AS INTEGER) AS scores_kept, l.scores FROM scores JOIN lists l USING (vec_id)""",
)
def full_logits_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "full-logits")
    tables.write_full_logits(tables.with_logit_keys(fx.token_scores(spark, sf_dir)), path, buckets=8)
    return spark.read.parquet(path).select(
        "run_id",
        "token_step",
        "full_logits_key",
        F.size("scores").alias("scores_kept"),
        _millionths(F.transform("scores", lambda v: v.cast("double"))).alias("scores"),
    )


# --- expert routing -----------------------------------------------------------------------------


@query(
    "router_layer",
    f"WITH {q.ROUTER} SELECT vec_id, layer_index FROM router",
)
def router_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.router_scores(spark, sf_dir).filter(tx.is_router(F.col("module_name")))
    return rows.select(
        "vec_id", tx.router_layer(F.col("module_name"), strict=True).alias("layer_index")
    )


@query(
    "router_phase",
    f"""WITH {q.ROUTER} SELECT vec_id, CASE WHEN contains(module_name, '.encoder.') THEN 'encoder_prefill'
      ELSE 'denoising' END AS phase FROM router WHERE vec_id % 11 <> 0""",
)
def router_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase of every router; other modules of the model have none and are left out."""
    other = F.regexp_replace("module_name", "router$", "mlp")
    modules = fx.router_scores(spark, sf_dir).withColumn(
        "module_name", F.when(F.col("vec_id") % 11 == 0, other).otherwise(F.col("module_name"))
    )
    return modules.filter(tx.is_router(F.col("module_name"))).select(
        "vec_id", tx.canvas_router_phase(F.col("module_name")).alias("phase")
    )


_NUMBERED = """passes AS (SELECT DISTINCT run_id, step, event_order FROM router),
    forwards AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, event_order) - 1 AS forward_index
      FROM passes)"""
_FORWARDS = f"{q.ROUTER}, {_NUMBERED}"


@query("forward_index", f"WITH {_FORWARDS} SELECT run_id, step, event_order, forward_index FROM forwards")
def forward_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.forward_index(fx.router_scores(spark, sf_dir), "run_id", ORDER, chunk_of("step"))


def _phase_columns(df: DataFrame) -> DataFrame:
    index = F.col("forward_index")
    return df.withColumns(
        {
            "phase": tx.decode_phase(index),
            "input_generated_token_step": F.when(index > 0, index - 1),
            "predicted_token_step": index,
        }
    )


_PHASES = """forward_index, CASE WHEN forward_index = 0 THEN 'prefill' ELSE 'autoregressive_decode' END AS phase,
      CASE WHEN forward_index > 0 THEN forward_index - 1 END AS input_generated_token_step,
      forward_index AS predicted_token_step"""


@query("ar_router_phase", f"WITH {_FORWARDS} SELECT run_id, step, event_order, {_PHASES} FROM forwards")
def ar_router_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phase_columns(forward_index(spark, sf_dir))


def _route_tokens(spark: SparkSession, sf_dir: str, source=fx.router_scores) -> DataFrame:
    return routing.route_tokens(source(spark, sf_dir), [*EVENT, "token_index"])


def _stored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.stored_route_tokens(
        fx.router_scores(spark, sf_dir), [*EVENT, "step_index", "token_index"]
    )


@query(
    "router_normalize_decision",
    f"""WITH {q.ROUTER} SELECT {q.EVENT}, count(*) AS tokens_routed, count(*) FILTER (WHERE vec_id % 64 = 13) = 0 AS kept
    FROM router GROUP BY {q.EVENT}""",
)
def router_normalize_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.normalization(_route_tokens(spark, sf_dir, fx.normalized_router_scores), EVENT)


@query("expert_counts", f"WITH {q.ROUTED} SELECT {q.EVENT}, expert_id, n AS token_count FROM bins")
def expert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = routing.expert_counts(_route_tokens(spark, sf_dir), EVENT)
    return routing.expert_bins(counted, EVENT).drop("load_fraction")


@query(
    "expert_load",
    f"WITH {q.ROUTED} SELECT {q.EVENT}, expert_id, round(load, 6) AS load_fraction FROM bins",
)
def expert_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = routing.expert_counts(_route_tokens(spark, sf_dir), EVENT)
    return routing.expert_bins(counted, EVENT).select(
        *EVENT, "expert_id", F.round("load_fraction", 6).alias("load_fraction")
    )


@query(
    "most_used_experts",
    f"""WITH {q.ROUTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {q.EVENT}
        ORDER BY load DESC, expert_id) AS place FROM bins)
    SELECT {q.EVENT}, CAST(place AS INTEGER) AS place, expert_id, round(load, 6) AS load_fraction
    FROM ranked WHERE place <= 8""",
)
def most_used_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = routing.busiest_experts(routing.expert_counts(_route_tokens(spark, sf_dir), EVENT))
    return counted.select(*EVENT, F.posexplode("most_used_experts").alias("at", "m")).select(
        *EVENT,
        (F.col("at") + 1).alias("place"),
        F.col("m.expert_id").alias("expert_id"),
        F.round("m.load_fraction", 6).alias("load_fraction"),
    )


def _summary_columns() -> list[Column]:
    busiest = F.transform(
        "most_used_experts",
        lambda m: F.concat_ws(
            ":",
            m["expert_id"].cast("string"),
            F.round(m["load_fraction"] * 1e6).cast("bigint").cast("string"),
        ),
    )
    return [
        F.col("tokens_routed"),
        F.col("routed_expert_count"),
        F.col("selected_experts_per_token"),
        F.col("shared_expert_active"),
        _join("expert_token_counts").alias("expert_token_counts"),
        _millionths("expert_load_fraction").alias("expert_load_fraction"),
        *[
            r6(F.col(c)).alias(c)
            for c in (
                "router_entropy_mean",
                "router_entropy_p95",
                "top1_router_margin_mean",
                "expert_load_cv",
            )
        ],
        F.array_join(busiest, ",").alias("most_used_experts"),
    ]


_SUMMARY = f"""{q.ROUTED}, summary AS (
      SELECT m.run_id, m.step, m.event_order, m.module_name, m.tokens_routed, 64 AS routed_expert_count,
        8 AS selected_experts_per_token, true AS shared_expert_active, b.expert_token_counts, b.expert_load_fraction,
        round(m.entropy_mean, 6) + 0.0 AS router_entropy_mean, round(m.entropy_p95, 6) + 0.0 AS router_entropy_p95,
        round(m.margin_mean, 6) + 0.0 AS top1_router_margin_mean, round(v.cv, 6) + 0.0 AS expert_load_cv,
        b.most_used_experts
      FROM event_measures m JOIN variation v USING ({q.EVENT}) JOIN (
        SELECT {q.EVENT}, string_agg(CAST(n AS VARCHAR), ',' ORDER BY expert_id) AS expert_token_counts,
          string_agg({_millionths_sql('load')}, ',' ORDER BY expert_id) AS expert_load_fraction,
          string_agg(expert_id || ':' || {_millionths_sql('load')}, ',' ORDER BY place) FILTER (WHERE place <= 8)
            AS most_used_experts
        FROM (SELECT *, row_number() OVER (PARTITION BY {q.EVENT} ORDER BY n DESC, expert_id) AS place FROM bins)
        GROUP BY {q.EVENT}) b
        USING ({q.EVENT}))"""


@query("router_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def router_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = routing.summarize(_stored_tokens(spark, sf_dir), EVENT)
    return summary.select(*EVENT, *_summary_columns())


_LAYER = "CAST(regexp_extract(module_name, 'layers\\.([0-9]+)\\.router$', 1) AS INTEGER) AS layer_index"


@query(
    "ar_router_events",
    f"""WITH {_SUMMARY}, {_NUMBERED}, {q.contexts('router', fx.MODELS[0])}
    SELECT 'moe_route' AS event, {_PHASES}, {_LAYER}, s.* EXCLUDE (module_name), c.* EXCLUDE (run_id)
    FROM summary s JOIN forwards USING (run_id, step, event_order) JOIN contexts c USING (run_id)""",
)
def ar_router_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _stored_tokens(spark, sf_dir)
    forwards = routing.forward_index(tokens, "run_id", ORDER, chunk_of("step"))
    events = routing.summarize(tokens, EVENT).join(_phase_columns(forwards), ["run_id", *ORDER])
    events = events.select(
        "run_id",
        *ORDER,
        "forward_index",
        "phase",
        "input_generated_token_step",
        "predicted_token_step",
        tx.router_layer(F.col("module_name")).alias("layer_index"),
        *_summary_columns(),
    )
    return runs.with_context(events, fx.contexts(spark, sf_dir, tokens, fx.MODELS[0]), "moe_route")


def canvas_passes(tokens: DataFrame) -> DataFrame:
    """The canvas of every step, from the keys of stored tokens."""
    steps = tokens.select("run_id", F.col("step").alias("global_step"), "step_index").distinct()
    placed = canvas.canvas_index(stage(steps, "passes"))
    return stage(placed.withColumnRenamed("global_step", "step"), "placed-passes")


def denoising_lanes(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    """Denoising tokens with their lane: one run, one canvas of it, one layer."""
    kept = tokens.filter(tx.canvas_router_phase(F.col("module_name")) == "denoising")
    kept = kept.withColumn("layer_index", tx.router_layer(F.col("module_name")))
    return kept.drop("step_index").join(placed, ["run_id", "step"])


def _rates(tokens: DataFrame, placed: DataFrame) -> DataFrame:
    lanes = stage(
        denoising_lanes(tokens, placed).select(*LANE, *ORDER, "token_index", "expert_ids"), "lanes"
    )
    overlap = routing.token_route_overlap(lanes, LANE, ORDER, chunk_of("step"))
    return routing.change_rates(overlap, LANE, ORDER, chunk_of("step"))


@query(
    "route_change_rate",
    f"""WITH {q.CHANGES} SELECT run_id, canvas_index, layer_index, step, event_order,
      round(change_rate, 6) + 0.0 AS expert_set_change_rate FROM rates""",
)
def route_change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _stored_tokens(spark, sf_dir)
    return _rates(tokens, canvas_passes(tokens)).withColumn(
        "expert_set_change_rate", r6(F.col("expert_set_change_rate"))
    )


@query(
    "canvas_router_events",
    f"""WITH {q.CHANGES}, {_SUMMARY.removeprefix(q.ROUTED + ', ')}, {q.contexts('router', fx.MODELS[1])},
    phased AS (SELECT * EXCLUDE (module_name), {_LAYER},
        CASE WHEN contains(module_name, '.encoder.') THEN 'encoder_prefill' ELSE 'denoising' END AS phase FROM summary)
    SELECT 'moe_route' AS event, s.* EXCLUDE (step), s.step AS global_step, p.canvas_index, p.step_index,
      round(r.change_rate, 6) + 0.0 AS expert_set_change_rate, c.* EXCLUDE (run_id)
    FROM phased s JOIN placed p ON p.run_id = s.run_id AND p.step = s.step JOIN contexts c ON c.run_id = s.run_id
    LEFT JOIN rates r ON r.run_id = s.run_id AND r.step = s.step AND r.event_order = s.event_order
      AND r.layer_index = s.layer_index AND s.phase = 'denoising'""",
)
def canvas_router_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its step's canvas; the rate stays null on encoder events."""
    tokens = _stored_tokens(spark, sf_dir)
    placed = canvas_passes(tokens)
    events = routing.summarize(tokens, EVENT).withColumns(
        {
            "phase": tx.canvas_router_phase(F.col("module_name")),
            "layer_index": tx.router_layer(F.col("module_name")),
        }
    )
    rates = _rates(tokens, placed).drop("canvas_index").withColumn("phase", F.lit("denoising"))
    events = events.join(rates, ["run_id", *ORDER, "layer_index", "phase"], "left")
    events = events.join(placed, ["run_id", "step"]).select(
        "run_id",
        F.col("step").alias("global_step"),
        "step_index",
        "canvas_index",
        "event_order",
        "phase",
        "layer_index",
        *_summary_columns(),
        r6(F.col("expert_set_change_rate")).alias("expert_set_change_rate"),
    )
    return runs.with_context(events, fx.contexts(spark, sf_dir, tokens, fx.MODELS[1]), "moe_route")


_CAME = "came AS (SELECT run_id, step FROM router GROUP BY ALL HAVING sum(label) % 4 <> 0)"


def came_steps(scores: DataFrame) -> DataFrame:
    """Steps (run_id, step) whose callback came: by the sum of their labels."""
    sums = scores.groupBy("run_id", "step").agg(F.sum("label").alias("s"))
    return sums.filter(F.col("s") % 4 != 0).select("run_id", "step")


@query(
    "unflushed_router_events",
    f"""WITH {q.ROUTER}, {_CAME}, happened AS (SELECT DISTINCT {q.EVENT} FROM router)
    SELECT h.* FROM happened h ANTI JOIN came c ON h.run_id = c.run_id AND h.step = c.step""",
)
def unflushed_router_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Router events of steps whose callback never came (here: by the sum of their labels)."""
    scores = fx.router_scores(spark, sf_dir)
    happened = scores.select(*EVENT).distinct()
    return routing.unflushed(happened, came_steps(scores), ["run_id", "step"]).select(*EVENT)


# --- canvases -----------------------------------------------------------------------------------


@query("canvas_index", f"WITH {q.CANVASES} SELECT run_id, global_step, step_index, canvas_index FROM indexed")
def canvas_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.canvas_index(fx.steps(spark, sf_dir)).select(
        "run_id", "global_step", "step_index", "canvas_index"
    )


@query(
    "canvas_changes",
    f"""WITH {q.CANVASES} SELECT run_id, global_step, step_index, canvas_index,
      {q.ints('changed_positions')} AS changed_positions, {q.ints('accepted_positions')} AS accepted_positions
    FROM changed""",
)
def canvas_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canvas.canvas_changes(fx.steps(spark, sf_dir)).select(
        "run_id",
        "global_step",
        "step_index",
        "canvas_index",
        _join("changed_positions").alias("changed_positions"),
        _join("accepted_positions").alias("accepted_positions"),
    )


@query(
    "canvas_steps",
    f"""WITH {q.CANVASES}, {q.WORDS}, letters AS (SELECT run_id, global_step, unnest(canvas) AS token_id,
        generate_subscripts(canvas, 1) AS at FROM steps),
    texts AS (SELECT l.run_id, l.global_step, string_agg(v.token_text, '' ORDER BY l.at) AS canvas_text
      FROM letters l JOIN vocab v ON l.token_id = v.token_id GROUP BY ALL)
    , {q.contexts('steps', fx.MODELS[1])}
    SELECT 'canvas_step' AS event, x.*, c.canvas_index, c.global_step, c.step_index,
      {q.ints('c.canvas')} AS canvas_token_ids, t.canvas_text, {q.ints('c.sampled_tokens')} AS sampled_token_ids,
      {q.ints('c.changed_positions')} AS changed_positions, {q.ints('c.accepted_positions')} AS accepted_positions
    FROM changed c JOIN texts t ON c.run_id = t.run_id AND c.global_step = t.global_step
      JOIN contexts x ON x.run_id = c.run_id""",
)
def canvas_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = fx.steps(spark, sf_dir)
    records = canvas.canvas_steps(steps, fx.vocabulary(spark, sf_dir))
    records = runs.with_context(records, fx.contexts(spark, sf_dir, steps, fx.MODELS[1]), "canvas_step")
    lists = ("canvas_token_ids", "sampled_token_ids", "changed_positions", "accepted_positions")
    return records.withColumns({c: _join(c) for c in lists})


@query(
    "mask_positions",
    f"""WITH {q.STEPS} SELECT run_id, global_step,
      {q.ints('list_filter([0, 1, 2, 3], lambda x: accepted_index[x + 1])')} AS accepted_positions FROM steps""",
)
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = mask_positions(F.col("accepted_index"))
    return fx.steps(spark, sf_dir).select(
        "run_id", "global_step", F.array_join(accepted, ",").alias("accepted_positions")
    )


@query(
    "accepted_probs",
    f"""WITH {q.STEPS}, cells AS (SELECT run_id, global_step, unnest(sampled_probs) AS p,
        unnest(accepted_index) AS accepted, generate_subscripts(sampled_probs, 1) AS pos FROM steps)
    SELECT run_id, global_step, CAST(row_number() OVER (PARTITION BY run_id, global_step ORDER BY pos) - 1 AS INTEGER)
      AS ord, round(p, 6) AS probability FROM cells WHERE accepted""",
)
def accepted_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = masked(F.col("sampled_probs"), F.col("accepted_index"))
    return fx.steps(spark, sf_dir).select(
        "run_id", "global_step", F.posexplode(kept).alias("ord", "p")
    ).select("run_id", "global_step", "ord", F.round("p", 6).alias("probability"))


@query(
    "step_trace_join",
    f"""WITH {q.STEPS} SELECT run_id, global_step, {q.ints('canvas')} AS canvas, event_type <> 'error' AS has_trace,
      CASE WHEN event_type <> 'error' THEN {q.ints('sampled_tokens')} END AS sampled_tokens FROM steps""",
)
def step_trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.steps(spark, sf_dir)
    traces = rows.filter(F.col("event_type") != "error").select(
        "run_id", "global_step", "sampled_tokens"
    )
    joined = canvas.attach_traces(rows.select("run_id", "global_step", "canvas"), traces)
    return joined.withColumns({c: _join(c) for c in ("canvas", "sampled_tokens")})


# --- circuit breaker and audits -----------------------------------------------------------------


@query(
    "breaker_keep_rows",
    f"""WITH {q.STATUS}, hits AS (
        SELECT model_run, component, min(ord) AS hit FROM status WHERE failed AND component <> 'scheduler_trace' GROUP BY ALL
        UNION ALL SELECT model_run, c.component, min(ord) FROM status, (VALUES ('canvas'), ('logits'), ('moe')) c(component)
          WHERE failed AND status.component = 'scheduler_trace' GROUP BY ALL),
    first_hit AS (SELECT model_run, component, min(hit) AS hit FROM hits GROUP BY ALL)
    SELECT s.model_run, s.component, s.ord, s.failed FROM status s
      LEFT JOIN first_hit f ON f.model_run = s.model_run AND f.component = s.component
    WHERE s.component <> 'scheduler_trace' AND (f.hit IS NULL OR s.ord < f.hit)""",
)
def breaker_keep_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = audit.rows_before_failure(fx.component_status(spark, sf_dir), "model_run", "ord")
    return kept.select("model_run", "component", "ord", "failed")


_EXPECTED = """expected AS (SELECT lang || '/' || source AS model_id, count(*) AS expected
      FROM documents GROUP BY ALL), outputs AS (SELECT lang || '/' || source AS model_id FROM documents d
      JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "run_audit",
    f"""WITH {_EXPECTED}, actual AS (SELECT model_id, count(*) AS actual FROM outputs GROUP BY model_id)
    SELECT e.model_id, e.expected, a.actual FROM expected e LEFT JOIN actual a ON e.model_id = a.model_id
    WHERE a.actual IS DISTINCT FROM e.expected""",
)
def run_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents").withColumn(
        "model_id", F.concat("lang", F.lit("/"), "source")
    )
    expected = documents.groupBy("model_id").agg(F.count(F.lit(1)).alias("expected"))
    outputs = documents.join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return audit.count_mismatches(outputs, expected)


@query(
    "artifact_audit",
    """WITH runs AS (SELECT DISTINCT lang AS run, source FROM documents),
    expected AS (SELECT DISTINCT run, unnest(['manifest.json', 'dataset.json', 'inputs.jsonl']) AS path FROM runs
      UNION ALL SELECT run, source || '/outputs.jsonl' FROM runs),
    present AS (SELECT DISTINCT lang AS run, unnest(['manifest.json', source || '/outputs.jsonl']) AS path
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)
    SELECT e.run, e.path FROM expected e ANTI JOIN present p ON e.run = p.run AND e.path = p.path""",
)
def artifact_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("run"), "source"
    )
    toxic = fx.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    made = documents.join(toxic, "doc_id", "left_semi")
    files = F.array(F.lit("manifest.json"), F.concat("source", F.lit("/outputs.jsonl")))
    present = made.select("run", F.explode(files).alias("path")).distinct()
    expected = audit.expected_artifacts(documents, "run", "source")
    return audit.missing_artifacts(expected, present, "run")
