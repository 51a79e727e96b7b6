"""The driver's tables in the shapes the operators take.

Every adapter reads whole tables, and its rows grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.text import prompt_hash
from evalweave.functions.vectors import softmax, topk
from evalweave.operators.dataset import normalize_examples
from evalweave.operators.ordered import chunk_of, scan_in_order
from evalweave.operators.runs import RunSpec, run_matrix
from evalweave.operators.tokens import dense_vocabulary, encode_words, words_of
from evalweave.schemas import EXAMPLE_COLUMNS
from evalweave.session import stage

SPECIAL_EVERY = 50
MODELS = ("org/base-26b", "org/Diffusion-26b")
EXPERIMENT = "exp-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as labelled example rows; ``position`` is the file order."""
    rows = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    toxic, quality = F.col("toxic"), F.col("quality")
    nothing = F.lit(None)
    return rows.select(
        F.col("doc_id").alias("position"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("prompt"),
        nothing.cast("string").alias("response"),
        F.when(toxic == 1, "unsafe").when(toxic == 0, "safe").alias("prompt_label"),
        F.when(quality == 1, "good").when(quality == 0, "poor").alias("response_label"),
        F.when(toxic == 1, "toxic").alias("violated_categories"),
        F.when(toxic.isNotNull(), "labels").alias("prompt_label_source"),
        nothing.cast("string").alias("response_label_source"),
        nothing.cast("string").alias("tag"),
        F.col("lang").alias("language"),
        nothing.cast("double").alias("reconstruction_id_if_redacted"),
        "source",
    )


def dirty_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with white space, empty and repeated ids, blank prompts, odd numbers."""
    n = F.col("position")
    pads = F.array(*[F.lit(c) for c in ("", "\t", "\u00a0", "\u3000", "\n")])
    pad = F.get(pads, (n % 5).cast("int"))
    numbers = F.array(*[F.lit(v) for v in ("1.5", " 2 ", "nan", "inf", "1.5d", "abc")])
    return examples(spark, sf_dir).withColumns(
        {
            "id": F.when(n % 97 == 96, F.lit(""))
            .when(n % 101 == 100, (n - 1).cast("string"))
            .otherwise(F.col("id")),
            "prompt": F.when(n % 89 == 88, F.lit(" \t ")).otherwise(
                F.concat(pad, F.col("prompt"), pad)
            ),
            "language": F.when(n % 7 == 6, F.concat(F.lit(" "), F.col("language"), F.lit(" "))).otherwise(
                F.col("language")
            ),
            "reconstruction_id_if_redacted": F.get(numbers, (n % 6).cast("int")),
        }
    )


def answered_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered by the very next turn, as examples with a reference response."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user")
    answers = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    # Turns are numbered without gaps, so "the next turn" is an equi-join, not a window.
    pairs = asked.join(answers, ["conv_id", "turn"])
    empty = [
        F.lit(None).cast("string").alias(c)
        for c in (
            "prompt_label",
            "response_label",
            "violated_categories",
            "prompt_label_source",
            "response_label_source",
            "tag",
            "language",
        )
    ]
    return pairs.select(
        (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("position"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text").alias("prompt"),
        F.col("answer").alias("response"),
        *empty,
        F.lit(None).cast("double").alias("reconstruction_id_if_redacted"),
        F.lit("conversations").alias("source"),
    )


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score vectors of generated tokens: one run per label."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("run_id"),
        "vec_id",
        (F.col("vec_id") % 64).cast("int").alias("selected_token_id"),
        F.col("embedding").alias("scores"),
    )
    stepped = scan_in_order(rows, ["run_id"], ["vec_id"], chunk_of("vec_id"), number="_step")
    return stepped.select(
        "run_id",
        F.col("_step").cast("int").alias("token_step"),
        "selected_token_id",
        "scores",
        "vec_id",
    )


def _group():
    return F.floor(F.col("vec_id") / 8)


def canvas_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as per-position logits: eight positions a step, eight steps a run."""
    group = _group()
    best = F.get(topk(F.col("embedding"), 1), F.lit(0))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(group / 8).cast("string").alias("run_id"),
        (group % 8).cast("int").alias("global_step"),
        (group % 4).cast("int").alias("step_index"),
        (F.col("vec_id") % 8).cast("int").alias("position"),
        F.col("embedding").alias("logits"),
        best["index"].cast("int").alias("sampled_token_id"),
        best["value"].cast("double").alias("sampled_prob"),
        (F.col("vec_id") % 3 == 0).alias("accepted"),
    )


def router_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as routing scores: eight tokens an event, two layers a forward, two forwards a step.

    A run has four steps on two canvases. The first forward of a canvas goes through the encoder.
    """
    group = _group()
    step = F.floor((group % 16) / 4).cast("int")
    forward = F.floor((group % 4) / 2).cast("int")
    layer = (group % 2).cast("string")
    encoded = (step % 2 == 0) & (forward == 0)
    prefix = F.when(encoded, "model.encoder.layers.").otherwise("model.layers.")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(group / 16).cast("string").alias("run_id"),
        step.alias("step"),
        forward.alias("event_order"),
        (step % 2).alias("step_index"),
        F.concat(prefix, layer, F.lit(".router")).alias("module_name"),
        (F.col("vec_id") % 8).cast("int").alias("token_index"),
        F.col("embedding").alias("scores"),
        "vec_id",
        "label",
    )


def normalized_router_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with scores that already sum to one, but for one token in some events."""
    raw = F.transform("scores", lambda v: v.cast("double"))
    return router_scores(spark, sf_dir).withColumn(
        "scores", F.when(F.col("vec_id") % 64 == 13, raw).otherwise(softmax(F.col("scores")))
    )


def contexts(spark: SparkSession, sf_dir: str, telemetry: DataFrame, model: str) -> DataFrame:
    """A context for every run of some telemetry: the document that bears the run's number, if there is one."""
    asked = telemetry.select(F.col("run_id").alias("id")).distinct()
    # Only the documents asked for are cleaned and moved.
    known = normalize_examples(examples(spark, sf_dir).join(asked, "id", "left_semi")).select(*EXAMPLE_COLUMNS)
    rows = asked.join(known, "id", "left").withColumns(
        {
            "row_index": F.col("id").cast("bigint"),
            "prompt_sha256": prompt_hash(F.coalesce("prompt", F.lit(""))),
        }
    )
    spec = RunSpec(experiment_id=EXPERIMENT, models=[model], max_batches=None)
    return run_matrix(rows, spec).withColumn("run_id", F.col("example_id"))


def steps(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events as denoising steps: a run per user, a new canvas at every signup. A stored table, of ``columns`` if given."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"),
        "ts",
        "event_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    numbered = scan_in_order(
        rows, ["run_id"], ["ts", "event_id"], F.col("ts").cast("date"), number="_step"
    ).withColumn("global_step", F.col("_step").cast("int"))
    numbered = stage(numbered, "numbered-events")
    start = F.when(F.col("event_type") == "signup", F.col("global_step"))
    looked = scan_in_order(
        numbered, ["run_id"], ["global_step"], chunk_of("global_step"), running={"_start": ("max", start)}
    )
    value, k = F.col("value"), F.col("k")
    kind = F.length("event_type")
    whole = F.floor(value).cast("int")
    made = looked.select(
        "run_id",
        "global_step",
        F.coalesce(F.col("global_step") - F.col("_start"), F.col("global_step") + 1).alias("step_index"),
        F.array(k, k % 10, whole % 7, kind).alias("canvas"),
        F.array(*[value > limit for limit in (5, 20, 50, 100)]).alias("accepted_index"),
        F.array((k + 1) % 100, k % 10, whole % 5, kind).alias("sampled_tokens"),
        F.array(*[limit / (limit + value) for limit in (5, 20, 50, 100)]).alias("sampled_probs"),
        "event_id",
        "event_type",
        "value",
    )
    return stage(made.select(*columns or made.columns), "steps")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of all documents, numbered in word order."""
    return dense_vocabulary(words_of(table(spark, sf_dir, "documents"), "text"), "word", SPECIAL_EVERY)


def generated(spark: SparkSession, sf_dir: str, vocab: DataFrame, *, with_unknown: bool = False) -> DataFrame:
    """Per document the token ids of its whole text; some get one id no vocabulary knows."""
    rows = encode_words(table(spark, sf_dir, "documents"), ["doc_id"], "text", vocab, "ids")
    ids = F.col("ids")
    if with_unknown:
        ids = F.when(F.col("doc_id") % 37 == 0, F.concat(ids, F.array(F.lit(-1)))).otherwise(ids)
    return rows.select(F.col("doc_id").cast("string").alias("run_id"), ids.alias("final_token_ids"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw model answers, in four forms."""
    text = F.col("text")
    form = F.col("turn") % 4
    keep_nulls = {"ignoreNullFields": "false"}
    raw = (
        F.when(form == 0, F.to_json(F.struct(text.alias("response"))))
        .when(form == 1, F.to_json(F.struct(F.lit(5).alias("response"), text.alias("content"))))
        .when(form == 2, F.to_json(F.struct(F.lit(None).cast("string").alias("text")), keep_nulls))
        .otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("example_id"),
        raw.alias("raw"),
    )


def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry writes; some fail, and a lost trace stops every component."""
    rows = table(spark, sf_dir, "events")
    names = F.array(*[F.lit(c) for c in ("canvas", "logits", "moe")])
    error = F.col("event_type") == "error"
    lost = error & (F.col("value") > 300)
    return rows.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("model_run"),
        F.when(lost, "scheduler_trace")
        .otherwise(F.get(names, (F.col("event_id") % 3).cast("int")))
        .alias("component"),
        F.col("event_id").alias("ord"),
        (error & (F.col("value") > 200)).alias("failed"),
    )
