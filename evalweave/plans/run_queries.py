"""Queries over runs: models, contexts, outputs, tokens."""

from __future__ import annotations

import hashlib
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions import text as tx
from evalweave.operators import dataset as ds
from evalweave.operators import audit, inference, resume, runs, tokens
from evalweave.plans import experiment
from evalweave.plans import fixtures as fx
from evalweave.plans import sql as q
from evalweave.plans.dataset_queries import SPEC
from evalweave.plans.registry import query
from evalweave.schemas import CONTEXT_COLUMNS, OUTPUT_SCHEMA
from evalweave.session import shared_path, stage
from evalweave.sources import jsonl, tables
from evalweave.streaming import stateful

RUN = runs.RunSpec(experiment_id=q.EXPERIMENT, models=fx.MODELS, max_batches=None)


def _runs(spark: SparkSession, sf_dir: str, revisions: dict[str, str] | None = None) -> DataFrame:
    return runs.run_matrix(ds.number_examples(fx.examples(spark, sf_dir), SPEC), RUN, revisions)


# Model names as a table: every (language, source) pair of the documents asks for a model.
_REQUESTS = """requests AS (SELECT doc_id, lang || '/' || CASE WHEN doc_id % 2 = 0 THEN 'Diffusion-' ELSE '' END
    || source AS model_name FROM documents)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    flavour = F.when(F.col("doc_id") % 2 == 0, "Diffusion-").otherwise("")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("lang", F.lit("/"), flavour, "source").alias("model_name")
    )


@query(
    "model_kind",
    f"""WITH {_REQUESTS} SELECT doc_id, CASE WHEN contains(lower(model_name), 'diffusion')
      THEN 'diffusion' ELSE 'autoregressive' END AS model_kind FROM requests""",
)
def model_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select(
        "doc_id", tx.model_kind(F.col("model_name")).alias("model_kind")
    )


@query(
    "model_subdir",
    f"""WITH {_REQUESTS}, names AS (SELECT DISTINCT model_name FROM requests)
    SELECT split_part(model_name, '/', -1) AS subdir, count(*) AS models, count(*) > 1 AS collides
    FROM names GROUP BY 1""",
)
def model_subdir(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _requests(spark, sf_dir).select("model_name").distinct()
    counted = names.groupBy(tx.model_subdir(F.col("model_name")).alias("subdir")).agg(
        F.count(F.lit(1)).alias("models")
    )
    return counted.withColumn("collides", F.col("models") > 1)


@query(
    "processor_choice",
    f"""WITH {_REQUESTS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own/processor' ELSE model_name END
      AS processor FROM requests""",
)
def processor_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = F.lit("template/model")
    own = F.when(F.col("doc_id") % 3 == 0, "own/processor").otherwise(template)
    return _requests(spark, sf_dir).select(
        "doc_id", tx.processor_choice(F.col("model_name"), template, own).alias("processor")
    )


@query(
    "dedupe_models",
    f"WITH {_REQUESTS} SELECT model_name, min(doc_id) AS doc_id FROM requests GROUP BY model_name",
)
def dedupe_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.dedupe_first_seen(_requests(spark, sf_dir), "model_name", "doc_id")


_LABELLED = f"{_REQUESTS}, known AS (SELECT model_name FROM requests r JOIN labels l ON r.doc_id = l.doc_id)"


@query(
    "unknown_models",
    f"WITH {_LABELLED} SELECT DISTINCT model_name FROM requests WHERE model_name NOT IN (SELECT model_name FROM known)",
)
def unknown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = _requests(spark, sf_dir)
    known = requested.join(fx.table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return runs.unknown_names(requested, known, "model_name")


@query(
    "run_id_check",
    r"""SELECT page_id, regexp_full_match(split_part(url, '://', 2), '[A-Za-z0-9._-]+') AS whole_ok,
      regexp_full_match(split_part(split_part(url, '://', 2), '/', 1), '[A-Za-z0-9._-]+') AS host_ok FROM pages""",
)
def run_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.element_at(F.split("url", "://"), 2)
    return fx.table(spark, sf_dir, "pages").select(
        "page_id",
        tx.valid_experiment_id(address).alias("whole_ok"),
        tx.valid_experiment_id(F.element_at(F.split(address, "/"), 1)).alias("host_ok"),
    )


@query(
    "sampling_params",
    """SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS recorded_temperature,
      CASE WHEN event_type <> 'view' THEN 0.9::DOUBLE END AS recorded_top_p,
      CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS recorded_top_k,
      CASE WHEN event_type <> 'view' THEN value ELSE 0.0 END AS engine_temperature,
      CASE WHEN event_type <> 'view' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS engine_top_p,
      CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE -1 END AS engine_top_k
    FROM events""",
)
def sampling_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    configurations = fx.table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("event_type") != "view").alias("do_sample"),
        F.col("value").alias("temperature"),
        F.lit(0.9).alias("top_p"),
        F.get_json_object("props", "$.k").cast("int").alias("top_k"),
    )
    return runs.recorded_sampling(configurations).drop("do_sample", "temperature", "top_p", "top_k")


@query(
    "run_matrix",
    f"WITH {q.RUNS} SELECT experiment_id, model_kind, model_id, run_id, example_id, row_index, seed FROM runs",
)
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select(
        "experiment_id", "model_kind", "model_id", "run_id", "example_id", "row_index", "seed"
    )


@query(
    "example_context",
    f"""WITH {q.RUNS} SELECT 1 AS schema_version, experiment_id, model_kind, model_id,
      'rev-' || length(model_id) AS model_revision, run_id, example_id, row_index, prompt_sha256, source,
      language, prompt_label, response_label, violated_categories, tag, seed FROM runs""",
)
def example_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    pinned = {m: f"rev-{len(m)}" for m in fx.MODELS}
    return _runs(spark, sf_dir, pinned).select(*CONTEXT_COLUMNS)


@query(
    "pinned_revisions",
    f"""WITH {q.RUNS}, pins AS (SELECT source, 'rev-' || max(doc_id) AS revision FROM documents GROUP BY source)
    SELECT r.run_id, r.source || '/' || r.model_kind AS model_id, p.revision AS model_revision
    FROM runs r LEFT JOIN (SELECT source || '/diffusion' AS model_id, revision FROM pins) p
      ON p.model_id = r.source || '/' || r.model_kind""",
)
def pinned_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _runs(spark, sf_dir).withColumn("model_id", F.concat("source", F.lit("/"), "model_kind"))
    revisions = (
        fx.table(spark, sf_dir, "documents")
        .groupBy(F.concat("source", F.lit("/diffusion")).alias("model_id"))
        .agg(F.concat(F.lit("rev-"), F.max("doc_id").cast("string")).alias("revision"))
    )
    return runs.pin_revisions(named, revisions).select("run_id", "model_id", "model_revision")


@query(
    "render_chat",
    """SELECT conv_id, string_agg('<' || role || '>' || chr(10) || text || chr(10), '' ORDER BY turn)
      || '<model>' || chr(10) AS rendered_prompt FROM conversations GROUP BY conv_id""",
)
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.render_conversation(
        fx.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text"
    )


@query(
    "render_single_turn",
    "SELECT doc_id, '<user>' || chr(10) || text || chr(10) || '<model>' || chr(10) AS rendered_prompt FROM documents",
)
def render_single_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.render_single_turn(F.col("text")).alias("rendered_prompt")
    )


def _stub_factory():
    """A predictor whose answers are a hash of seed and prompt; it refuses every 16th seed."""

    def predict(prompts: list[str], seeds: list[int]) -> list[inference.Prediction]:
        results = []
        for prompt, seed in zip(prompts, seeds, strict=True):
            digest = hashlib.sha256(f"{seed}:{prompt}".encode()).digest()
            refused = "ValueError: refused" if seed % 16 == 0 else None
            results.append(
                inference.Prediction(
                    "" if refused else digest.hex(), list(digest[:8]), len(prompt), error=refused
                )
            )
        return results

    return predict


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.batch_infer(_runs(spark, sf_dir), _stub_factory, name="stub", batch_size=32)


_DIGEST = "sha256(seed || ':' || prompt)"
_REFUSED = "seed % 16 = 0"
_IDS = "array_to_string([" + ", ".join(
    f"CAST('0x' || substr({_DIGEST}, {2 * i + 1}, 2) AS INTEGER)" for i in range(8)
) + "], ',')"
_INFERRED = f"""{q.RUNS}, inferred AS (SELECT *, length(prompt) AS input_token_count,
      CASE WHEN {_REFUSED} THEN '' ELSE {_DIGEST} END AS final_text, {_IDS} AS final_token_ids,
      CASE WHEN NOT {_REFUSED} THEN {_DIGEST} END AS raw_response,
      CASE WHEN {_REFUSED} THEN 'ValueError: refused' END AS response_error FROM runs)"""


@query(
    "batch_infer_stub",
    f"""WITH {_INFERRED} SELECT run_id, input_token_count, final_text, final_token_ids, raw_response,
      response_error FROM inferred""",
)
def batch_infer_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inferred(spark, sf_dir).select(
        "run_id",
        "input_token_count",
        "final_text",
        F.array_join("final_token_ids", ",").alias("final_token_ids"),
        "raw_response",
        "response_error",
    )


@query(
    "resumed_inference",
    f"""WITH {_INFERRED} SELECT run_id, final_text, response_error FROM inferred""",
)
def resumed_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference that stops after half of the manifest and goes on, some of it given again in other files."""
    asked = stage(_runs(spark, sf_dir).select("run_id", "prompt", "seed"), "asked-runs")
    path = shared_path(spark, "resumed")
    half = F.pmod(F.xxhash64("run_id"), F.lit(4))
    for wave in (half < 2, half >= 1):
        asked.filter(wave).repartition(4, "run_id").write.mode("append").parquet(f"{path}/runs")
        arriving = stateful.read_folder(spark, f"{path}/runs", asked.schema, files_per_batch=3)
        done = resume.resumable_infer(arriving, _stub_factory, path, name="stub", batch_size=32)
    return done.select("run_id", "final_text", "response_error")


def _records(inferred: DataFrame) -> DataFrame:
    configuration = F.lit(runs.Sampling().recorded())
    return runs.output_records(
        inferred
        .withColumn("generation_configuration", configuration)
        .withColumn("rendered_prompt", tx.render_single_turn(F.col("prompt")))
    )


_RECORD = f"""'final_output' AS event, 1 AS schema_version, experiment_id, model_kind, model_id,
      CAST(NULL AS VARCHAR) AS model_revision, run_id, example_id, row_index, prompt_sha256, source, language,
      prompt_label, response_label, violated_categories, tag, seed, prompt, response AS reference_response,
      '{runs.Sampling().recorded()}' AS generation_configuration, input_token_count,
      CAST(8 AS BIGINT) AS output_token_count, final_text AS response, final_text, final_token_ids,
      '<user>' || chr(10) || prompt || chr(10) || '<model>' || chr(10) AS rendered_prompt, raw_response,
      response_error"""


@query("output_records", f"WITH {_INFERRED} SELECT {_RECORD} FROM inferred")
def output_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and read back under the declared schema.

    A record holds its prompt twice, which compression all but undoes.
    """
    path = shared_path(spark, "outputs")
    jsonl.write_json(_records(_inferred(spark, sf_dir)), path, keep_nulls=False, compression="gzip")
    return spark.read.schema(OUTPUT_SCHEMA).json(path).withColumn(
        "final_token_ids", F.array_join("final_token_ids", ",")
    )


@query(
    "append_outputs",
    f"""WITH {_INFERRED} SELECT model_id, count(*) AS records, count(DISTINCT run_id) AS run_ids,
      count(*) AS appended FROM inferred GROUP BY model_id""",
)
def append_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One append per model into the same folder, as models run one after another."""
    path = shared_path(spark, "outputs")
    # What is derived from a row is left out of the stored copy.
    records = _records(stage(_inferred(spark, sf_dir), "inferred"))
    appended = {
        m: jsonl.append_json(records.filter(F.col("model_id") == m), path, compression="gzip") for m in fx.MODELS
    }
    counted = F.create_map(*[F.lit(x) for pair in appended.items() for x in pair])
    return (
        spark.read.schema(OUTPUT_SCHEMA)
        .json(path)
        .groupBy("model_id")
        .agg(F.count(F.lit(1)).alias("records"), F.count_distinct("run_id").alias("run_ids"))
        .withColumn("appended", F.element_at(counted, F.col("model_id")).cast("bigint"))
    )


@query(
    "outputs_per_model",
    f"""WITH {_INFERRED} SELECT model_id, count(*) AS outputs, CAST(sum(input_token_count) AS BIGINT) AS input_tokens,
      count(*) * 8 AS output_tokens, count(response_error) AS with_error FROM inferred GROUP BY model_id""",
)
def outputs_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outputs_per_model(_records(_inferred(spark, sf_dir)))


# Results of only the labelled documents, plus some of conversations nobody asked for.
_RESULTS = f"""{q.RUNS}, results AS (
      SELECT r.experiment_id, r.model_id, r.example_id, l.quality FROM runs r
        JOIN labels l ON r.example_id = CAST(l.doc_id AS VARCHAR)
      UNION ALL SELECT DISTINCT '{q.EXPERIMENT}', '{fx.MODELS[0]}', 'conv-' || conv_id, 0 FROM conversations)"""


def _results(spark: SparkSession, sf_dir: str, contexts: DataFrame) -> DataFrame:
    labels = fx.table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("example_id"), "quality"
    )
    strays = fx.table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        F.lit(q.EXPERIMENT).alias("experiment_id"),
        F.lit(fx.MODELS[0]).alias("model_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("example_id"),
        F.lit(0).alias("quality"),
    )
    answered = contexts.select(*runs.PAIR_KEYS).join(labels, "example_id")
    return answered.select(*runs.PAIR_KEYS, "quality").unionByName(strays)


@query(
    "zip_outputs",
    f"""WITH {_RESULTS} SELECT r.run_id, r.seed, s.quality FROM runs r JOIN results s
      ON r.experiment_id = s.experiment_id AND r.model_id = s.model_id AND r.example_id = s.example_id""",
)
def zip_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _runs(spark, sf_dir)
    paired = runs.pair_outputs(contexts, _results(spark, sf_dir, contexts))
    return paired.select("run_id", "seed", "quality")


@query(
    "zip_audit",
    f"""WITH {_RESULTS} SELECT coalesce(r.experiment_id, s.experiment_id) AS experiment_id,
      coalesce(r.model_id, s.model_id) AS model_id, coalesce(r.example_id, s.example_id) AS example_id,
      CASE WHEN s.example_id IS NULL THEN 'result' ELSE 'context' END AS missing
    FROM runs r FULL JOIN results s
      ON r.experiment_id = s.experiment_id AND r.model_id = s.model_id AND r.example_id = s.example_id
    WHERE r.example_id IS NULL OR s.example_id IS NULL""",
)
def zip_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = _runs(spark, sf_dir)
    return runs.unpaired(contexts, _results(spark, sf_dir, contexts))


def _tokens(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    vocab = fx.vocabulary(spark, sf_dir)
    return fx.generated(spark, sf_dir, vocab, **how), vocab


@query("token_events", f"WITH {q.WORDS} SELECT run_id, token_step, token_id, token_text FROM coded")
def token_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _tokens(spark, sf_dir)
    return tokens.token_events(made, ["run_id"], "final_token_ids", vocab).drop("is_special")


@query(
    "token_records",
    f"""WITH {q.RUNS}, {q.WORDS} SELECT 'token_step' AS event, 1 AS schema_version, r.experiment_id, r.model_kind,
      r.model_id, CAST(NULL AS VARCHAR) AS model_revision, r.run_id, r.example_id, r.row_index, r.prompt_sha256,
      r.source, r.language, r.prompt_label, r.response_label, r.violated_categories, r.tag, r.seed,
      c.token_step, c.token_id, c.token_text
    FROM coded c JOIN runs r ON r.example_id = c.run_id WHERE r.model_kind = 'autoregressive'""",
)
def token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows of the autoregressive model's runs, each with the context of its run."""
    made, vocab = _tokens(spark, sf_dir)
    asked = _runs(spark, sf_dir).filter(F.col("model_kind") == "autoregressive")
    ids = made.withColumnRenamed("run_id", "example_id")
    # The context joins a run's one row of ids, so its tokens need no second join.
    answered = asked.select(*CONTEXT_COLUMNS).join(ids, "example_id")
    events = tokens.token_events(answered, CONTEXT_COLUMNS, "final_token_ids", vocab)
    return events.drop("is_special").withColumn("event", F.lit("token_step"))


@query(
    "detokenize_raw",
    f"""WITH {q.WORDS} SELECT run_id,
      CASE WHEN CAST(run_id AS BIGINT) % 37 <> 0 THEN string_agg(token_text, '' ORDER BY token_step) END AS raw_response
    FROM coded GROUP BY run_id""",
)
def detokenize_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _tokens(spark, sf_dir, with_unknown=True)
    return tokens.detokenize(made, ["run_id"], "final_token_ids", vocab).select(
        "run_id", "raw_response"
    )


@query(
    "detokenize_clean",
    f"""WITH {q.WORDS} SELECT run_id,
      coalesce(string_agg(token_text, '' ORDER BY token_step) FILTER (WHERE NOT is_special), '') AS clean_text
    FROM coded GROUP BY run_id""",
)
def detokenize_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _tokens(spark, sf_dir)
    return tokens.detokenize(made, ["run_id"], "final_token_ids", vocab).select("run_id", "clean_text")


@query(
    "response_errors",
    f"""WITH {q.WORDS} SELECT run_id,
      CASE WHEN CAST(run_id AS BIGINT) % 37 = 0 THEN '' ELSE
        coalesce(string_agg(token_text, '' ORDER BY token_step) FILTER (WHERE NOT is_special), '') END AS final_text,
      CAST(count(*) + CASE WHEN CAST(run_id AS BIGINT) % 37 = 0 THEN 1 ELSE 0 END AS INTEGER) AS ids_kept,
      CASE WHEN CAST(run_id AS BIGINT) % 37 = 0 THEN 'KeyError: unknown token id -1' END AS response_error
    FROM coded GROUP BY run_id""",
)
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, vocab = _tokens(spark, sf_dir, with_unknown=True)
    decoded = tokens.detokenize(made, ["run_id"], "final_token_ids", vocab)
    return tokens.capture_errors(decoded).select(
        "run_id", "final_text", F.size("final_token_ids").alias("ids_kept"), "response_error"
    )


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of a document's characters as a token sequence; the first words are its prompt."""
    letters = F.split("text", "")
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.transform(letters, F.ascii).alias("ids"),
        F.length(F.substring_index("text", " ", 3)).alias("input_tokens"),
        F.lit(300).alias("generated"),
    )


_SEQUENCES = """sequences AS (SELECT doc_id, text,
      CASE WHEN len(string_split(text, ' ')) >= 3 THEN length(array_to_string(string_split(text, ' ')[1:3], ' '))
        ELSE length(text) END AS input_tokens FROM documents),
    parts AS (SELECT *, substr(text, input_tokens + 1) AS suffix FROM sequences)"""


def _code_points(value: str) -> str:
    return (
        f"coalesce(array_to_string(list_transform(string_split({value}, ''), lambda c: ord(c)), ','), '')"
    )


@query(
    "strip_prompt_ar",
    f"""WITH {_SEQUENCES} SELECT doc_id, CASE WHEN suffix = '' THEN '' ELSE {_code_points('suffix')} END AS ids
    FROM parts""",
)
def strip_prompt_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runs.drop_prompt(F.col("ids"), F.col("input_tokens"))
    return _sequences(spark, sf_dir).select("doc_id", F.array_join(kept, ",").alias("ids"))


@query(
    "strip_prompt_canvas",
    f"""WITH {_SEQUENCES}, kept AS (SELECT doc_id, CASE WHEN length(text) > 300 THEN suffix ELSE text END AS rest
      FROM parts) SELECT doc_id, CASE WHEN rest = '' THEN '' ELSE {_code_points('rest')} END AS ids FROM kept""",
)
def strip_prompt_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = runs.drop_prompt_if_longer(F.col("ids"), F.col("input_tokens"), F.col("generated"))
    return _sequences(spark, sf_dir).select("doc_id", F.array_join(kept, ",").alias("ids"))


@query(
    "final_text_choice",
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN 'clean ' || text ELSE '' END AS final_text,
      nullif(concat_ws('; ', CASE WHEN role = 'system' THEN 'raw decode: KeyError: 1' END,
        CASE WHEN turn % 3 = 2 THEN 'clean decode: KeyError: 2' END), '') AS response_error
    FROM conversations""",
)
def final_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = F.col("turn") % 3
    texts = F.when(form == 0, F.array("text")).otherwise(F.array().cast("array<string>"))
    decoded = F.when(form == 1, F.concat(F.lit("clean "), "text"))
    raw_error = F.when(F.col("role") == "system", "raw decode: KeyError: 1")
    clean_error = F.when(form == 2, "clean decode: KeyError: 2")
    return fx.table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        runs.final_text(texts, decoded).alias("final_text"),
        runs.joined_errors(raw_error, clean_error).alias("response_error"),
    )


@query(
    "experiment_manifest",
    f"""SELECT 1 AS schema_version, '{q.EXPERIMENT}' AS experiment_id, true AS stamped, 'documents' AS dataset_name,
      count(*) AS examples, '{', '.join(f'rev-{len(m)}' for m in fx.MODELS)}' AS revisions, true AS has_versions
    FROM documents""",
)
def experiment_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document. Its time stamp and versions are only checked to be there."""
    facts = ds.manifest_facts(ds.build_manifest(fx.examples(spark, sf_dir), SPEC))
    columns = tables.experiment_manifest(
        tables.experiment_id(q.EXPERIMENT),
        ds.describe_manifest(SPEC, facts, "inputs", "rev-1"),
        {m: f"rev-{len(m)}" for m in fx.MODELS},
        {"batch_size": str(RUN.batch_size), "log_seed": str(RUN.log_seed)},
    )
    document = jsonl.write_document(spark, shared_path(spark, "manifest"), columns)
    revisions = [F.element_at("resolved_model_revisions", F.lit(m)) for m in fx.MODELS]
    return document.select(
        "schema_version",
        "experiment_id",
        F.col("created_at").isNotNull().alias("stamped"),
        "dataset.dataset_name",
        "dataset.examples",
        F.concat_ws(", ", *revisions).alias("revisions"),
        F.element_at("software", F.lit("spark")).isNotNull().alias("has_versions"),
    )


@query(
    "model_errors",
    f"""WITH {q.RUNS}, counted AS (SELECT model_id, count(*) AS outputs FROM runs GROUP BY model_id)
    SELECT model_id AS model_name, outputs, CAST(NULL AS VARCHAR) AS error_type FROM counted
      WHERE model_id = '{fx.MODELS[0]}'
    UNION ALL SELECT '{fx.MODELS[1]}', CAST(NULL AS BIGINT), 'PythonException'""",
)
def model_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model completes, the other's engine breaks; both end up in the summary."""
    all_runs = stage(_runs(spark, sf_dir), "runs")

    def broken():
        raise RuntimeError("no such engine")

    def answered(model: str) -> DataFrame:
        factory = _stub_factory if model == fx.MODELS[0] else broken
        rows = all_runs.filter(F.col("model_id") == model)
        return inference.batch_infer(rows, factory, name=f"engine-{model}", batch_size=32)

    home = shared_path(spark, "run")
    done, broke = (
        experiment.run_model(spark, partial(answered, m), home, m, kind)
        for m, kind in zip(fx.MODELS, ("autoregressive", "diffusion"), strict=True)
    )
    summary = spark.createDataFrame([(fx.MODELS[0], done)], "model_name string, outputs bigint")
    errors = spark.read.schema(inference.ERROR_SCHEMA).json(
        f"{experiment.model_folder(home, fx.MODELS[1])}/error"
    )
    return summary.withColumn("error_type", F.lit(None).cast("string")).unionByName(
        errors.select("model_name", F.lit(broke).cast("bigint").alias("outputs"), "error_type")
    )


@query(
    "run_folder_guard",
    """SELECT source AS folder, count(*) FILTER (WHERE l.toxic = 1) > 0 AS used
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source""",
)
def run_folder_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by source; those of sources with a toxic document have been written to."""
    documents = fx.table(spark, sf_dir, "documents").withColumn("folder", F.col("source"))
    toxic = fx.table(spark, sf_dir, "labels").filter(F.col("toxic") == 1)
    root = shared_path(spark, "runs")
    written = documents.join(toxic, "doc_id", "left_semi").select("folder", "doc_id")
    written.write.partitionBy("folder").parquet(root)
    files = audit.list_artifacts(spark, root).filter(F.col("path").contains("/"))
    names = files.withColumn("path", F.regexp_replace("path", "^folder=", ""))
    return audit.used_folders(documents, names, "folder")
