"""Run rows, inference, records, sources, audits and whole experiments."""

from __future__ import annotations

import json
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalweave import session
from evalweave.operators import audit, inference, runs, tokens
from evalweave.operators.dataset import ManifestSpec, number_examples
from evalweave.plans import experiment as ex
from evalweave.schemas import EXAMPLE_SCHEMA, OUTPUT_SCHEMA
from evalweave.session import stage
from evalweave.sources import jsonl, tables
from evalweave.streaming import stateful

MODELS = ("org/base-26b", "org/diffusion-26b")

# The workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def examples(spark, n=12):
    rows = [(f"e{i:02d}", f"prompt {i}", None, *[None] * 7, None, "s") for i in range(n)]
    return spark.createDataFrame(rows, EXAMPLE_SCHEMA)


def echo():
    def predict(prompts, seeds):
        return [
            inference.Prediction(
                f"{p}|{s}", [1, 2], len(p), raw_text=f"<s>{p}", error="ValueError: x" if "prompt 3\n" in p else None
            )
            for p, s in zip(prompts, seeds, strict=True)
        ]

    return predict


def test_defaults_and_model_order():
    spec = runs.RunSpec("e", [*MODELS, MODELS[0]])
    assert spec.models == MODELS and spec.batch_size == 1 and spec.max_batches == 1
    assert not (spec.log_logits or spec.log_moe or spec.log_tokens or spec.log_canvas)
    for bad in ({"models": []}, {"models": MODELS, "batch_size": 0}, {"models": MODELS, "max_batches": 0}):
        with pytest.raises(ValueError):
            runs.RunSpec("e", **bad)
    with pytest.raises(ValueError):
        runs.Sampling(top_p=1.5)
    greedy = json.loads(runs.Sampling(do_sample=False).recorded())
    assert greedy["temperature"] is greedy["top_p"] is greedy["top_k"] is None
    assert json.loads(runs.Sampling().recorded())["top_k"] == 64


def test_a_trial_caps_the_rows_and_lifts_the_batch_cap():
    data, run = ManifestSpec(shuffle=True), runs.RunSpec("e", MODELS, max_batches=1)
    capped, whole = ex.trial_specs(data, run)
    assert capped.max_samples == 10 and not capped.shuffle
    assert whole.max_batches is None and whole.models == MODELS
    assert ex.trial_specs(data, run, 2)[0].max_samples == 2
    with pytest.raises(ValueError):
        ex.trial_specs(data, run, 0)


def test_response_is_the_primary_output_field(spark, tmp_path):
    df = spark.createDataFrame(
        [("example-1", "hello", "clean answer", "<start>clean answer<end>", [1, 2], 3, "formatted hello")],
        "example_id string, prompt string, final_text string, raw_response string, "
        "final_token_ids array<int>, input_token_count int, rendered_prompt string",
    )
    path = str(tmp_path / "outputs")
    assert jsonl.write_json(runs.output_records(df), path, keep_nulls=False) == 1
    record = jsonl.require_objects(spark, path, OUTPUT_SCHEMA).first()
    assert record["response"] == record["final_text"] == "clean answer"
    assert record["raw_response"] == "<start>clean answer<end>"
    assert record["rendered_prompt"] == "formatted hello"
    assert record["output_token_count"] == 2 and record["input_token_count"] == 3
    text = "".join(part.read_text() for part in Path(path).glob("part-*.json"))
    line = json.loads(text)
    assert "response_error" not in line and line["event"] == "final_output"


def test_run_ids_and_seeds_repeat(spark):
    manifest = number_examples(examples(spark), ManifestSpec())
    spec = runs.RunSpec("e", MODELS)
    first = runs.run_matrix(manifest, spec).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, runs.run_matrix(manifest.repartition(5), spec).collect()))
    assert len({r["run_id"] for r in first}) == 24
    seeds = {(r["example_id"], r["seed"]) for r in first}
    assert len(seeds) == 12 and all(0 <= s < 2**31 for _, s in seeds)


def test_pairing_is_audited_both_ways(spark):
    schema = "experiment_id string, model_id string, example_id string"
    left = spark.createDataFrame([("e", "m", "1"), ("e", "m", "2")], schema)
    right = spark.createDataFrame([("e", "m", "2"), ("e", "m", "3")], schema)
    assert runs.pair_outputs(left, right).count() == 1
    found = runs.unpaired(left, right).collect()
    assert sorted((r["example_id"], r["missing"]) for r in found) == [("1", "result"), ("3", "context")]


def test_a_predictor_must_answer_every_prompt(spark):
    rows = runs.run_matrix(number_examples(examples(spark), ManifestSpec()), runs.RunSpec("e", MODELS))

    def short():
        return lambda prompts, seeds: []

    with pytest.raises(Exception, match="0 results for"):
        inference.batch_infer(rows, short, name="short", batch_size=4).collect()


@pytest.mark.parametrize("most_bytes", [tokens.DICTIONARY_BYTES, 10])
def test_detokenize_with_special_unknown_and_no_tokens(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(tokens, "TOKENS_HELD", 2)
    vocab = spark.createDataFrame(
        [(0, "<s>", True), (1, "he", False), (2, "llo", False)], "token_id int, token_text string, is_special boolean"
    )
    vocab = stage(vocab, "vocabulary")
    df = spark.createDataFrame(
        [("a", [0, 1, 2, 0]), ("b", [1, 7, 9]), ("c", []), ("d", None), ("e", [1, None])], "run_id string, ids array<int>"
    )
    decoded = tokens.detokenize(df, ["run_id"], "ids", vocab, most_bytes)
    assert decoded.columns == ["run_id", "ids", "raw_response", "clean_text", "response_error"]
    assert decoded.schema["ids"].dataType == df.schema["ids"].dataType
    rows = {r["run_id"]: r for r in tokens.capture_errors(decoded).collect()}
    assert set(rows) == set("abcde") and rows["a"]["ids"] == [0, 1, 2, 0]
    assert rows["a"]["raw_response"] == "<s>hello<s>" and rows["a"]["final_text"] == "hello"
    assert rows["b"]["raw_response"] is None and rows["b"]["final_text"] == ""
    assert rows["b"]["response_error"] == "KeyError: unknown token id 7" and rows["b"]["ids"] == [1, 7, 9]
    for empty in "cd":
        assert rows[empty]["raw_response"] == "" and rows[empty]["response_error"] is None and rows[empty]["ids"] == []
    assert rows["e"]["response_error"] == "KeyError: unknown token id null" and rows["e"]["ids"] == [1, None]


def test_words_and_ids_go_back_and_forth(spark, monkeypatch):
    vocab = stage(spark.createDataFrame([(3, "a", False), (7, "", False), (9, "b\u00e9", True)], "token_id int, token_text string, is_special boolean"), "vocabulary")
    df = spark.createDataFrame([("1", "a b\u00e9 a"), ("2", ""), ("3", None), ("4", " a  x")], "run_id string, text string")
    want = {"1": [3, 9, 3], "2": [7], "3": None, "4": [7, 3, 7, None]}
    for most in (tokens.DICTIONARY_BYTES, 0):
        monkeypatch.setattr(tokens.dictionary, "__defaults__", (most,))
        coded = tokens.encode_words(df, ["run_id"], "text", vocab, "ids")
        assert {r["run_id"]: r["ids"] for r in coded.collect()} == want
    repeated = stage(vocab.unionByName(vocab), "vocabulary")
    with pytest.raises(ValueError, match="several texts"):
        tokens.dictionary(repeated, tokens.DICTIONARY_BYTES)


def test_experiment_end_to_end(spark, tmp_path):
    data, run = ManifestSpec(), runs.RunSpec("run-1", MODELS, batch_size=5, max_batches=None)
    engines = dict.fromkeys(MODELS, echo)
    done = ex.run_experiment(spark, examples(spark), data, run, engines, str(tmp_path))
    assert done.completed == dict.fromkeys(MODELS, 12) and done.examples == 12
    ex.require_complete(spark, done, run, 12)
    with pytest.raises(RuntimeError, match="base-26b/outputs has 12 of 13; .*inputs has 12 of 13"):
        ex.require_complete(spark, done, run, 13)
    more = runs.RunSpec("run-1", [*MODELS, "org/absent"])
    wrong = ex.shortfalls(spark, done, more.models, 12).collect()
    assert [tuple(r) for r in wrong] == [("absent/outputs", 12, None)]
    records = {(r["model_id"], r["example_id"]): r for r in ex.read_outputs(spark, done).collect()}
    good, bad = records[(MODELS[0], "e01")], records[(MODELS[1], "e03")]
    assert good["response"] == f"<user>\nprompt 1\n<model>\n|{good['seed']}" and good["response_error"] is None
    assert bad["response"].startswith("<user>") and bad["raw_response"] == "<s><user>\nprompt 3\n<model>\n"
    assert bad["response_error"] == "ValueError: x"
    assert bad["final_token_ids"] == [1, 2] and bad["model_kind"] == "diffusion"
    # A folder that holds anything is refused before any work.
    with pytest.raises(Exception, match="(?i)already exists"):
        ex.run_experiment(spark, examples(spark), data, run, engines, str(tmp_path))
    present = audit.list_artifacts(spark, done.root).select(F.split("path", "/")[0].alias("top")).distinct()
    assert {r["top"] for r in present.collect()} >= {"inputs", "dataset", "manifest", "base-26b", "diffusion-26b"}


def test_a_failing_model_does_not_stop_the_other(spark, tmp_path):
    def broken():
        raise RuntimeError("no such engine")

    run = runs.RunSpec("run-2", MODELS, batch_size=2, max_batches=2)
    with pytest.raises(inference.RunFailed, match="failed for: org/base-26b") as caught:
        ex.run_experiment(
            spark, examples(spark), ManifestSpec(), run, {MODELS[0]: broken, MODELS[1]: echo}, str(tmp_path)
        )
    assert caught.value.completed == {MODELS[1]: 4}
    error = spark.read.json(str(tmp_path / "run-2/base-26b/error")).first()
    assert error["model_name"] == MODELS[0] and "no such engine" in error["message"]


def test_a_refused_dataset_leaves_the_folder_free(spark, tmp_path):
    run, engines = runs.RunSpec("run-4", MODELS, max_batches=None), dict.fromkeys(MODELS, echo)
    twice = examples(spark).unionByName(examples(spark))
    with pytest.raises(ValueError, match="duplicate"):
        ex.run_experiment(spark, twice, ManifestSpec(), run, engines, str(tmp_path))
    assert not (tmp_path / "run-4").exists()
    assert ex.run_experiment(spark, examples(spark), ManifestSpec(), run, engines, str(tmp_path)).examples == 12


def test_models_that_share_a_folder_are_refused(spark, tmp_path):
    run = runs.RunSpec("run-3", ["a/same", "b/same"])
    with pytest.raises(ValueError, match="share"):
        ex.run_experiment(spark, examples(spark), ManifestSpec(), run, {}, str(tmp_path))


def test_strict_json_lines_name_file_and_line(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert sorted(r["a"] for r in jsonl.require_objects(spark, str(good), "a int").collect()) == [1, 2]
    lines = [json.dumps({"a": i, "pad": "x" * 50}) for i in range(400)]
    lines[10], lines[200], lines[390] = "", "[1, 2]", '{"a": '
    bad = tmp_path / "bad.jsonl"
    bad.write_text("\n".join(lines) + "\n")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(str(bad)).rdd.getNumPartitions() > 2
        found = {r["line_number"]: r["reason"] for r in jsonl.rejects(spark, str(bad)).collect()}
        with pytest.raises(ValueError, match="bad.jsonl:201"):
            jsonl.require_objects(spark, str(bad), "a int")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert found == {201: "not_object", 391: "broken"}
    assert jsonl.read_objects(spark, str(bad), "a int").count() == 397


def test_json_sink_counts_refuses_and_appends(spark, tmp_path):
    path = str(tmp_path / "t")
    assert jsonl.write_json(spark.range(5), path) == 5
    with pytest.raises(Exception, match="(?i)already exists"):
        jsonl.write_json(spark.range(5), path)
    assert jsonl.append_json(spark.range(3), path) == 3
    assert spark.read.schema("id bigint").json(path).count() == 8


def test_scan_needs_a_schema_for_json(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "rev/train"))
    with pytest.raises(ValueError):
        tables.scan(spark, str(tmp_path), file_format="json", split="train", revision="rev")
    df = tables.scan(
        spark, str(tmp_path), schema="id bigint", file_format="json", split="train", revision="rev"
    )
    assert df.count() == 3


def test_full_logits_are_found_by_run(spark, tmp_path):
    rows = [(f"r{i}", t, [float(i), float(t)]) for i in range(6) for t in range(3)]
    df = spark.createDataFrame(rows, "run_id string, token_step int, scores array<float>")
    tables.write_full_logits(tables.with_logit_keys(df), str(tmp_path / "full"), buckets=4)
    found = tables.read_full_logits(spark, str(tmp_path / "full"), "r3", buckets=4).collect()
    assert sorted(r["full_logits_key"] for r in found) == [f"r3/token-{t:04d}" for t in range(3)]
    keyed = df.select("run_id", F.lit(2).alias("canvas_index"), F.lit(31).alias("step_index"))
    assert tables.with_logit_keys(keyed, canvas=True).first()["full_logits_key"] == "r0/canvas-002-step-031"


def test_missing_artifacts_and_models(spark):
    wanted = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "model_id string, expected int")
    outputs = spark.createDataFrame([("a",), ("a",), ("b",)], "model_id string")
    wrong = audit.count_mismatches(outputs, wanted).collect()
    assert sorted((r["model_id"], r["actual"]) for r in wrong) == [("b", 1), ("c", None)]
    expected = audit.expected_artifacts(spark.createDataFrame([("r", "m")], "run string, subdir string"), "run", "subdir")
    present = spark.createDataFrame([("r", "inputs.jsonl"), ("r", "m/outputs.jsonl")], "run string, path string")
    missing = {r["path"] for r in audit.missing_artifacts(expected, present, "run").collect()}
    assert missing == {"manifest.json", "dataset.json"}


def test_a_late_step_stops_the_stream(spark, tmp_path):
    schema = "run_id string, global_step int, step_index int, canvas array<int>, accepted_index array<boolean>"
    for wave in ([5, 6], [4]):
        rows = [("a", s, 1, [1], [True]) for s in wave]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = stateful.read_folder(
        spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, files_per_batch=1
    )
    with pytest.raises(Exception, match="came after step"):
        stateful.run_to_files(stateful.canvas_changes_stream(arriving), "late")


def test_a_used_folder_is_refused_and_an_empty_one_taken(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    tables.claim_run_folder(spark, str(tmp_path / "empty"), "e")
    (tmp_path / "used").mkdir()
    (tmp_path / "used" / "left-over.txt").write_text("x")
    for folder in ("empty", "used"):
        with pytest.raises(FileExistsError):
            tables.claim_run_folder(spark, str(tmp_path / folder), "e")


def test_an_invalid_manifest_leaves_no_dataset_document(spark, tmp_path):
    twice = examples(spark).union(examples(spark))
    run = runs.RunSpec("run-4", MODELS)
    with pytest.raises(ValueError, match="duplicate_id"):
        ex.run_experiment(spark, twice, ManifestSpec(), run, {}, str(tmp_path))
    assert not (tmp_path / "run-4" / "dataset").exists()


class _Session:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}")
        self.conf = SimpleNamespace(get=lambda key, default: default)


def test_only_a_local_session_makes_its_own_folder():
    assert session.shared_dir(_Session("local[2]")) == session.shared_dir(_Session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(_Session("spark://host:7077"))


def test_engines_never_outlive_their_call(spark):
    rows = spark.createDataFrame([("r", "p", 1)], "run_id string, prompt string, seed long")

    def factory(answer):
        def build():
            return lambda prompts, seeds: [inference.Prediction(answer, [1]) for _ in prompts]

        return build

    for answer in ("first", "second"):
        got = inference.batch_infer(rows, factory(answer), name="same").first()
        assert got["final_text"] == answer


def test_a_worker_holds_one_engine():
    inference._predictor("one", lambda: "a")
    assert inference._predictor("one", lambda: "b") == "a"
    inference._predictor("two", lambda: "c")
    assert inference._HELD == {"two": "c"}


def test_text_raw_text_and_error_pass_through(spark):
    made = [
        inference.Prediction("kept", [1], raw_text="<raw>", error="raw decode: X: y"),
        inference.Prediction("text", [1], raw_text=""),
        inference.Prediction("", [1], error="E: none"),
        inference.Prediction("plain", [1]),
    ]
    rows = spark.createDataFrame([(str(i), "p", i) for i in range(4)], "run_id string, prompt string, seed long")
    fields = [(p.text, p.raw_text, p.error) for p in made]

    def build():
        return lambda prompts, seeds: [
            inference.Prediction(fields[s][0], [1], raw_text=fields[s][1], error=fields[s][2]) for s in seeds
        ]

    got = inference.batch_infer(rows, build, name="fields").orderBy("run_id").collect()
    assert [(r["final_text"], r["raw_response"], r["response_error"]) for r in got] == [
        ("kept", "<raw>", "raw decode: X: y"),
        ("text", "", None),
        ("", None, "E: none"),
        ("plain", "plain", None),
    ]


@pytest.mark.parametrize("most_bytes", [tokens.DICTIONARY_BYTES, 10])
def test_a_vocabulary_of_any_size_is_never_joined_to_the_tokens(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(tokens, "TOKENS_HELD", 3)
    for name, value in (("PART_TOKENS", 7), ("PART_BYTES", 40), ("SLICE_ENTRIES", 12)):
        monkeypatch.setattr(tokens, name, value)
    monkeypatch.setattr(tokens.dictionary, "__defaults__", (most_bytes,))
    # A text that is null, a flag that is null, an id beyond four bytes.
    entries = [(i, f"w{i}" if i != 5 else None, None if i == 6 else i % 4 == 0) for i in range(40)] + [(1 << 40, "far", False)]
    vocab = stage(spark.createDataFrame(entries, "token_id bigint, token_text string, is_special boolean"), "vocabulary")
    known = {i: (t, f) for i, t, f in entries}
    given = [(f"r{n}", n % 2, [(7 * n + j * j) % 45 for j in range(n % 9)] + [1 << 40, None] * (n % 5 == 0)) for n in range(60)]
    given += [("r1", 1, [3, 3, 3]), (None, None, [2]), ("empty", 0, []), ("null", 0, None)]
    df = spark.createDataFrame(given, "`a.b` string, n int, ids array<bigint>").repartition(3)
    found = tokens.token_events(df, ["a.b", "n"], "ids", vocab, most_bytes)
    assert found.columns == ["a.b", "n", "token_step", "token_id", "token_text", "is_special"]
    want = [(a, n, at, i, *known.get(i, (None, None))) for a, n, ids in given for at, i in enumerate(ids or [])]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # Tokens become rows at the very end, above any shuffle or join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.index("Generate ") < plan.index("MapInArrow")
    assert "Join" not in plan[: plan.index("MapInArrow")]

    # Rows of equal keys stay rows of their own.
    decoded = tokens.detokenize(df, ["a.b", "n"], "ids", vocab, most_bytes).collect()
    texts = []
    for a, n, ids in given:
        bad = [i for i in ids or [] if known.get(i, (None, None))[0] is None]
        raw, clean = ("".join(known[i][0] for i in (ids or []) if not bad and (f or not known[i][1])) for f in (True, False))
        least = min((i for i in bad if i is not None), default="null")
        error = f"KeyError: unknown token id {least}" if bad else None
        texts.append((a, n, ids or [], None if bad else raw, None if bad else clean, error))
    assert sorted(map(str, map(tuple, decoded))) == sorted(map(str, texts))

    rows = [(f"r{n}", " ".join(f"w{(n * j) % 43}" for j in range(n % 8))) for n in range(50)] + [("null", None), ("one", "w1  far")]
    coded = tokens.encode_words(spark.createDataFrame(rows, "k string, t string").repartition(3), ["k"], "t", vocab.filter("token_id < 100"), "ids")
    ids = {t: i for i, t, _ in entries if t and i < 100}
    assert {r["k"]: r["ids"] for r in coded.collect()} == {k: None if t is None else [ids.get(w) for w in t.split(" ")] for k, t in rows}


def test_inference_holds_few_rows_as_objects(spark):
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").alias("seed"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit(1.5).alias("x"))

    def sized():
        return lambda prompts, seeds: [inference.Prediction(p.upper(), [s, len(seeds)]) for p, s in zip(prompts, seeds, strict=True)]

    done = inference.batch_infer(rows, sized, name="sized", batch_size=100)
    assert "MapInArrow" in done._jdf.queryExecution().optimizedPlan().toString()
    assert done.columns[:3] == ["seed", "prompt", "x"]
    found = {r["seed"]: (r["final_text"], r["final_token_ids"], r["raw_response"], r["x"]) for r in done.collect()}
    assert found == {i: (f"P{i}", [i, 100], f"P{i}", 1.5) for i in range(1000)}
