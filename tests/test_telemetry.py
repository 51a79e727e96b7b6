"""Logits, routing and canvases against independent NumPy and plain Python."""

from __future__ import annotations

import itertools
import functools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalweave.functions import vectors
from evalweave.operators import audit, canvas, logits, routing, runs
from evalweave.operators.ordered import chunk_of
from evalweave.schemas import CONTEXT_SCHEMA
from evalweave.streaming import stateful

EVENT = ["run_id", "step", "layer_index"]


def entropy(p):
    return -sum(v * math.log(v) for v in p if v > 0)


def softmax(scores):
    raised = np.exp(np.asarray(scores, dtype=float) - np.max(scores))
    return raised / raised.sum()


def test_column_builders_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.normal(size=9).round(1)]) for i in range(40)]
    rows += [(40, [1.0, 1.0, 1.0]), (41, [0.0, float("-inf"), 2.0]), (42, [5.0])]
    df = spark.createDataFrame(rows, "i int, s array<float>")
    made = df.select(
        "i",
        vectors.logsumexp(F.col("s")).alias("lse"),
        vectors.entropy(F.col("s")).alias("h"),
        vectors.softmax(F.col("s")).alias("p"),
        vectors.topk(F.col("s"), 3).alias("top"),
    )
    values = dict(rows)
    for row in made.collect():
        scores = np.float32(values[row["i"]]).astype(float)
        p = softmax(scores)
        assert row["lse"] == pytest.approx(np.log(np.exp(scores).sum()))
        assert row["h"] == pytest.approx(entropy(p))
        assert row["p"] == pytest.approx(list(p))
        want = sorted(range(len(scores)), key=lambda j: (-scores[j], j))[:3]
        assert [t["index"] for t in row["top"]] == want


def test_masks(spark):
    df = spark.createDataFrame([([0.6, 0.7, 0.1], [True, False, True], [1, 2, 3], [1, 5, 3])],
                               "p array<double>, m array<boolean>, a array<int>, b array<int>")
    row = df.select(
        vectors.mask_positions(F.col("m")).alias("at"),
        vectors.masked(F.col("p"), F.col("m")).alias("kept"),
        vectors.changed_positions(F.col("a"), F.col("b")).alias("changed"),
        vectors.changed_positions(F.col("a"), F.lit(None).cast("array<int>")).alias("all"),
    ).first()
    assert row["at"] == [0, 2] and row["kept"] == [0.6, 0.1]
    assert row["changed"] == [1] and row["all"] == [0, 1, 2]


def test_kernel_ranks_ties_to_the_lower_index():
    block = np.array([[1.0, 3.0, 3.0, 3.0, 0.0], [2.0, 2.0, 2.0, 2.0, 2.0], [0.0, 1.0, 2.0, 3.0, 4.0]])
    assert vectors._ranked(block, 2).tolist() == [[1, 2], [0, 1], [4, 3]]
    assert vectors._ranked(block, 9).shape == (3, 5)


def test_token_logits_of_ragged_and_degenerate_rows(spark):
    rows = [("r", 0, 1, [2.0, 1.0, 0.0]), ("r", 1, 0, [0.0, float("-inf")]), ("r", 2, 3, [1.0] * 7)]
    df = spark.createDataFrame(rows, "run_id string, token_step int, selected_token_id int, scores array<float>")
    made = {r["token_step"]: r for r in logits.token_logits(df, top_k=2).collect()}
    for _, step, chosen, scores in rows:
        p = softmax(scores)
        assert made[step]["selected_token_probability"] == pytest.approx(p[chosen])
        assert made[step]["entropy"] == pytest.approx(entropy(p), abs=1e-12)
        want = sorted(range(len(scores)), key=lambda j: (-scores[j], j))[:2]
        assert made[step]["top_k_token_ids"] == want
        assert made[step]["top_k_probabilities"] == pytest.approx([p[j] for j in want])


def test_canvas_logit_record(spark):
    rows = [("run", 0, 0, 0, [2.0, 1.0, 0.0], 0, 0.6, True), ("run", 0, 0, 1, [0.0, 1.0, 2.0], 2, 0.7, False)]
    df = spark.createDataFrame(
        rows,
        "run_id string, global_step int, step_index int, position int, logits array<float>, "
        "sampled_token_id int, sampled_prob double, accepted boolean",
    )
    record = logits.canvas_logit_records(logits.canvas_logits(df, top_k=2)).first()
    assert len(record["entropy_per_position"]) == 2
    assert all(isinstance(v, float) and v >= 0 for v in record["entropy_per_position"])
    assert record["top_k_token_ids"] == [[0, 1], [2, 1]]
    assert record["sampled_token_ids"] == [0, 2]
    assert record["accepted_token_probabilities"] == [0.6]


def test_score_counts_are_reconciled(spark):
    scores = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "run_id string, token_step int")
    made = spark.createDataFrame([("a", [1, 2]), ("c", [1])], "run_id string, final_token_ids array<int>")
    wrong = logits.score_count_mismatch(scores, made)
    assert sorted(map(tuple, wrong.collect())) == [("b", 1, 0), ("c", 0, 1)]
    assert logits.matched_scores(scores, wrong).count() == 2
    with pytest.raises(ValueError, match="run b: 1 score rows for 0 tokens"):
        logits.require_matched_scores(scores, made)
    good = made.filter("run_id = 'a'")
    kept = scores.filter("run_id = 'a'")
    assert logits.require_matched_scores(kept, good).count() == 2


def events(spark, table):
    """{(run, step, layer): [[scores], ...]} as rows."""
    rows = [(*key, i, list(map(float, s))) for key, tokens in table.items() for i, s in enumerate(tokens)]
    return spark.createDataFrame(
        rows, "run_id string, step int, layer_index int, token_index int, scores array<float>"
    )


def brute_summary(tokens, selected):
    scores = np.float32(tokens).astype(float)
    sums = scores.sum(axis=1)
    keep = scores.min() >= 0 and np.all(np.abs(sums - 1) <= 2e-3)
    p = scores if keep else np.stack([softmax(s) for s in scores])
    k = min(selected, p.shape[1])
    ids = [sorted(range(p.shape[1]), key=lambda j: (-s[j], j))[:k] for s in scores]
    counts = np.bincount(np.concatenate(ids), minlength=p.shape[1])
    load = counts / max(1, len(ids) * k)
    h = -(np.log(np.maximum(p, 1e-12)) * p).sum(axis=1)
    lead = [row[i[0]] - row[i[1]] if k > 1 else row[i[0]] for row, i in zip(p, ids, strict=True)]
    return {
        "tokens_routed": len(p),
        "routed_expert_count": p.shape[1],
        "selected_experts_per_token": k,
        "shared_expert_active": True,
        "expert_token_counts": counts.tolist(),
        "expert_load_fraction": pytest.approx(load.tolist()),
        "router_entropy_mean": pytest.approx(h.mean()),
        "router_entropy_p95": pytest.approx(np.quantile(h, 0.95)),
        "top1_router_margin_mean": pytest.approx(np.mean(lead)),
        "expert_load_cv": pytest.approx(load.std() / load.mean()),
        "busiest": sorted(range(len(load)), key=lambda j: (-load[j], j))[:8],
    }


def router_table(seed=1):
    rng = np.random.default_rng(seed)
    table = {}
    for step in range(3):
        for layer in range(2):
            size = 40 if (step, layer) == (1, 1) else int(rng.integers(1, 6))
            table[("r", step, layer)] = rng.normal(size=(size, 12)).round(2)
    normal = np.stack([softmax(s) for s in rng.normal(size=(5, 12))])
    table[("kept", 0, 0)] = normal
    spoiled = normal.copy()
    spoiled[2] *= 1.01
    table[("spoiled", 0, 0)] = spoiled
    table[("loose", 0, 0)] = normal * 1.0015
    return table


@pytest.mark.parametrize("selected", [1, 3, 20])
@pytest.mark.parametrize("few", [4096, 4])
def test_router_summary_equals_brute_force(spark, monkeypatch, selected, few):
    narrow = functools.partial(routing.group_percentile, bins=3, few=few)
    monkeypatch.setattr(routing, "group_percentile", narrow)
    table = router_table()
    tokens = routing.route_tokens(events(spark, table), [*EVENT, "token_index"], selected=selected)
    summary = routing.summarize(tokens, EVENT)
    found = {(r["run_id"], r["step"], r["layer_index"]): r for r in summary.collect()}
    assert found.keys() == table.keys()
    for key, tokens_of in table.items():
        want = brute_summary(tokens_of, selected)
        busiest = want.pop("busiest")
        for name, value in want.items():
            assert found[key][name] == value, (key, name)
        assert [m["expert_id"] for m in found[key]["most_used_experts"]] == busiest


def test_counts_of_a_small_event(spark):
    df = events(spark, {("r", 0, 0): [[3, 2, 1, 0], [0, 1, 2, 3]]})
    summary = routing.summarize(routing.route_tokens(df, [*EVENT, "token_index"], selected=2), EVENT).first()
    assert (summary["tokens_routed"], summary["routed_expert_count"]) == (2, 4)
    assert summary["expert_token_counts"] == [1, 1, 1, 1]


def test_nan_scores_are_soft_maxed_and_empty_ones_refused(spark):
    df = events(spark, {("r", 0, 0): [[0.5, 0.5], [float("nan"), 0.5]]})
    tokens = routing.route_tokens(df, [*EVENT, "token_index"], selected=1)
    assert routing.normalization(tokens, EVENT).first()["kept"] is False
    summary = routing.summarize(tokens, EVENT).first()
    assert math.isnan(summary["router_entropy_mean"]) and math.isnan(summary["router_entropy_p95"])
    with pytest.raises(PySparkException):
        routing.route_tokens(events(spark, {("r", 0, 0): [[]]}), EVENT).collect()


def rates(spark, routes, chunk=4096):
    rows = [(*key, i, ids) for key, tokens in routes.items() for i, ids in enumerate(tokens)]
    df = spark.createDataFrame(
        rows, "run_id string, canvas_index int, layer_index int, step int, token_index int, expert_ids array<int>"
    )
    lane = ["run_id", "canvas_index", "layer_index"]
    overlap = routing.token_route_overlap(df, lane, ["step"], chunk_of("step", chunk))
    found = routing.change_rates(overlap, lane, ["step"], chunk_of("step", chunk)).collect()
    return {(r["run_id"], r["canvas_index"], r["layer_index"], r["step"]): r["expert_set_change_rate"] for r in found}


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_route_change_rate(spark, chunk):
    same = [[1, 2], [2, 3]]
    found = rates(
        spark,
        {
            ("r", 0, 0, 0): same,
            ("r", 0, 0, 1): [[2, 1], [3, 2]],
            ("r", 0, 0, 4): [[1, 9], [8, 9]],
            ("r", 0, 0, 5): [[1, 9]],
            ("r", 0, 0, 6): [[1, 9], [8, 9]],
            ("r", 0, 0, 7): [[1], [8]],
            ("r", 1, 0, 8): same,
            ("r", 0, 1, 1): same,
            ("q", 0, 0, 0): same,
        },
        chunk,
    )
    assert found[("r", 0, 0, 0)] is None
    assert found[("r", 0, 0, 1)] == 0.0
    assert found[("r", 0, 0, 4)] == pytest.approx(1 - (1 / 3 + 0) / 2)
    assert found[("r", 0, 0, 5)] is None  # fewer tokens than before
    assert found[("r", 0, 0, 6)] is None  # more tokens than before
    assert found[("r", 0, 0, 7)] is None  # fewer experts per token
    assert found[("r", 1, 0, 8)] is None  # another canvas
    assert found[("r", 0, 1, 1)] is None and found[("q", 0, 0, 0)] is None


@pytest.mark.parametrize("chunk", [1, 4096])
def test_forwards_of_one_step_are_events_of_their_own(spark, chunk):
    routes = {(0, 0): [[1, 2]], (0, 1): [[1, 3]], (0, 2): [[1, 3]], (2, 0): [[4, 5], [6, 7]], (2, 1): [[4, 5], [6, 9]]}
    rows = [("r", *key, i, ids) for key, tokens in routes.items() for i, ids in enumerate(tokens)]
    df = spark.createDataFrame(rows, "run_id string, step int, event_order int, token_index int, expert_ids array<int>")
    lane, order = ["run_id"], ["step", "event_order"]
    overlap = routing.token_route_overlap(df, lane, order, chunk_of("step", chunk))
    found = routing.change_rates(overlap, lane, order, chunk_of("step", chunk)).collect()
    rate = {(r["step"], r["event_order"]): r["expert_set_change_rate"] for r in found}
    assert rate == {
        (0, 0): None, (0, 1): pytest.approx(1 - 1 / 3), (0, 2): 0.0, (2, 0): None,
        (2, 1): pytest.approx(1 - (1 + 1 / 3) / 2),
    }
    index = routing.forward_index(df, "run_id", order, chunk_of("step", chunk)).collect()
    assert sorted((r["step"], r["event_order"], r["forward_index"]) for r in index) == [
        (0, 0, 0), (0, 1, 1), (0, 2, 2), (2, 0, 3), (2, 1, 4),
    ]
    scores = spark.createDataFrame(
        [("r", 0, order, t, [3.0, 2.0, 1.0]) for order in (0, 1) for t in (0, 1)],
        "run_id string, step int, event_order int, token_index int, scores array<float>",
    )
    event = ["run_id", "step", "event_order"]
    summary = routing.summarize(routing.route_tokens(scores, [*event, "token_index"], selected=2), event)
    assert sorted((r["event_order"], r["tokens_routed"]) for r in summary.collect()) == [(0, 2), (1, 2)]


@pytest.mark.parametrize("cuts", [[0, 7], [0, 1, 2, 3, 4, 5, 6, 7], [0, 3, 7]])
def test_canvas_state_equals_the_batch_form_for_any_cut(spark, cuts):
    rows = [
        (0, 1, [9, 9], [True, False]), (1, 0, [1, 2], [False, False]), (2, 1, [1, 3], [True, True]),
        (3, 2, [1, 3, 5], [False, True, True]), (4, 3, [2], [True]), (5, 0, [2], [False]), (6, 1, [2, 4], [False, True]),
    ]
    schema = "global_step int, step_index int, canvas array<int>, accepted_index array<boolean>"
    steps = spark.createDataFrame(rows, schema).withColumn("run_id", F.lit("r"))
    batch = canvas.canvas_changes(steps)
    want = {r["global_step"]: (r["canvas_index"], r["changed_positions"], r["accepted_positions"]) for r in batch.collect()}

    class Held:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, found = Held(), {}
    frame = pd.DataFrame(rows, columns=["global_step", "step_index", "canvas", "accepted_index"])
    for low, high in itertools.pairwise(cuts):
        part = frame.iloc[low:high].sample(frac=1, random_state=1)
        for made in stateful.canvas_changes_of_run(("r",), iter([part]), state):
            for r in made.itertuples():
                found[r.global_step] = (r.canvas_index, r.changed_positions, r.accepted_positions)
    assert found == want
    with pytest.raises(ValueError, match="run r: step 6 came after step 6"):
        list(stateful.canvas_changes_of_run(("r",), iter([frame.iloc[6:]]), state))


def test_records_carry_the_whole_context_and_lose_no_row(spark):
    known = spark.createDataFrame([("a", "m")], "run_id string, model_id string")
    for field in CONTEXT_SCHEMA:
        if field.name not in known.columns:
            known = known.withColumn(field.name, F.lit(None).cast(field.dataType))
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("lost", 3, "z")], "run_id string, step int, tag string")
    records = runs.with_context(rows, known, "seen")
    assert records.columns == ["event", *CONTEXT_SCHEMA.names, "step"]
    assert sorted((r["run_id"], r["model_id"], r["step"]) for r in records.collect()) == [
        ("a", "m", 1), ("a", "m", 2), ("lost", None, 3),
    ]


@pytest.mark.parametrize("steps", [1, 3, 4096])
def test_canvas_changes_for_any_chunk(spark, steps):
    rows = [
        ("a", 0, 1, [9, 9]), ("a", 1, 0, [1, 2]), ("a", 2, 1, [1, 3]), ("a", 3, 2, [1, 3]),
        ("a", 4, 0, [1, 3]), ("a", 5, 1, [2, 4]), ("b", 0, 0, [1, 3]),
    ]
    df = spark.createDataFrame(
        [(*r, [True, False]) for r in rows],
        "run_id string, global_step int, step_index int, canvas array<int>, accepted_index array<boolean>",
    )
    made = canvas.canvas_changes(df, chunk_of("global_step", steps))
    found = {(r["run_id"], r["global_step"]): (r["canvas_index"], r["changed_positions"]) for r in made.collect()}
    assert found == {
        ("a", 0): (-1, [0, 1]), ("a", 1): (0, [0, 1]), ("a", 2): (0, [1]), ("a", 3): (0, []),
        ("a", 4): (1, [0, 1]), ("a", 5): (1, [0, 1]), ("b", 0): (0, [0, 1]),
    }
    assert all(r["accepted_positions"] == [0] for r in made.collect())


def test_breaker_keeps_rows_before_the_first_failure_only(spark):
    status = spark.createDataFrame(
        [
            ("m", "logits", 0, True), ("m", "canvas", 0, False), ("m", "logits", 1, False),
            ("m", "canvas", 1, False), ("m", "scheduler_trace", 2, True), ("m", "canvas", 2, False),
            ("m", "moe", 1, False), ("m", "moe", 3, False), ("other", "logits", 5, False),
        ],
        "model_run string, component string, ord int, failed boolean",
    )
    kept = audit.rows_before_failure(status, "model_run", "ord").collect()
    assert sorted((r["model_run"], r["component"], r["ord"]) for r in kept) == [
        ("m", "canvas", 0), ("m", "canvas", 1), ("m", "moe", 1), ("other", "logits", 5),
    ]
    telemetry = spark.createDataFrame(
        [("m", "logits", 0), ("m", "canvas", 1), ("new", "moe", 9)], "model_run string, component string, ord int"
    )
    written = audit.rows_before_failure(status, "model_run", "ord", telemetry).collect()
    assert sorted((r["model_run"], r["component"], r["ord"]) for r in written) == [
        ("m", "canvas", 1), ("new", "moe", 9),
    ]
