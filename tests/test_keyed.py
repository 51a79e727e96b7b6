"""State that maps, timers and files keep while rows stream in."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalweave.operators import canvas
from evalweave.operators.audit import COMPONENTS, rows_before_failure
from evalweave.plans import stream_queries
from evalweave.session import stage
from evalweave.streaming import keyed, ledger, stateful


def arriving(spark, tmp_path, schema, waves):
    """A stream of one micro-batch per wave."""
    path = str(tmp_path / "in")
    for rows in waves:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return stateful.read_folder(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


def run(stream, tmp_path):
    """All rows of the stream, and the number of state rows after every micro-batch."""
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
    with stateful.drained(stream.sparkSession):
        query = writer.start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")), sizes


ROUTES = "run_id string, canvas_index int, layer_index int, token_index int, global_step int, event_order int, expert_ids array<int>"


def test_route_overlap_keeps_the_canvas_under_way_only(spark, tmp_path):
    picks = random.Random(1)
    rows = [
        ("r", step // 3, layer, token, step, order, picks.sample(range(6), picks.randint(1, 3)))
        for step in range(9) for order in range(2) for layer in range(2) for token in range(4) if picks.random() < 0.8
    ]
    waves = [[r for r in rows if r[4] in steps] for steps in ((0, 1), (2, 3), (4,), (5, 6, 7, 8))]
    for wave in waves:
        picks.shuffle(wave)
    found, sizes = run(keyed.route_overlap_stream(arriving(spark, tmp_path, ROUTES, waves)), tmp_path)
    want, before = [], {}
    for r in sorted(rows, key=lambda r: (r[4], r[5])):
        now, (step, order, past) = set(r[6]), before.get(r[:4], (None, None, None))
        overlap = None if past is None else len(now & past) / len(now | past)
        want.append((*r[:6], len(now), step, order, None if past is None else len(past), overlap))
        before[r[:4]] = (r[4], r[5], now)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    # Per layer one packed canvas, the last place, and the timer, however many canvases there were.
    assert len(set(sizes)) == 1


def test_silent_runs_lose_their_state(spark, tmp_path):
    rows = [[(f"r{wave}-{n}", 0, 0, 0, 0, 0, [1]) for n in range(20)] for wave in range(3)]
    rows.append([("last", 0, 0, 0, 0, 0, [1])])
    (tmp_path / "long").mkdir()
    _, kept = run(keyed.route_overlap_stream(arriving(spark, tmp_path / "long", ROUTES, rows)), tmp_path / "long")
    assert kept == sorted(kept) and kept[-1] > 2.5 * kept[0]
    _, sizes = run(keyed.route_overlap_stream(arriving(spark, tmp_path, ROUTES, rows), idle_ms=1), tmp_path)
    assert max(sizes) <= kept[0] and sizes[-1] < sizes[0] / 4


STEPS = "run_id string, global_step int, step_index int, canvas array<int>, accepted_index array<boolean>"


def test_canvases_of_many_runs_share_the_state_of_a_few_groups(spark, tmp_path):
    def step(run, n):
        cells = [None if i == 0 and n % 4 else (run * n + i) % 3 for i in range(1 + (run + n) % 3)]
        return (f"r{run}" if run else None, n, (n - 1) % (2 + run % 4), cells, [c == 1 for c in cells])

    # Some runs come in every wave, some pause in the second, some begin in the third.
    waves = [[step(r, n) for r in range(40) for n in range(4 * w, 4 * w + 4) if (r + w) % 3 or w == 2] for w in range(3)]
    for wave in waves:
        wave.reverse()
    found, sizes = run(stateful.canvas_changes_stream(arriving(spark, tmp_path, STEPS, waves), 3), tmp_path)
    assert sizes == [3, 3, 3]
    rows = spark.createDataFrame([r for wave in waves for r in wave], STEPS).na.fill({"run_id": "none"})
    names = ["run_id", "global_step", "step_index", "canvas_index", "changed_positions", "accepted_positions"]
    want = canvas.canvas_changes(rows).select(names).collect()
    assert sorted(found.na.fill({"run_id": "none"}).select(names).collect()) == sorted(want)


def test_a_wave_is_written_by_as_many_tasks_as_asked_for(spark):
    rows = stage(spark.range(200).selectExpr("cast(id % 50 as string) AS run_id", "cast(id div 50 as int) AS step"), "rows")
    path = stream_queries._arriving(rows, "waves", "run_id", "step", 2, files=4)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("step") < 2, F.max("step") < 2).collect()
    assert sorted(tuple(f)[1:] for f in files) == [(False, False)] * 4 + [(True, True)] * 4
    assert stream_queries._files_of_a_wave(spark, path, 2) == 4


def test_a_late_route_stops_the_stream(spark, tmp_path):
    waves = [[("r", 0, 0, 0, step, 0, [1])] for step in (5, 4)]
    with pytest.raises(Exception, match="came after step"):
        run(keyed.route_overlap_stream(arriving(spark, tmp_path, ROUTES, waves)), tmp_path)


def test_breaker_equals_the_batch_over_shuffled_batches(spark, tmp_path):
    picks = random.Random(4)
    rows = []
    for n in range(300):
        component = picks.choice([*COMPONENTS, "scheduler_trace"])
        chance = 0.002 if component == "scheduler_trace" else 0.01
        rows.append((f"m{picks.randint(0, 3)}", component, n, picks.random() < chance))
    rows += [("all", c, n, c == "scheduler_trace" and n == 5) for n in range(8) for c in [([*COMPONENTS] * 3)[n] if n != 5 else "scheduler_trace"]]
    waves = [[r for r in rows if low <= r[2] < low + 100] for low in (0, 100, 200)]
    for wave in waves:
        picks.shuffle(wave)
    found, _ = run(keyed.breaker_stream(arriving(spark, tmp_path, keyed.BREAKER, waves)), tmp_path)
    status = spark.createDataFrame(rows, keyed.BREAKER)
    want = rows_before_failure(status, "model_run", "ord").select("model_run", "component", "ord", "failed")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert 0 < want.count() < len(rows) and sum(r[3] for r in rows) > 1


PENDING = "run_id string, step int, event_order int, module_name string, kind string"


def test_pending_events_are_given_out_at_the_end_of_their_run(spark, tmp_path):
    def event(run_id, step, order=0):
        return (run_id, step, order, "m.router", "event")

    def callback(run_id, step):
        return (run_id, step, None, None, "step")

    waves = [
        [event("a", 0), event("a", 0, 1), callback("a", 0), event("a", 1), event("b", 0), callback("c", 0)],
        [event("a", 2), callback("a", 1), event("a", 1, 1), event("c", 0), event("c", 1)],
        [("a", 9, None, None, "end"), ("c", 9, None, None, "end"), ("d", 9, None, None, "end")],
    ]
    found, sizes = run(keyed.pending_events_stream(arriving(spark, tmp_path, PENDING, waves)), tmp_path)
    # "b" has not ended; the callback of a step counts before and after its events.
    assert sorted(map(tuple, found.collect())) == [("a", 2, 0, "m.router"), ("c", 1, 0, "m.router")]
    assert sizes[-1] < max(sizes)


def test_pending_events_of_a_silent_run_time_out(spark, tmp_path):
    waves = [[("b", 0, 0, "m.router", "event")], [("x", 0, None, None, "step")], [("y", 0, None, None, "step")]]
    found, _ = run(keyed.pending_events_stream(arriving(spark, tmp_path, PENDING, waves), idle_ms=1), tmp_path)
    assert [tuple(r) for r in found.collect()] == [("b", 0, 0, "m.router")]


def test_ledger_tells_repeats_with_their_first_place(spark, tmp_path):
    picks = random.Random(8)
    ids = [f"i{picks.randint(0, 400)}" if n % 3 else f"u{n}" for n in range(600)] + ["", None, "", "hot"] + ["hot"] * 50
    rows = [(i, n) for n, i in enumerate(ids)]
    first: dict[str, int] = {}
    want = [(i, n, first[i]) for i, n in rows if i and first.setdefault(i, n) != n]
    # A filter of 16 bytes knows everything before long: only more is read, nothing else changes.
    for size in (1 << 12, 16):
        own = ledger.Ledger(str(tmp_path / f"ledger-{size}"), buckets=4, filter_bytes=size)
        for batch, low in enumerate((0, 150, 400, 640)):
            part = [r for r in rows if low <= r[1] < (150, 400, 640, 10_000)[batch]]
            taken = spark.createDataFrame(part, "id string, place bigint").repartition(3)
            for _ in range(1 + (batch == 1)):  # a batch that is tried again changes nothing
                ledger.take_batch(taken, batch, own)
        assert sorted(map(tuple, ledger.rejects(spark, own).collect())) == sorted(want)
    known = spark.read.parquet(f"{own.path}/ids")
    assert known.count() == len(first) and known.groupBy("id").count().filter("count > 1").isEmpty()


def test_ledger_goes_on_where_it_stopped(spark, tmp_path):
    schema = "id string, place bigint"
    stream = arriving(spark, tmp_path, schema, [[("a", 0), ("b", 1)], [("a", 2)]])
    own = ledger.run_ledger(stream, ledger.Ledger(str(tmp_path / "ledger"), buckets=2, filter_bytes=64))
    assert [tuple(r) for r in ledger.rejects(spark, own).collect()] == [("a", 2, 0)]
    again = arriving(spark, tmp_path, schema, [[("b", 3), ("c", 4)]])
    ledger.run_ledger(again, own)
    assert sorted(map(tuple, ledger.rejects(spark, own).collect())) == [("a", 2, 0), ("b", 3, 1)]
    assert ledger.rejects(spark, ledger.Ledger(str(tmp_path / "none"))).agg(F.count("*")).first()[0] == 0


def test_one_row_of_every_key_over_all_batches(spark, tmp_path):
    waves = [[("a", 1), ("", 2), ("a", 3)], [("b", 4), (None, 5), ("", 6)], [("a", 7), (None, 8), ("c", 9)]]
    found, _ = run(stateful.first_rows_stream(arriving(spark, tmp_path, "id string, place int", waves), ["id"]), tmp_path)
    rows = {r["id"]: r["place"] for r in found.collect()}
    assert found.count() == 5 and rows.pop("a") in (1, 3)
    assert rows == {"": 2, "b": 4, None: 5, "c": 9}
