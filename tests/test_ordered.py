"""Ordered scans, numbering, percentiles and lookups: exact, and independent of the layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalweave.operators import ordered
from evalweave.operators.ordered import (
    chunk_of,
    dense_index,
    group_percentile,
    limit_ordered,
    number_rows,
    scan_in_order,
)
from evalweave.operators.skew import lookup_join


def runs_frame(seed: int = 0, rows: int = 900) -> pd.DataFrame:
    """One run holds a third of all rows; steps have gaps."""
    rng = np.random.default_rng(seed)
    run = np.where(rng.random(rows) < 0.34, "hot", rng.integers(0, 20, rows).astype(str))
    frame = pd.DataFrame({"run": run, "v": rng.integers(-5, 6, rows), "gap": rng.integers(1, 9, rows)})
    frame["step"] = frame.groupby("run")["gap"].cumsum()
    return frame.drop(columns="gap")


@pytest.mark.parametrize("chunk", [1, 7, 4096])
@pytest.mark.parametrize("parts", [1, 4, 17])
def test_scan_equals_a_window_for_any_chunk_and_layout(spark, chunk, parts):
    frame = runs_frame()
    df = spark.createDataFrame(frame).repartition(parts)
    got = scan_in_order(
        df,
        ["run"],
        ["step"],
        chunk_of("step", chunk),
        number="n",
        running={"total": ("sum", F.col("v")), "top": ("max", F.when(F.col("v") > 0, F.col("v")))},
        previous={"before": "v"},
    ).toPandas()
    ordered_frame = frame.sort_values(["run", "step"])
    grouped = ordered_frame.groupby("run")
    want = ordered_frame.assign(
        n=grouped.cumcount(),
        total=grouped["v"].cumsum(),
        top=ordered_frame["v"].where(ordered_frame["v"] > 0).groupby(ordered_frame["run"]).cummax(),
        before=grouped["v"].shift(),
    )
    want["top"] = want.groupby("run")["top"].ffill()
    got = got.sort_values(["run", "step"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True)[got.columns], check_dtype=False)


def test_previous_null_is_not_mistaken_for_no_previous(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 1, None), ("a", 2, 7), ("a", 3, 8)], "run string, step int, v int")
    looked = scan_in_order(df, ["run"], ["step"], chunk_of("step", 2), previous={"before": "v"})
    assert [r["before"] for r in looked.orderBy("step").collect()] == [None, 5, None, 7]


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_dense_index_is_dense_and_ordered(spark, parts):
    df = spark.range(0, 1000, 1, parts).select("id", (F.col("id") * 7919 % 1000).alias("k"))
    rows = dense_index(df, ["k"], "n").collect()
    assert sorted(r["n"] for r in rows) == list(range(1000))
    assert all(r["k"] == r["n"] for r in rows)


def test_number_rows_falls_back_when_the_key_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    rows = number_rows(df, ["v"], ["k"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in rows) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    unique = number_rows(df, [F.desc("v")], ["v"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in unique) == [(1, 3), (2, 2), (3, 1), (4, 0)]


@pytest.mark.parametrize("key", [None, ["id"]])
def test_a_large_limit_gives_the_same_rows_as_a_small_one(spark, monkeypatch, key):
    df = spark.range(0, 300, 1, 5).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"))
    small = {r["id"] for r in limit_ordered(df, ["k"], 40, key).collect()}
    monkeypatch.setattr(ordered, "SMALL_LIMIT", 10)
    assert {r["id"] for r in limit_ordered(df, ["k"], 40, key).collect()} == small
    assert limit_ordered(df, ["k"], None).count() == 300
    with pytest.raises(ValueError):
        limit_ordered(df, ["k"], 0)


@pytest.mark.parametrize("few", [4096, 20, 1])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_selected_percentile_equals_numpy(spark, q, few):
    """One group holds two thirds of the rows; ties, clusters far apart, one row, equal rows, nulls and NaN."""
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.choice(list("aab"), 500), "x": rng.normal(size=500).round(1)})
    wide = np.concatenate([rng.normal(size=60), 1e12 + rng.normal(size=60) * 1e-3, [-1e300, 1e300]])
    frame = pd.concat([frame, pd.DataFrame({"g": "wide", "x": wide}), pd.DataFrame({"g": "same", "x": [2.5] * 50})])
    frame = pd.concat([frame, pd.DataFrame({"g": ["solo", None, None], "x": [1.25, 3.0, 5.0]})])
    odd = spark.createDataFrame([("a", None), ("b", float("nan")), ("lost", None), ("lost", float("nan"))], "g string, x double")
    df = spark.createDataFrame(frame, "g string, x double").unionByName(odd)
    got = {r["g"]: r["p"] for r in group_percentile(df, ["g"], "x", q, "p", bins=4, few=few).collect()}
    want = {g: np.quantile(own["x"], q) for g, own in frame.groupby("g", dropna=False)}
    want = {None if pd.isna(g) else g: v for g, v in want.items()}
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g], rel=1e-12) for g in want)


def test_percentile_of_infinite_entries(spark):
    inf = float("inf")
    df = spark.createDataFrame([(float(x),) for x in [-inf, *range(50), inf, inf]], "x double")
    for few in (4096, 1):
        found = [group_percentile(df, [], "x", q, "p", bins=4, few=few).first()["p"] for q in (0.0, 0.5, 1.0)]
        assert found == [-inf, 25.0, inf]


def test_ties_under_a_unique_key_do_not_depend_on_the_path(spark, monkeypatch):
    rows = [(i, i % 3, "x" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, p int, w string")
    want = sorted(rows, key=lambda r: (r[1], r[0]))[:5]
    for small in (0, 100):
        monkeypatch.setattr(ordered, "SMALL_LIMIT", small)
        for parts in (1, 4, 7):
            got = limit_ordered(df.repartition(parts), ["p"], 5, ["id"]).collect()
            assert sorted(map(tuple, got)) == sorted(want)
            numbered = ordered.number_limited(df.repartition(parts), ["p"], 5, ["id"]).collect()
            assert sorted((r["row_index"], *r[:3]) for r in numbered) == [(n, *r) for n, r in enumerate(want)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_shuffled_lookup_equals_broadcast_on_a_hot_key(spark, how):
    frame = runs_frame()
    facts = spark.createDataFrame(frame).withColumn(
        "run", F.when(F.col("run") != "3", F.col("run"))
    )
    lookup = spark.createDataFrame([("hot", "\u4e2d"), ("1", "b"), ("2", "c")], "run string, w string")
    wide = lookup_join(facts, lookup, ["run"], how)
    assert "BroadcastHashJoin" in wide._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(str, wide.collect()))
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64",
    }
    for name, value in limits.items():
        spark.conf.set(name, value)
    try:
        shuffled = lookup_join(facts.repartition(8), lookup, ["run"], how)
        assert sorted(map(str, shuffled.collect())) == rows
        plan = shuffled._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in limits:
            spark.conf.unset(name)
    assert "BroadcastHashJoin" not in plan
    with pytest.raises(ValueError):
        lookup_join(facts, lookup, ["run"], "right")


@pytest.mark.parametrize("limit", [1, 2, 3, 5])
def test_limit_keeps_the_same_rows_for_any_layout_and_path(spark, monkeypatch, limit):
    rows = [("a", "1"), ("b", "3"), ("b", "1"), ("b", "2"), ("b", "2"), ("", "x"), ("", "w"), (None, "z")]
    df = spark.createDataFrame(rows, "id string, text string")
    seen = set()
    for parts in (1, 4, 17):
        for small in (0, 100):
            monkeypatch.setattr(ordered, "SMALL_LIMIT", small)
            kept = ordered.limit_ordered(df.repartition(parts), ["id"], limit, ["id"]).collect()
            seen.add(tuple(sorted(map(str, kept))))
            numbered = ordered.number_rows(df.repartition(parts), ["id"], ["id"]).collect()
            assert sorted(r["row_index"] for r in numbered) == list(range(len(rows)))
            first = tuple(sorted(str((r["id"], r["text"])) for r in numbered if r["row_index"] < limit))
            assert first == tuple(sorted(str((r["id"], r["text"])) for r in kept))
    assert len(seen) == 1
