"""The buffered shuffle and the collate hook next to plain loops."""

from __future__ import annotations

import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalweave.operators import dataset as ds
from evalweave.operators import lazy

MASK = (1 << 64) - 1


def draw(key: int, place: int) -> int:
    x = (key + place * lazy.STEP) & MASK
    x = ((x ^ (x >> 30)) * lazy.FACTOR_1) & MASK
    x = ((x ^ (x >> 27)) * lazy.FACTOR_2) & MASK
    return x ^ (x >> 31)


def plain_shuffle(shards: dict[str, list[int]], seed: int, size: int) -> list[int]:
    out = []
    keys = {s: int(hashlib.md5(f"{seed}:{s}".encode()).hexdigest()[:15], 16) for s in shards}
    for shard in sorted(shards, key=keys.get):
        held: list[tuple[int, int]] = []
        for place, row in enumerate(shards[shard]):
            if len(held) < size:
                held.append((place, row))
                continue
            slot = draw(keys[shard], place) % size
            out.append(held[slot][1])
            held[slot] = (place, row)
        out += [row for _, row in sorted(held, key=lambda h: draw(keys[shard], h[0] + lazy.LEFT))]
    return out


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
@pytest.mark.parametrize("batch", [3, 64, 10_000])
def test_buffered_shuffle_equals_a_plain_loop(spark, size, batch):
    lengths = {"a": 300, "b": 1, "c": 99, "d": 100}
    shards, at = {}, 0
    for name, count in lengths.items():
        shards[name], at = list(range(at, at + count)), at + count
    rows = [(row, name, f"text {row}" if row % 5 else None) for name, own in shards.items() for row in own]
    df = spark.createDataFrame(rows, "id int, `sh.ard` string, text string").withColumnRenamed("sh.ard", "shard").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        # One shard of a task after the other, or each in a task of its own.
        for laid in (df, df.repartition(4, "shard").sortWithinPartitions("shard", "id")):
            got = lazy.buffered_shuffle(laid, ["shard"], seed=5, buffer=size).collect()
            ordered = sorted(got, key=lambda r: (r["shuffle_shard"], r["shuffle_place"]))
            assert [r["id"] for r in ordered] == plain_shuffle(shards, 5, size)
            assert all(r["text"] == (f"text {r['id']}" if r["id"] % 5 else None) for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_buffer_never_holds_more_than_its_size():
    import pyarrow as pa

    buffer = lazy.Buffer(9, 10, pa.schema([("v", pa.int64())]))
    sent = 0
    for at in range(0, 1000, 37):
        for out in buffer.push(pa.table({"v": np.arange(at, min(at + 37, 1000))})):
            sent += len(out)
            assert len(out) <= 10
        assert len(buffer.held) <= 10 and sent + len(buffer.held) == buffer.seen
    assert sent + len(buffer.rest()) == 1000


def test_shuffle_of_an_empty_table_and_bad_arguments(spark):
    none = spark.createDataFrame([], "id int, shard string")
    assert lazy.buffered_shuffle(none, ["shard"], seed=1).count() == 0
    with pytest.raises(ValueError):
        lazy.buffered_shuffle(none, ["shard"], seed=1, buffer=0)
    with pytest.raises(ValueError, match="shards"):
        ds.ManifestSpec(streaming=True, shuffle=True)


def test_a_streamed_manifest_takes_the_buffered_order(spark):
    rows = [(f"e{i:03d}", f"prompt {i}", "ab"[i // 60], i) for i in range(120)]
    columns = [F.lit(None).cast("string").alias(c) for c in ds.EXAMPLE_COLUMNS if c not in ("id", "prompt", ds.FLOAT_COLUMN)]
    df = spark.createDataFrame(rows, "id string, prompt string, shard string, position int").coalesce(1)
    df = df.select("*", *columns, F.lit(None).cast("double").alias(ds.FLOAT_COLUMN))
    spec = ds.ManifestSpec(order_by=("position",), streaming=True, shuffle=True, shards=("shard",), shuffle_buffer=20, seed=3)
    want = plain_shuffle({"a": list(range(60)), "b": list(range(60, 120))}, 3, 20)
    for most in (None, 50):
        got = ds.number_examples(df, replace(spec, max_samples=most)).collect()
        assert {r["row_index"]: r["id"] for r in got} == {n: f"e{i:03d}" for n, i in enumerate(want[: most or 120])}


@pytest.mark.parametrize("tied", [False, True])
def test_a_streamed_manifest_needs_no_layout(spark, tied):
    """Shards that several tasks read, in any order; a shard's rows enter by ``order_by``."""
    rows = [(f"e{i:03d}", f"prompt {i}", "ab"[i // 60], i // 2 * 2 if tied else i) for i in range(120)]
    columns = [F.lit(None).cast("string").alias(c) for c in ds.EXAMPLE_COLUMNS if c not in ("id", "prompt", ds.FLOAT_COLUMN)]
    df = spark.createDataFrame(rows, "id string, prompt string, shard string, position int")
    df = df.select("*", *columns, F.lit(None).cast("double").alias(ds.FLOAT_COLUMN))
    spec = ds.ManifestSpec(order_by=("position",), streaming=True, shuffle=True, shards=("shard",), shuffle_buffer=20, seed=3)
    found = [{r["row_index"]: r["id"] for r in ds.number_examples(df.repartition(n, F.hash("id")), spec).collect()} for n in (5, 3)]
    assert found[0] == found[1] and sorted(found[0].values()) == [r[0] for r in rows]
    if not tied:
        want = plain_shuffle({"a": list(range(60)), "b": list(range(60, 120))}, 3, 20)
        assert found[0] == {n: f"e{i:03d}" for n, i in enumerate(want)}


def joiner():
    """A function made in a call goes to the workers by value; this module is not there."""
    return lambda rows: {"ids": [r["row_index"] for r in rows], "text": "|".join(r["p"] or "-" for r in rows)}


@pytest.mark.parametrize("size", [1, 4, 1000])
@pytest.mark.parametrize("batch", [2, 10_000])
def test_collate_hook_gets_whole_batches_in_order(spark, size, batch):
    rows = [(i, None if i % 6 == 0 else f"p{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "row_index long, p string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = ds.collate_with(df, size, joiner(), "ids array<long>, text string", per_row=["ids"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = [rows[at : at + size] for at in range(0, 50, size)]
    want = [(n, [r[0] for r in part], "|".join(r[1] or "-" for r in part)) for n, part in enumerate(parts)]
    assert sorted(map(tuple, got)) == want


def test_collate_hook_refuses_wrong_counts_and_fields(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6)], "row_index long, p string")
    schema = "ids array<long>, text string"
    with pytest.raises(PySparkException, match="not one entry for each of 4 rows"):
        ds.collate_with(df, 4, lambda rows: {"ids": [1], "text": ""}, schema, per_row=["ids"]).collect()
    with pytest.raises(PySparkException, match="not one entry"):
        ds.collate_with(df, 4, lambda rows: {"ids": None, "text": ""}, schema, per_row=["ids"]).collect()
    with pytest.raises(PySparkException, match="the function returned"):
        ds.collate_with(df, 4, lambda rows: {"ids": []}, schema).collect()
    with pytest.raises(ValueError, match="not in the schema"):
        ds.collate_with(df, 4, joiner(), schema, per_row=["other"])
    assert ds.collate_with(df.limit(0), 4, joiner(), schema).count() == 0
