"""Cleaning, hashing, naming and parsing against plain Python."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalweave.functions import parsing
from evalweave.functions import text as tx
from evalweave.operators import runs
from evalweave.sources import tables


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    rows = column(spark, values, kind).select("i", expression(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


def test_strip_equals_python_for_every_white_space_character(spark):
    everything = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert set(everything) == set(tx.WHITESPACE)
    values = [f"{c}a{c}b{c}" for c in everything] + [None, "", "   ", "plain", "​kept​"]
    expected = ["" if v is None else v.strip() for v in values]
    assert apply(spark, values, tx.clean_text) == expected


def test_clean_text_of_a_float_nan_is_empty(spark):
    got = apply(spark, [float("nan"), None, 1.5], lambda c: tx.clean_text(c, is_float=True), "double")
    assert got == ["", "", "1.5"]


NUMBERS = [
    "1", " 2 ", "1.5", "-1.5", "+3", ".5", "5.", "1e3", "1E-3", "inf", "-inf", "Infinity", "nan",
    "NaN", "1.5d", "1.5f", "abc", "", "  ", "0x10", "1e", "--1", "1 2", None, " 7　",
]


def test_clean_float_equals_python(spark):
    def python(value):
        try:
            number = float(value)
        except (TypeError, ValueError):
            return None
        return None if math.isnan(number) else number

    assert apply(spark, NUMBERS, tx.clean_float) == [python(v) for v in NUMBERS]


def test_seed_and_hash_equal_python(spark):
    ids = ["example-1", "", "é中", "0"]

    def seed(value):
        return int.from_bytes(hashlib.sha256(f"42:{value}".encode()).digest()[:8], "big") % 2**31

    assert apply(spark, ids, lambda c: tx.example_seed(42, c)) == [seed(v) for v in ids]
    assert apply(spark, ids, tx.prompt_hash) == [hashlib.sha256(v.encode()).hexdigest() for v in ids]


def test_model_names(spark):
    names = ["org/diffusion-26b", "org/base-26b", "Org/DIFFUSION-Model", "bare"]
    assert apply(spark, names, tx.model_kind) == ["diffusion", "autoregressive", "diffusion", "autoregressive"]
    own = apply(spark, names, lambda c: tx.model_kind(c, diffusion="d", default="a"))
    assert own == ["d", "a", "d", "a"]
    assert apply(spark, names, tx.model_subdir) == ["diffusion-26b", "base-26b", "DIFFUSION-Model", "bare"]


def test_router_names(spark):
    names = ["model.layers.12.router", "layers.3.router", "xlayers.3.router", "layers.3.router.x", "a.router"]
    assert apply(spark, names, tx.router_layer) == [12, 3, None, None, None]
    assert apply(spark, names, tx.is_router) == [True, True, True, False, True]
    with pytest.raises(PySparkException):
        apply(spark, names, lambda c: tx.router_layer(c, strict=True))


def test_experiment_ids(spark):
    values = ["ok-1_2.3", "", "a b", "x\n", "é"]
    assert apply(spark, values, tx.valid_experiment_id) == [True, False, False, False, False]
    assert tables.experiment_id("ok-1") == "ok-1"
    assert len(tables.experiment_id()) == 25
    for bad in values[2:]:
        with pytest.raises(ValueError):
            tables.experiment_id(bad)


RAW = [
    ('{"response": "a"}', "a"),
    ('{"response": 5, "content": "b"}', "b"),
    ('{"response": "", "content": "b"}', ""),
    ('{"final_answer": "c", "text": "d"}', "c"),
    ('{"text": "d"}', "d"),
    ('{"text": null}', '{"text": null}'),
    ('{"other": "x"}', '{"other": "x"}'),
    ('"a string"', "a string"),
    ("[1, 2]", "[1, 2]"),
    ("raw answer", "raw answer"),
    ("{broken", "{broken"),
    (None, None),
]


def test_parse_response(spark):
    rows = column(spark, [raw for raw, _ in RAW]).select("i", parsing.parse_response("v").alias("r"))
    assert [r["r"] for r in sorted(rows.collect())] == [want for _, want in RAW]


def test_scalar_entries_keep_nulls_and_drop_nested_values(spark):
    df = spark.createDataFrame(
        [(1, '{"a": 1, "b": "x", "c": null, "d": [1], "e": {"f": 1}, "g": true, "h": 0.5}')], "id int, c string"
    )
    got = {r["key"]: r["value"] for r in parsing.scalar_entries(df, "c", ["id"]).collect()}
    assert got == {"a": "1", "b": '"x"', "c": "null", "g": "true", "h": "0.5"}


def test_prompt_is_dropped_from_sequences(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], 1, 4), ([1, 2, 3, 4], 3, 2), ([1], 5, 0)], "s array<int>, n int, g int")
    rows = df.select(
        runs.drop_prompt(F.col("s"), F.col("n")).alias("ar"),
        runs.drop_prompt_if_longer(F.col("s"), F.col("n"), F.col("g")).alias("canvas"),
    ).collect()
    assert [r["ar"] for r in rows] == [[2, 3, 4], [4], []]
    assert [r["canvas"] for r in rows] == [[1, 2, 3, 4], [4], []]


def test_a_template_without_a_thinking_slot_ignores_the_mark(spark):
    for template, want in (
        ("{thinking}[{prompt}]", "<t>[p]"),
        ("[{prompt}]", "[p]"),
    ):
        assert apply(spark, ["p"], lambda c, t=template: tx.render_single_turn(c, t, "<t>")) == [want]
    with pytest.raises(ValueError):
        tx.render_single_turn(F.lit("p"), "no slot")
