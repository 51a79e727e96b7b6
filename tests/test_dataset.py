"""Filters, manifest rules, batches."""

from __future__ import annotations

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evalweave.operators import dataset as ds
from evalweave.operators import ordered
from evalweave.schemas import EXAMPLE_COLUMNS, EXAMPLE_SCHEMA, MANIFEST_SCHEMA


def example(**values):
    return tuple(values.get(c) for c in EXAMPLE_COLUMNS)


def frame(spark, *rows):
    return spark.createDataFrame([example(**r) for r in rows], EXAMPLE_SCHEMA)


def good(n, **more):
    return {"id": f"e{n:03d}", "prompt": f"p{n}", **more}


def test_missing_columns_are_named_in_order(spark):
    df = frame(spark, good(1))
    assert ds.missing_columns(df.columns) == []
    with pytest.raises(ValueError, match="missing columns: language, tag"):
        ds.require_columns(df.drop("tag", "language"))
    ds.require_columns(df.withColumn("extra", F.lit(1)))


def test_filters_look_at_raw_values(spark):
    df = frame(
        spark, good(1, language="en"), good(2, language=" en "), good(3), good(4, language="None")
    )

    def kept(**filters):
        return sorted(r["id"] for r in ds.filter_examples(df, ds.ManifestSpec(**filters).filters()).collect())

    assert kept() == kept(languages=[]) == ["e001", "e002", "e003", "e004"]
    assert kept(languages="en") == ["e001"]
    assert kept(languages=["None"]) == ["e003", "e004"]
    assert kept(languages=[""]) == []
    assert kept(languages=["en", " en "], sources=["x"]) == []


def test_an_absent_column_compares_as_empty_text(spark):
    df = frame(spark, good(1)).drop("tag")
    assert ds.filter_examples(df, {"tag": [""]}).count() == 1
    assert ds.filter_examples(df, {"tag": ["x"]}).count() == 0


def test_filter_reaches_the_reader(spark, tmp_path):
    frame(spark, good(1, language="en"), good(2)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = ds.filter_examples(df, {"language": ["en", "None"]})._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(IsNull(language),In(language, [None,en]))]" in plan or (
        "PushedFilters: [Or(IsNull(language),In(language, [en,None]))]" in plan
    )


def test_manifest_has_exactly_its_columns_and_dense_numbers(spark):
    df = frame(spark, *[good(n, prompt=f" p{n} ") for n in range(50)]).withColumn("extra", F.lit(1))
    made = ds.build_manifest(df.repartition(7), ds.ManifestSpec())
    assert made.columns == MANIFEST_SCHEMA.names
    rows = sorted(made.collect(), key=lambda r: r["row_index"])
    assert [(r["row_index"], r["id"], r["prompt"]) for r in rows] == [
        (n, f"e{n:03d}", f"p{n}") for n in range(50)
    ]


@pytest.mark.parametrize("shuffle", [False, True])
def test_manifest_does_not_depend_on_the_layout_or_the_limit_path(spark, monkeypatch, shuffle):
    df = frame(spark, *[good(n) for n in range(120)])
    spec = ds.ManifestSpec(shuffle=shuffle, seed=9, max_samples=30)
    seen, facts = [], set()
    for parts, small in ((1, 100), (4, 100), (17, 100), (4, 10)):
        monkeypatch.setattr(ordered, "SMALL_LIMIT", small)
        made = ds.build_manifest(df.repartition(parts), spec)
        seen.append(sorted(map(tuple, made.collect())))
        facts.add(tuple(ds.manifest_facts(made)))
    assert len(facts) == 1
    assert all(s == seen[0] for s in seen) and len(seen[0]) == 30
    other = ds.number_examples(df, ds.ManifestSpec(shuffle=True, seed=10, max_samples=30))
    assert sorted(map(tuple, other.collect())) != seen[0]


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        ([good(1), {"id": "  ", "prompt": "x"}], "row 0 \\(''\\): empty_id"),
        ([good(1), good(1, prompt="again")], "row 1 \\('e001'\\): duplicate_id"),
        ([good(1), good(2, prompt=" ")], "row 1 \\('e002'\\): empty_prompt"),
        ([good(1), good(1, prompt="")], "row 0|row 1"),
    ],
)
def test_the_first_bad_row_decides(spark, rows, message):
    spec = ds.ManifestSpec(order_by=("id", "prompt"))
    with pytest.raises(ValueError, match=message):
        ds.build_manifest(frame(spark, *rows), spec)


def test_rows_beyond_the_limit_are_not_checked(spark):
    df = frame(spark, good(1), good(2), good(3, prompt=""))
    assert ds.build_manifest(df, ds.ManifestSpec(max_samples=2)).count() == 2


def test_violations_of_a_hot_id(spark):
    rows = [good(n, id="same" if n % 3 == 0 else f"e{n}") for n in range(60)]
    df = frame(spark, *rows).withColumn("position", F.regexp_extract("prompt", r"\d+", 0).cast("int"))
    found = ds.violations(ds.number_examples(df, ds.ManifestSpec(order_by=("position",)))).collect()
    assert sorted(r["row_index"] for r in found) == list(range(3, 60, 3))
    assert {r["rule"] for r in found} == {"duplicate_id"}


def test_collate_keeps_raw_text_and_identity(spark):
    row = example(id="example-1", prompt="hello", response="world", source="source-a", language="en")
    df = spark.createDataFrame([(*row, 4, "abc")], MANIFEST_SCHEMA)
    batch = ds.collate(df, 1).first()
    assert batch["prompts"] == ["hello"] and batch["reference_responses"] == ["world"]
    assert batch["metadata"][0]["row_index"] == 4
    assert batch["metadata"][0]["prompt_sha256"] == "abc"
    assert "prompt" not in batch["metadata"][0].asDict()


def test_batches_keep_order_and_the_short_last_one(spark):
    numbered = ds.number_examples(frame(spark, *[good(n) for n in range(10)]), ds.ManifestSpec())
    batches = ds.collate(numbered, 4).orderBy("batch_id").collect()
    assert [b["prompts"] for b in batches] == [
        ["p0", "p1", "p2", "p3"], ["p4", "p5", "p6", "p7"], ["p8", "p9"],
    ]
    assert ds.first_batches(numbered, 4, 2).count() == 8
    assert ds.first_batches(numbered, 4, None).count() == 10
    flat = ds.iterate_examples(ds.collate(numbered, 4)).collect()
    assert sorted(r["prompt"] for r in flat) == sorted(f"p{n}" for n in range(10))


def test_uneven_batches_are_an_error(spark):
    batches = ds.collate(ds.number_examples(frame(spark, good(1), good(2)), ds.ManifestSpec()), 2)
    uneven = batches.withColumn("reference_responses", F.slice("reference_responses", 1, 1))
    with pytest.raises(PySparkException):
        ds.iterate_examples(uneven).collect()


def test_specs_refuse_bad_numbers():
    with pytest.raises(ValueError):
        ds.ManifestSpec(max_samples=0)
    assert [ds.allowed_values(v) for v in ("en", None, [1], [], "")] == [["en"], [], ["1"], [], [""]]


def test_metadata_of_absent_columns_is_null_of_the_declared_type(spark):
    made = ds.metadata(frame(spark, good(1)).drop("tag", "reconstruction_id_if_redacted"))
    assert made.first()["tag"] is None
    assert dict(made.dtypes)["tag"] == "string"
    assert dict(made.dtypes)["reconstruction_id_if_redacted"] == "double"
