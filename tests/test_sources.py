"""Snapshots, resumed inference, and line numbers of rejects."""

from __future__ import annotations

import sys
from datetime import UTC, datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from evalweave.operators import inference, resume
from evalweave.sources import jsonl, snapshots
from evalweave.streaming import stateful

# The workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_revisions_share_files_and_stay_readable(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(ValueError, match="no revision"):
        snapshots.read(spark, path)
    assert snapshots.commit(spark.range(3), path) == 1
    assert snapshots.commit(spark.range(10, 12), path) == 2
    snapshots.tag(spark, path, "first", 1)
    snapshots.tag(spark, path, "pinned")
    between = datetime.now(UTC)
    assert snapshots.commit(spark.range(20, 21), path) == 5
    assert snapshots.commit(spark.range(90, 91), path, replace=True) == 6
    want = {"first": [0, 1, 2], "pinned": [0, 1, 2, 10, 11], 1: [0, 1, 2], 5: [0, 1, 2, 10, 11, 20], between: [0, 1, 2, 10, 11], None: [90]}
    for revision, rows in want.items():
        assert ids(snapshots.read(spark, path, revision)) == rows
    shared = set(snapshots.folders(spark, path, "pinned"))
    assert shared < set(snapshots.folders(spark, path, 5)) and not shared & set(snapshots.folders(spark, path))
    assert [(e["operation"], e["rows"]) for e in snapshots.history(spark, path)][-2:] == [("append", 1), ("replace", 1)]
    snapshots.tag(spark, path, "pinned", 5)
    assert snapshots.resolve(spark, path, "pinned") == 5
    for unknown in ("other", 3, 99, datetime(2000, 1, 1, tzinfo=UTC)):
        with pytest.raises(ValueError, match="no revision"):
            snapshots.read(spark, path, unknown)


def test_of_two_commits_on_one_version_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "table")
    base = snapshots.commit(spark.range(1), path)
    snapshots.commit(spark.range(1, 2), path, base=base)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark.range(2, 3), path, base=base)
    assert ids(snapshots.read(spark, path)) == [0, 1]


SCHEMA = "run_id string, prompt string, seed long"


def engine(bad: str | None):
    """Fails at one prompt, as a machine that dies there would."""

    def factory():
        def predict(prompts, seeds):
            if bad in prompts:
                raise RuntimeError("machine lost")
            return [inference.Prediction(p.upper(), [1]) for p in prompts]

        return predict

    return factory


def test_a_stopped_inference_goes_on_and_makes_nothing_twice(spark, tmp_path):
    path, source = str(tmp_path / "job"), str(tmp_path / "runs")
    rows = [(f"r{n:02d}", f"p{n}", n) for n in range(12)]
    for at in range(0, 12, 3):
        spark.createDataFrame(rows[at : at + 3], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def stream():
        return stateful.read_folder(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)

    with pytest.raises(Exception, match="machine lost"):
        resume.resumable_infer(stream(), engine("p7"), path, name="e", batch_size=2)
    before = {r["run_id"] for r in spark.read.parquet(f"{path}/outputs").collect()}
    assert before == {f"r{n:02d}" for n in range(6)}
    # The same runs once more in another file, one of them twice.
    again = [*rows[4:8], rows[5], ("new", "pn", 1)]
    spark.createDataFrame(again, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    done = resume.resumable_infer(stream(), engine(None), path, name="e", batch_size=2).collect()
    assert sorted((r["run_id"], r["final_text"]) for r in done) == sorted([(r[0], r[1].upper()) for r in rows] + [("new", "PN")])
    # A lost checkpoint costs a look at what is there, and no result.
    batch = spark.createDataFrame(rows, SCHEMA)
    resume.infer_batch(batch, 99, engine("p3"), path, name="e")
    assert spark.read.parquet(f"{path}/outputs").count() == 13


def test_rejects_are_numbered_in_one_scan_of_any_blocks(spark, tmp_path):
    lines = {}
    for name, count in (("a", 400), ("b", 3), ("c", 0)):
        own = [("[1]" if n % 7 == 3 else '{"x": ' if n % 11 == 5 else "" if n % 5 == 0 else f'{{"x": {n}, "pad": "{"y" * (n % 40)}"}}') for n in range(count)]
        (tmp_path / f"{name}.jsonl").write_text("".join(line + "\n" for line in own))
        lines[name] = own
    want = sorted((f"{n}.jsonl", at, v) for n, own in lines.items() for at, v in enumerate(own, 1) if v in ("[1]", '{"x": '))
    for size, batch in (("128MB", 10_000), ("1KB", 7)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        try:
            found = jsonl.rejects(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted((r["path"], r["line_number"], r["line"]) for r in found) == want
        assert {r["reason"] for r in found} == {"broken", "not_object"}


def test_compressed_lines_hold_the_same_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 5000), (2, None)], "n long, t string")
    sizes = []
    for kind in ("none", "gzip"):
        assert jsonl.write_json(df, str(tmp_path / kind), compression=kind) == 2
        assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / kind)).collect())) == [(1, "a" * 5000), (2, None)]
        sizes.append(sum(f.stat().st_size for f in (tmp_path / kind).glob("part-*")))
    assert 10 * sizes[1] < sizes[0]
