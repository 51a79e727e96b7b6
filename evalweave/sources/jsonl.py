"""JSON lines in and out."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.parsing import json_line_kind
from evalweave.session import stage


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the place of their block in it, and kind (``object``, ``not_object``, ``broken``)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("value").alias("line"),
    )
    return lines.withColumn("kind", json_line_kind("line"))


def read_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that hold a JSON object, under a declared schema. Rejects are ``rejects(...)``."""
    good = read_lines(spark, path).filter(F.col("kind") == "object")
    return good.select(F.from_json("line", schema).alias("o")).select("o.*")


PLACED = "path string, block bigint, number bigint, reason string, line string"


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor a JSON object, with file, line number and reason; one scan.

    A large file is read in blocks. As the lines of a block go by, only the bad ones and one row with
    the number of lines are kept. A line's number is its place in its block plus the lines of the
    blocks before. Good lines never leave the JVM.
    """
    lines = read_lines(spark, path)
    bad = F.col("kind").isin("broken", "not_object")
    narrow = lines.select("path", "_block", F.when(bad, F.col("kind")).alias("reason"), F.when(bad, F.col("line")).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            # Lines come block by block, in order.
            paths = batch.column(0).dictionary_encode()
            files = paths.indices.to_numpy()
            places = batch.column(1).to_numpy()
            cuts = np.append(np.flatnonzero((np.diff(files, prepend=-1) != 0) | (np.diff(places, prepend=-1) != 0)), len(files))
            number = np.zeros(len(files), np.int64)
            ended = []
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                here = (paths.dictionary[files[begin]].as_py(), int(places[begin]))
                if here != now:
                    if now is not None:
                        ended.append((*now, seen, None, None))
                    now, seen = here, 0
                number[begin:end] = np.arange(seen + 1, seen + 1 + end - begin)
                seen += end - begin
            kept = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
            columns = [c.take(pa.array(kept)) for c in (batch.column(0), batch.column(1), pa.array(number), *batch.columns[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)
            if ended:
                yield _rows(ended)
        if now is not None:
            yield _rows([(*now, seen, None, None)])

    placed = stage(narrow.mapInArrow(run, PLACED), "reject-lines")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.filter("reason is null").select("path", "block", F.coalesce(F.sum("number").over(earlier), F.lit(0)).alias("_before"))
    found = placed.filter("reason is not null").join(starts, ["path", "block"])
    return found.select("path", (F.col("_before") + F.col("number")).alias("line_number"), "reason", "line")


NAMES = [f.split()[0] for f in PLACED.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)


def require_objects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Like ``read_objects``, but the first reject is an error naming file and line."""
    bad = rejects(spark, path).orderBy("path", "line_number").limit(1).collect()
    if bad:
        raise ValueError(f"expected an object at {bad[0]['path']}:{bad[0]['line_number']}")
    return read_objects(spark, path, schema)


def write_json(
    df: DataFrame, path: str, *, mode: str = "errorifexists", keep_nulls: bool = True, compression: str = "none"
) -> int:
    """Write one object per line and return the row count, observed during the write itself.

    Readers take ``compression`` (``gzip``, say) from the file names; a compressed file is read by one task. The commit protocol makes the write all-or-nothing per task and job.
    """
    seen = Observation("written")
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = observed.write.mode(mode).option("ignoreNullFields", str(not keep_nulls).lower())
    writer.option("compression", compression).json(path)
    return int(seen.get["rows"])


def append_json(df: DataFrame, path: str, *, compression: str = "none") -> int:
    return write_json(df, path, mode="append", compression=compression)


def write_document(spark: SparkSession, path: str, columns: list, source: DataFrame | None = None) -> Any:
    """Write one nested JSON document (a one-row table) and return it as a DataFrame."""
    row = (source if source is not None else spark.range(1)).select(*columns)
    row.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    return row
