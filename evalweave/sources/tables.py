"""Tables and run folders."""

from __future__ import annotations

import platform
import re
import uuid
from datetime import UTC, datetime

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalweave.functions.text import EXPERIMENT_ID_PATTERN, canvas_key, token_key
from evalweave.schemas import MANIFEST_SCHEMA, SCHEMA_VERSION

LOGIT_BUCKETS = 256


def scan(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | None = None,
    file_format: str = "parquet",
    split: str | None = None,
    revision: str | None = None,
) -> DataFrame:
    """Lazily read one split of a dataset at a pinned revision.

    A revision and a split are folders below ``path``; revisions that share files are ``snapshots``.
    JSON always needs a declared schema.
    """
    if file_format != "parquet" and schema is None:
        raise ValueError("a declared schema is needed for this format")
    parts = [path.rstrip("/"), *[p for p in (revision, split) if p]]
    reader = spark.read.format(file_format)
    return (reader.schema(schema) if schema is not None else reader).load("/".join(parts))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def experiment_id(configured: str | None = None) -> str:
    """The configured id, checked, or a fresh time-stamped one."""
    stamp = datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    chosen = configured or f"{stamp}-{uuid.uuid4().hex[:8]}"
    if not re.fullmatch(EXPERIMENT_ID_PATTERN, chosen):
        raise ValueError("an experiment id may hold only letters, digits, dot, underscore, hyphen")
    return chosen


def require_unused(spark: SparkSession, path: str) -> None:
    """Raise if a folder already holds anything."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        used = not files.load(path).select("path").isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        used = False
    if used:
        raise FileExistsError(f"the run folder already exists and is not empty: {path}")


def claim_run_folder(spark: SparkSession, path: str, experiment: str) -> str:
    """Claim an unused ``path`` for one experiment.

    Of two jobs that try at the same time, the write below lets one pass.
    """
    require_unused(spark, path)
    claim = spark.range(1).select(F.lit(experiment).alias("experiment_id"))
    claim.write.mode("errorifexists").json(f"{path.rstrip('/')}/claim")
    return path


def experiment_manifest(
    experiment: str, dataset: list[Column], revisions: dict[str, str], config: dict[str, str]
) -> list[Column]:
    """The columns of the experiment document."""

    def texts(values: dict[str, str]) -> Column:
        pairs = [F.lit(x) for pair in values.items() for x in pair]
        return F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")

    return [
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(experiment).alias("experiment_id"),
        F.lit(datetime.now(UTC).isoformat()).alias("created_at"),
        F.struct(*dataset).alias("dataset"),
        texts(revisions).alias("resolved_model_revisions"),
        texts(config).alias("config"),
        texts({"spark": pyspark.__version__, "python": platform.python_version()}).alias("software"),
    ]


def with_logit_keys(df: DataFrame, *, canvas: bool = False) -> DataFrame:
    """Adds the logical key ``<run_id>/<step key>`` that stands in for a tensor file path."""
    step = (
        canvas_key(F.col("canvas_index"), F.col("step_index"))
        if canvas
        else token_key(F.col("token_step"))
    )
    return df.withColumn("full_logits_key", F.concat_ws("/", F.col("run_id").cast("string"), step))


def write_full_logits(df: DataFrame, path: str, buckets: int = LOGIT_BUCKETS) -> None:
    """Keep whole score vectors, in a fixed number of folders by a hash of the run.

    One folder per run would be millions of folders; a bucket still prunes a read of one run. The
    rebalance gives each bucket files of even size, splitting the bucket of a hot run.
    """
    bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")
    bucketed = df.withColumn("run_bucket", bucket).hint("rebalance", F.col("run_bucket"))
    bucketed.write.mode("errorifexists").partitionBy("run_bucket").parquet(path)


def read_full_logits(spark: SparkSession, path: str, run_id: str, buckets: int = LOGIT_BUCKETS) -> DataFrame:
    """The stored vectors of one run, reading only its bucket."""
    bucket = F.pmod(F.xxhash64(F.lit(run_id)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).filter(
        (F.col("run_bucket") == bucket) & (F.col("run_id") == run_id)
    )
