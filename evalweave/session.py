"""Session defaults and the shared folder every job may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
FREED_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "evalweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and this package at its workers; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (``spark.checkpoint.dir``).

    Only a ``local`` session may fall back to a folder of its own; on a cluster a machine-local
    folder would be invisible to the other executors.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="evalweave-")
    return _LOCAL_FOLDERS[application]


def shared_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{shared_dir(spark)}/evalweave/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once, to the shared folder unless ``path`` is given, and go on from the files.

    Cuts the lineage so that lost executors cost a re-read, freezes anything that depends on task
    placement, and gives Catalyst real sizes to choose join strategies from.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, label)
    before = spark.conf.get(FREED_CONF, None)
    # Only this write needs its shuffles; they would lie on the disks until the driver collects garbage.
    spark.conf.set(FREED_CONF, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.unset(FREED_CONF) if before is None else spark.conf.set(FREED_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once per application.

    For sessions that were not started with ``--py-files`` or an installed package.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="evalweave-")) / "evalweave.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for source in sorted(package.rglob("*.py")):
            target.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def local_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
