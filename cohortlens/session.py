"""Session settings and the shared folder used for checkpoints and written tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders that each application has made.
_MADE: dict[str, list[str]] = {}


def build_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with adaptive execution and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(p for p in (root, paths) if p)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which must name one that all executors share.

    Only a local master may leave it unset: its files then go to the session's warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_written(spark: SparkSession, paths: Sequence[str] | None = None) -> int:
    """Delete tables that this application wrote to the shared folder: those given, or all. Returns how many folders went.

    For the end of a flow, when no DataFrame over them is needed any more.
    """
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone = 0
    for path in [p for p in made if paths is None or p in paths]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))
        made.remove(path)
    return gone


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; results that outlive it must be collected or stored elsewhere."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = set(made)
    try:
        yield
    finally:
        drop_written(spark, [p for p in made if p not in before])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative trainers somewhere durable to cut their lineage."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))


def materialize(df: DataFrame, purpose: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For tables that are read many times: unlike a cache it survives the loss of
    executors, and with ``partition_by`` a reader of one part skips the others.
    """
    path = shared_dir(df.sparkSession, purpose)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
