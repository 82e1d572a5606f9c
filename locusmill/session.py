"""Session settings, the shared scratch folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TUNED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "locusmill", scratch: str | None = None
) -> SparkSession:
    """A local-mode session for tests and the benchmark; a cluster brings its own. ``scratch`` is its shared folder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("LOCUSMILL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in TUNED.items():
        builder = builder.config(key, value)
    if scratch is not None:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="locusmill-"))
    return spark.sparkContext.getCheckpointDir()


#: The folder of the analysis that is running, if one owns its intermediates.
_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def scratch_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A fresh path in the running analysis' folder, else below the shared folder; ``keep`` asks for the latter."""
    base = None if keep else _workspace.get()
    return f"{(base or shared_dir(spark)).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system holds it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def workspace(spark: SparkSession, label: str = "analysis") -> Iterator[str]:
    """A folder below the shared one for all that is staged inside, deleted at the end; results are read before that.

    Analyses in several threads, or one inside another, each have their own.
    """
    path = scratch_path(spark, label)
    token = _workspace.set(path)
    try:
        yield path
    finally:
        _workspace.reset(token)
        delete(spark, path)


#: Folders written by ``staged`` that are still there.
_written: list[str] = []


def clear_staged(spark: SparkSession, first: int = 0) -> int:
    """Delete what ``staged`` wrote from the ``first``-th folder on, once its results are used; how many folders went.

    ``first = len(staged_paths())`` before an analysis and this call after it keep what other analyses still read.
    """
    gone = _written[first:]
    for path in gone:
        delete(spark, path)
    del _written[first:]
    return len(gone)


def staged_paths() -> list[str]:
    """Folders that ``clear_staged`` would delete."""
    return list(_written)


def staged(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and go on from the files, until ``clear_staged`` unless ``keep``.

    The files outlive lost executors, cut the lineage, and keep column pruning and size statistics for what follows.
    """
    path = scratch_path(df.sparkSession, "staged", keep)
    df.write.parquet(path)
    if not keep and _workspace.get() is None:
        _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a small table over every core before its rows multiply; a fixed count is not coalesced again."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
