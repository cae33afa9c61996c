"""Session settings shared by tests, the bench and the command-line checks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on. On a cluster they belong in spark-defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str = "tickloom", cpus: str | None = None) -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Set the run-time options results depend on, leaving everything else to the caller."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir`` of the session.

    Where that is unset a scratch folder is made and set, but only for a local master: on a
    cluster a machine's own folder would lose rows, so the setting is asked for.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared folder; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffles of a job are deleted when it has ended.

    For jobs that write what they make to the shared folder: nobody reads their shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Workspace:
    """Frames written to the shared folder by name; writing a name again deletes what it held before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}
        self.root = f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"

    def written(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(folder)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, name: str) -> None:
        if name in self.folders:
            self._delete(self.folders.pop(name))

    def _delete(self, folder: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Workspace]:
    """A :class:`Workspace` whose frames are deleted at the end; within, so are the shuffles of finished jobs."""
    work = Workspace(spark)
    try:
        with freed_shuffles(spark):
            yield work
    finally:
        work._delete(work.root)


def shared(df):
    """Keep a small intermediate that several branches of one query read.

    Used on day-level or key-level aggregates only. Storage spills to disk, and a lost
    executor's blocks are recomputed from the lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def settled(df):
    """:func:`shared`, computed now: the frame and its row count."""
    kept = shared(df)
    return kept, kept.count()


# Rows of a few numbers each: tens of megabytes on an executor.
BROADCAST_ROWS = 1_000_000


def sided(df, rows: int):
    """The lookup side of a join whose row count has been measured.

    Broadcast up to the limit; beyond it a sort-merge join, so neither side is ever sent whole
    to an executor. Without this the planner would judge the other side, which is exploded from
    a few rows, by its size before the explode.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")
