"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SPARK_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def build_session(app_name: str = "marquee", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """Get or create a session. Cluster sizing stays with whoever submits the job."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SPARK_SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent in local mode (tests, a laptop) a temporary folder is
    chosen once and recorded on the session, so all callers agree on it. On a cluster
    its absence is an error: executors don't share a machine's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("marquee.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder with master {master}")
        folder = tempfile.mkdtemp(prefix="marquee-")
        spark.conf.set("marquee.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


# Scratch paths handed out so far, per Spark application.
_SCRATCH: defaultdict[str, list[str]] = defaultdict(list)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered for :func:`clear_scratch`."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[spark.sparkContext.applicationId].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def clear_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables of this application once its results are stored."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def delete_scratch(spark: SparkSession, path: str) -> None:
    """Delete one path of :func:`scratch_path` that nothing reads any more."""
    _SCRATCH[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def materialize(df: DataFrame, name: str = "stage", *,
                partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cache it survives lost executors, and unlike a checkpoint the result is
    a Parquet table: later readers get column pruning and filter pushdown, and the
    planner knows its real size when it chooses between broadcast and shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Large trees of folders are listed by a few tasks of many folders for the length of a block,
    instead of up to 10,000, of which each takes longer to start than to list its folders."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, wanted = int(spark.conf.get(name)), 4 * spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(min(before, wanted)))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


@contextmanager
def materialized(df: DataFrame, name: str = "stage") -> Iterator[DataFrame]:
    """The stored ``df`` for the length of a block; its files are deleted afterwards."""
    spark = df.sparkSession
    stored = materialize(df, name)
    mine = _SCRATCH[spark.sparkContext.applicationId].pop()
    try:
        yield stored
    finally:
        _delete(spark, mine)
