"""Where each layer lives below one root URI.

The root may use any scheme Hadoop knows (a plain path, ``file:``, ``hdfs:``,
``s3a:`` ...); credentials belong in the Hadoop configuration.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

SILVER_TABLES = ("movies", "cast", "crew")
TARGETS = ("revenue", "rating")


@dataclass(frozen=True)
class Layout:
    root: str
    prefix: str = ""

    def __post_init__(self) -> None:
        if not self.root.strip():
            raise ValueError("a layout needs a root folder or bucket URI")

    def uri(self, *parts: str) -> str:
        middle = self.prefix.strip().strip("/")
        base = self.root.rstrip("/") or "/"
        return "/".join([base, *([middle] if middle else []), *parts])

    @property
    def discover(self) -> str:
        return self.uri("bronze", "discover")

    @property
    def documents(self) -> str:
        return self.uri("bronze", "movies")

    @property
    def manifests(self) -> str:
        return self.uri("bronze", "manifests")

    @property
    def discovered(self) -> str:
        return self.uri("bronze", "discovered")

    @property
    def quarantine(self) -> str:
        return self.uri("bronze", "quarantine")

    def silver(self, table: str) -> str:
        if table not in SILVER_TABLES:
            raise ValueError(f"unknown Silver table {table!r}; known: {SILVER_TABLES}")
        return self.uri("silver", f"{table}.parquet")

    @property
    def gold(self) -> str:
        return self.uri("gold", "gold_movies.parquet")

    def model(self, target: str) -> str:
        if target not in TARGETS:
            raise ValueError(f"unknown target {target!r}; known: {TARGETS}")
        return self.uri("models", f"{target}_model")

    @property
    def metrics(self) -> str:
        return self.uri("models", "metrics")


def hadoop_files(spark: SparkSession, uri: str):
    """(file system, path) of a URI, as Spark's own readers resolve it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, uri: str) -> bool:
    """Whether a file or folder is there; nothing below it is listed."""
    files, path = hadoop_files(spark, uri)
    return files.exists(path)


def child_names(spark: SparkSession, uri: str) -> list[str]:
    """Names directly below a folder that is known to hold few."""
    files, path = hadoop_files(spark, uri)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def delete_path(spark: SparkSession, uri: str) -> None:
    files, path = hadoop_files(spark, uri)
    files.delete(path, True)


def read_small_file(spark: SparkSession, uri: str) -> str:
    """The text of a file of a few bytes, such as a pointer."""
    files, path = hadoop_files(spark, uri)
    stream = files.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def replace_small_file(spark: SparkSession, uri: str, text: str) -> None:
    """Put a file of a few bytes in place of another; readers find one of the two, whole.

    Stores write a file when it is closed, whole; elsewhere a file beside it is renamed over it.
    """
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        spark._jvm.org.apache.hadoop.fs.Path(uri).toUri(), spark._jsc.hadoopConfiguration())
    fresh = f"{uri}-{uuid.uuid4().hex}"
    files, path = hadoop_files(spark, fresh)
    stream = files.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    option = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    context.rename(path, spark._jvm.org.apache.hadoop.fs.Path(uri), options)
