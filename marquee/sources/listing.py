"""File listings of a layer: counts, sizes, newest change and a change fingerprint.

Only path, size and modification time are read; file contents never are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.session import few_listing_tasks

LISTING_SCHEMA = "path string, length bigint, modificationTime timestamp"


def empty_listing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LISTING_SCHEMA)


def list_files(spark: SparkSession, uri: str, pattern: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of all files below ``uri``; empty if missing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    try:
        with few_listing_tasks(spark):
            files = reader.load(uri)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return empty_listing(spark)
        raise
    return files.select("path", "length", "modificationTime")


def file_stats(files: DataFrame) -> DataFrame:
    """One row: file count, total bytes, newest modification time (NULL when empty)."""
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.max("modificationTime").alias("last_updated"),
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """One row ``stamp`` that changes when any file is added, removed or rewritten.

    Per-file hashes are combined with order-free aggregates, so no list of files is
    gathered anywhere. An empty listing is stamped "missing".
    """
    entry = F.xxhash64("path", "length", "modificationTime")
    totals = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("length").alias("bytes"),
        F.max("modificationTime").alias("newest"),
        F.bit_xor(entry).alias("mix"),
    )
    stamp = F.concat_ws(":", F.unix_micros("newest").cast("string"), F.col("bytes").cast("string"),
                        F.hex("mix"))
    return totals.select(F.when(F.col("n") == 0, "missing").otherwise(stamp).alias("stamp"))
