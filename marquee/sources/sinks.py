"""Writers. Each one is a full, idempotent replacement of its target."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from marquee.session import materialize
from marquee.sources import listing
from marquee.sources.layout import Layout


def overwrite_table(df: DataFrame, uri: str, *, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table once the new one is whole.

    The rows are written to a hidden sibling folder, which then takes the table's place by
    renaming; a failed write leaves the old table as it was. Between the two renames a
    reader may find no table. Stores without a rename of folders copy instead.
    """
    spark = df.sparkSession
    parent, name = uri.rstrip("/").rsplit("/", 1)
    mark = uuid.uuid4().hex
    fresh, former = f"{parent}/_{name}-new-{mark}", f"{parent}/_{name}-old-{mark}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    files = paths(uri).getFileSystem(spark._jsc.hadoopConfiguration())

    def rename(source: str, target: str) -> None:
        if not files.rename(paths(source), paths(target)):
            raise OSError(f"can't rename {source} to {target}")

    try:
        writer.parquet(fresh)
        replaced = files.exists(paths(uri))
        if replaced:
            rename(uri, former)
        try:
            rename(fresh, uri)
        except Exception:
            if replaced:
                rename(former, uri)
            raise
    finally:
        files.delete(paths(fresh), True)
    files.delete(paths(former), True)
    spark.catalog.refreshByPath(uri)


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a catalog table bucketed and sorted on its join key.

    Silver tables stored this way with the same bucket count join into Gold without
    any shuffle, which is the layout to use once the layers live in a catalog.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def csv_frame(df: DataFrame) -> DataFrame:
    """List columns flattened to ", "-joined text so that the frame fits a CSV file."""
    return df.select(*[
        F.array_join(field.name, ", ").alias(field.name)
        if isinstance(field.dataType, ArrayType) else F.col(field.name)
        for field in df.schema.fields
    ])


def export_csv(df: DataFrame, uri: str) -> None:
    csv_frame(df).write.mode("overwrite").option("header", True).csv(uri)


def _write_run(df: DataFrame, uri: str, run_date: str) -> None:
    (
        df.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite").partitionBy("run_date")
        .option("partitionOverwriteMode", "dynamic")
        .parquet(uri)
    )


def write_manifest(manifest: DataFrame, uri: str, run_date: str) -> None:
    """Store the manifest of one run; only that run's date folder is replaced."""
    _write_run(manifest, uri, run_date)


def write_discovered(discovered: DataFrame, uri: str, run_date: str) -> None:
    """Store the ids of one run beside its manifest; only that run's date folder is replaced."""
    _write_run(discovered, uri, run_date)


def retain_pages(pages: DataFrame, uri: str, run_date: str, *, enabled: bool = True) -> None:
    """Keep the raw discover pages of a run, one folder per run date."""
    if not enabled:
        return
    (
        pages.withColumn("run_date", F.lit(run_date))
        .write.mode("overwrite").partitionBy("run_date")
        .option("partitionOverwriteMode", "dynamic").option("compression", "gzip")
        .json(uri)
    )


def publish(spark: SparkSession, source: Layout, target: Layout) -> DataFrame:
    """Copy every file of the three layers to another root, byte for byte.

    Returns one row (files, bytes). Nothing to publish yields (0, 0). The listing is
    split among tasks by file size and each task streams its own files, so nothing
    passes through the driver; repeating a lost task rewrites the same files.
    """
    files = listing.empty_listing(spark)
    for layer in ("bronze", "silver", "gold"):
        files = files.unionByName(listing.list_files(spark, source.uri(layer)))
    place = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    root = re.sub("^[a-z0-9]+:/+", "/", source.uri(""))
    orders = files.select(
        "path", "length",
        F.concat(F.lit(target.uri("")), F.substr(place, F.instr(place, F.lit(root)) + len(root)))
        .alias("destination"))
    done = materialize(orders.mapInPandas(_copy_files, "destination string, length bigint"),
                       "published")
    return done.agg(F.count(F.lit(1)).alias("files"),
                    F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _copy_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def located(uri: str) -> tuple[fs.FileSystem, str]:
        uri = re.sub("^file:/+", "/", uri)
        return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))

    for batch in batches:
        for path, destination in zip(batch["path"], batch["destination"]):
            source_system, source_path = located(path)
            target_system, target_path = located(destination)
            target_system.create_dir(target_path.rsplit("/", 1)[0], recursive=True)
            fs.copy_files(source_path, target_path, source_filesystem=source_system,
                          destination_filesystem=target_system)
        yield batch[["destination", "length"]]
