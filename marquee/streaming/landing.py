"""Incremental landing of new documents with Structured Streaming.

A stream of raw documents is landed once per id; running it again is a no-op. Unusable
documents go to a quarantine table with the reason, and the run continues.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marquee.operators.intake import judged, split_readable
from marquee.session import materialized
from marquee.sources.documents import framed

LANDED_SCHEMA = "id bigint, source string, body string, run string, batch bigint"
QUARANTINE_SCHEMA = "source string, body string, reason string, run string, batch bigint"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(spark: SparkSession, uri: str, *, pattern: str = "*.json.gz",
                    one_per_file: bool = True, max_files: int | None = 10_000) -> DataFrame:
    """New files below ``uri`` as (source, body); ``max_files`` bounds one micro-batch."""
    reader = (
        spark.readStream.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.text(uri, wholetext=one_per_file)
    return framed(lines.select(F.col("_metadata.file_path").alias("source"),
                               F.col("value").alias("body")))


def read_batches(spark: SparkSession, uri: str, schema: str) -> DataFrame:
    """All micro-batches written so far, each in its own ``run=R/batch=N`` folder."""
    try:
        return spark.read.schema(schema).option("basePath", uri).parquet(f"{uri}/run=*/batch=*")
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_landed(spark: SparkSession, uri: str) -> DataFrame:
    return read_batches(spark, uri, LANDED_SCHEMA)


def read_quarantine(spark: SparkSession, uri: str) -> DataFrame:
    return read_batches(spark, uri, QUARANTINE_SCHEMA)


def one_per_id(docs: DataFrame) -> DataFrame:
    """One document per id, the one from the smallest source. Copies collapse map-side."""
    chosen = docs.groupBy("id").agg(
        F.min_by(F.struct("source", "body"), F.struct("source", "body")).alias("doc"))
    return chosen.select("id", "doc.source", "doc.body")


def run_name(checkpoint_uri: str) -> str:
    """The name of the streams that share a checkpoint: their batches are numbered together."""
    return hashlib.md5(checkpoint_uri.rstrip("/").encode()).hexdigest()[:16]


def _unlanded(docs: DataFrame, landed_uri: str, run: str, number: int) -> DataFrame:
    """``docs``, of different ids, without those that another batch has landed."""
    others = read_landed(docs.sparkSession, landed_uri).where((F.col("run") != run) | (F.col("batch") != number))
    known = others.select("id").join(docs.select("id"), "id", "left_semi").distinct()
    return docs.join(known, "id", "left_anti")


def land_batch(batch: DataFrame, number: int, landed_uri: str, quarantine_uri: str,
               run: str = "0") -> None:
    """Land one micro-batch of a run. Repeating it replaces exactly what it wrote.

    The batch is judged and stored once, so the source is read once and the planner
    knows how many ids it holds: the id column of the landed table is filtered by a
    broadcast of them while they are few, by a shuffle otherwise. Earlier output of the
    same batch is ignored, so a retry does not take its own documents for old ones.
    """
    with materialized(judged(batch.select("source", "body")), "batch") as stored:
        fresh = _unlanded(one_per_id(stored.where("reason is null")), landed_uri, run, number)
        fresh.write.mode("overwrite").parquet(f"{landed_uri}/run={run}/batch={number}")
        unusable = stored.where("reason is not null").select("source", "body", "reason")
        unusable.write.mode("overwrite").parquet(f"{quarantine_uri}/run={run}/batch={number}")


def start_landing(stream: DataFrame, landed_uri: str, quarantine_uri: str,
                  checkpoint_uri: str) -> StreamingQuery:
    """Process everything that has arrived, remembering ids through the landed table."""
    def land(batch: DataFrame, number: int) -> None:
        land_batch(batch, number, landed_uri, quarantine_uri, run_name(checkpoint_uri))

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint_uri)
        .trigger(availableNow=True).start()
    )


def start_stateful_landing(stream: DataFrame, landed_uri: str, checkpoint_uri: str,
                           quarantine_uri: str | None = None, *,
                           remember: str | None = None) -> StreamingQuery:
    """The same with ids remembered in the state store instead of re-read per batch.

    The cost of a batch then follows the batch, not the landed table. The state holds
    every id ever seen, spread over all executors and kept on disk by RocksDB, or, with
    ``remember`` (such as "7 days"), those of documents processed within that time: its size
    is bounded, and what passes it is looked for in the landed table as well. Unusable
    documents pass it by; without ``quarantine_uri`` they go beside the landed table, to
    its name with "-quarantine" added.
    """
    quarantine = quarantine_uri or f"{landed_uri.rstrip('/')}-quarantine"
    readable, unusable = split_readable(stream)
    if remember is None:
        once = readable.dropDuplicates(["id"])
    else:
        once = (readable.withColumn("seen", F.current_timestamp()).withWatermark("seen", remember)
                .dropDuplicatesWithinWatermark(["id"]))
    unique = once.select(
        "id", "source", "body", F.lit(None).cast("string").alias("reason"))
    both = unique.unionByName(unusable.select(
        F.lit(None).cast("bigint").alias("id"), "source", "body", "reason"))

    def land(batch: DataFrame, number: int) -> None:
        own = f"run={run_name(checkpoint_uri)}/batch={number}"
        with materialized(batch, "batch") as stored:
            fresh = stored.where("reason is null").select("id", "source", "body")
            if remember is not None:
                fresh = _unlanded(fresh, landed_uri, run_name(checkpoint_uri), number)
            fresh.write.mode("overwrite").parquet(f"{landed_uri}/{own}")
            stored.where("reason is not null").select("source", "body", "reason").write.mode(
                "overwrite").parquet(f"{quarantine}/{own}")

    # A query keeps the provider it was started with, so the setting is put back at once.
    settings = stream.sparkSession.conf
    before = settings.get(STATE_STORE)
    settings.set(STATE_STORE, ROCKSDB)
    try:
        return (
            both.writeStream.foreachBatch(land)
            .option("checkpointLocation", checkpoint_uri)
            .trigger(availableNow=True).start()
        )
    finally:
        settings.set(STATE_STORE, before)
