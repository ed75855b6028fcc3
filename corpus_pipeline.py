"""A training-corpus pipeline over ``documents``: each stage is one operator.

Toxic documents go, then those that don't read like any language learned from them; of equal texts the one
of the largest doc_id stays, of near copies the one of the smallest; what is left is packed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import exact_dedup, jaccard, language, packing, toxicity
from marquee.session import materialize

#: Rows of an Arrow batch. A task holds a batch of whole documents several times over, in the
#: JVM and in Python, and 10,000 of them, the default, take tens of megabytes each time.
BATCH_ROWS = 2_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches have at most BATCH_ROWS rows from then on."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
            spark.conf.set(setting, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)
    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


@bounded
def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.without_unknown(docs, language.with_bounds(language.fit(docs, share=language.LEARNED), docs))


@bounded
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.one_of_each(docs)


@bounded
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, forget=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("language", drop_unknown_language), ("exact_dedup", drop_copies),
    ("near_copies", drop_near_copies), ("packing", pack),
]
#: Fitted models and tokenisers aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass; each stage is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
