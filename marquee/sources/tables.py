"""Parquet tables of the Silver and Gold layers: schemas and scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee import config

MOVIES_SCHEMA = (
    "id bigint, title string, original_title string, release_date date, release_year int, "
    "release_month int, budget bigint, revenue bigint, runtime int, vote_average double, "
    "vote_count bigint, popularity double, original_language string, adult boolean, "
    "genres array<string>, production_companies array<string>"
)
CAST_SCHEMA = (
    "movie_id bigint, pos int, order int, person_id bigint, name string, character string"
)
CREW_SCHEMA = (
    "movie_id bigint, pos int, job string, person_id bigint, name string"
)
GOLD_SCHEMA = (
    "movie_id bigint, title string, original_title string, release_year int, release_month int, "
    "budget bigint, budget_musd double, revenue bigint, revenue_musd double, roi double, "
    "runtime int, vote_average double, vote_count bigint, popularity double, "
    "genres array<string>, production_companies array<string>, lead_production_company string, "
    "director_id bigint, director_name string, lead_cast_id bigint, lead_cast_name string"
)
SILVER_SCHEMAS = {"movies": MOVIES_SCHEMA, "cast": CAST_SCHEMA, "crew": CREW_SCHEMA}


class MissingTable(FileNotFoundError):
    """A table that must exist does not."""


def _scan(spark: SparkSession, uri: str, schema: str | None) -> DataFrame | None:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(uri)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_table(spark: SparkSession, uri: str, schema: str | None = None, *,
               columns: Sequence[str] | None = None, required: bool = False) -> DataFrame:
    """Scan a Parquet table, optionally only some columns.

    A missing table is an empty frame of the given schema, or an error if ``required``.
    """
    frame = _scan(spark, uri, schema)
    if frame is None:
        if required or schema is None:
            raise MissingTable(f"no table at {uri}; build the layers first")
        frame = spark.createDataFrame([], schema)
    return frame if columns is None else frame.select(*columns)


def read_silver(spark: SparkSession, uri: str, table: str, **options) -> DataFrame:
    return read_table(spark, uri, SILVER_SCHEMAS[table], **options)


def read_gold(spark: SparkSession, uri: str, **options) -> DataFrame:
    return read_table(spark, uri, GOLD_SCHEMA, **options)


def read_gold_for_analytics(spark: SparkSession, uri: str) -> DataFrame:
    return read_gold(spark, uri, columns=config.ANALYTICS_COLUMNS)


def row_count(spark: SparkSession, uri: str) -> int | None:
    """Rows of a Parquet table, or None when it is missing. Reads no column data."""
    frame = _scan(spark, uri, None)
    return None if frame is None else frame.count()


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: position, name and Spark type."""
    rows = [(position, name, kind) for position, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for several frames in one job."""
    parts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, frame in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
