"""Batch intake on the sales tables: events play the discover pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.functions import id_prefix as prefix_of
from marquee.operators import intake
from marquee.plans.oracle_views import with_gold, with_views
from marquee.plans.order_tables import order_movies, table
from marquee.plans.registry import REGISTRY
from marquee.session import materialize, scratch_path
from marquee.sources.layout import Layout
from marquee.sources.sinks import write_discovered

PAGE_SIZE = 20


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event lists its user: page and position follow from the event number."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.expr(f"event_id div {PAGE_SIZE}").alias("page"),
        F.expr(f"event_id % {PAGE_SIZE}").alias("pos"))


_FIRST = """
    SELECT user_id AS id, min(event_id) // 20 AS page, min(event_id) % 20 AS pos
    FROM events GROUP BY user_id"""


@REGISTRY.add(with_gold("""
    SELECT id, popularity, vote_count, release_date FROM movies
    WHERE original_language = 'O' AND NOT adult AND vote_count >= 4
      AND release_date BETWEEN DATE '1997-01-01' AND DATE '2001-01-31'"""))
def discover_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.discover_scope(
        order_movies(spark, sf_dir), start_year=1997, as_of=dt.date(2001, 1, 31), min_votes=4,
        language="O").select("id", "popularity", "vote_count", "release_date")


@REGISTRY.add(_FIRST)
def first_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.first_appearances(_entries(spark, sf_dir))


@REGISTRY.add(f"SELECT * FROM ({_FIRST}) ORDER BY page, pos, id LIMIT 100")
def candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.candidate_cap(_entries(spark, sf_dir), cap=100)


@REGISTRY.add("""
    SELECT o_orderkey AS id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.new_ids(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")),
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@REGISTRY.add("""
    SELECT count(*) AS skipped FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = intake.known_ids(
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")),
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))
    return known.agg(F.count(F.lit(1)).alias("skipped"))


def _done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all listed users: buyers above 200 were there, errors are attempts."""
    events = table(spark, sf_dir, "events")
    attempts = events.where(F.col("event_type") == "error").select(
        F.col("user_id").alias("id"), F.when(F.col("value") > 2, F.lit("timeout")).alias("error"))
    landed = events.where((F.col("event_type") == "purchase") & (F.col("value") > 200)).select(
        F.col("user_id").alias("id"))
    return intake.outcomes(intake.first_appearances(_entries(spark, sf_dir)), landed, attempts)


_DONE = """
    SELECT c.id, c.page, c.pos,
           CASE WHEN c.id IN (SELECT user_id FROM events
                              WHERE event_type = 'purchase' AND value > 200) THEN 'skipped'
                WHEN c.id IN (SELECT user_id FROM events
                              WHERE event_type = 'error' AND value <= 2) THEN 'fetched'
                ELSE 'failed' END AS outcome,
           CASE WHEN c.id IN (SELECT user_id FROM events WHERE event_type = 'error')
                THEN 'timeout' ELSE 'no document arrived' END AS problem
    FROM first c"""


@REGISTRY.add(with_views("SELECT outcome, count(*) AS n FROM done GROUP BY outcome",
                         first=_FIRST, done=_DONE))
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.outcome_counts(_done(spark, sf_dir))


@REGISTRY.add(with_views("""
    SELECT count(*) FILTER (WHERE outcome = 'fetched') AS fetched, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
           count(*) FILTER (WHERE outcome = 'failed') AS failed,
           CASE WHEN count(*) <= 120 THEN string_agg(id, ',' ORDER BY page, pos, id) END AS discovered_ids,
           (SELECT string_agg('id=' || id || ': ' || problem, ',' ORDER BY page, pos, id)
            FROM (SELECT * FROM done WHERE outcome = 'failed' ORDER BY page, pos, id LIMIT 50))
             AS errors
    FROM done""", first=_FIRST, done=_DONE))
def ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all candidates; a list of ids longer than the target is left to all_discovered."""
    manifest = intake.run_manifest(
        materialize(_done(spark, sf_dir), "done"), run_timestamp="2024-02-01T00:00:00+00:00",
        filters={"language": "en"}, target=120)
    return manifest.select(
        "fetched", "skipped", "failed",
        F.array_join(F.col("discovered_ids").cast("array<string>"), ",").alias("discovered_ids"),
        F.array_join("errors", ",").alias("errors"))


@REGISTRY.add(with_views("SELECT outcome, count(*) AS n FROM done GROUP BY outcome",
                         first=_FIRST, done=_DONE))
def all_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.outcome_counts(_done(spark, sf_dir))


@REGISTRY.add(with_views("""
    SELECT count(*) FILTER (WHERE outcome = 'fetched') AS fetched, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
           count(*) FILTER (WHERE outcome = 'failed') AS failed,
           (SELECT string_agg('id=' || id || ': ' || problem, ',' ORDER BY page, pos, id)
            FROM (SELECT * FROM done WHERE outcome = 'failed' ORDER BY page, pos, id LIMIT 50))
             AS errors
    FROM done""", first=_FIRST, done=_DONE))
def all_ingest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a run over all candidates; all_discovered has their ids."""
    manifest = intake.run_manifest(
        materialize(_done(spark, sf_dir), "done"),
        run_timestamp="2024-02-01T00:00:00+00:00", filters={"language": "en"})
    return manifest.select("fetched", "skipped", "failed",
                           F.array_join("errors", ",").alias("errors"))


@REGISTRY.add(with_views("SELECT id, page, pos FROM done", first=_FIRST, done=_DONE))
def all_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of the same run, stored beside the manifest and read back."""
    layout = Layout(scratch_path(spark, "run"))
    write_discovered(intake.discovered(_done(spark, sf_dir)), layout.discovered,
                     "2024-02-01")
    return spark.read.parquet(layout.discovered).select("id", "page", "pos")


def _raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four states: whole, cut off, with a quoted id, without an id."""
    key = F.col("o_orderkey").cast("string")
    whole = F.format_string('{"id": %s, "status": "%s"}', key, "o_orderstatus")
    body = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.format_string('{"id": %s, "sta', key))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.format_string('{"id": "%s"}', key))
        .when(F.col("o_orderpriority") == "2-HIGH", F.format_string('{"key": %s}', key))
        .otherwise(whole)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body"))


@REGISTRY.add("""
    SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'not valid JSON'
             WHEN '3-MEDIUM' THEN 'id is not a whole number' ELSE 'no id' END AS reason
    FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM', '2-HIGH')""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.split_readable(_raw_orders(spark, sf_dir))[1].select("o_orderkey", "reason")


@REGISTRY.add("""
    SELECT printf('%03d', l_orderkey // 1000) AS id_prefix, count(*) AS lines
    FROM lineitem GROUP BY 1""")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem").select(prefix_of(F.col("l_orderkey")).alias("id_prefix"))
        .groupBy("id_prefix").agg(F.count(F.lit(1)).alias("lines"))
    )
