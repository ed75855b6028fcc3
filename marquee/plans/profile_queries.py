"""Filters, previews, bounds, profiles and rankings, on the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee import config
from marquee.functions import size_mb
from marquee.operators import audit, profile
from marquee.operators.gold import first_director
from marquee.plans.oracle_views import with_gold, with_views
from marquee.plans.order_tables import (
    DIRECTOR_FLAG, order_crew, order_gold, order_movies, stored_gold, table,
)
from marquee.plans.registry import REGISTRY
from marquee.sources.sinks import csv_frame as flattened
from marquee.sources.tables import row_counts as counted_rows


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


@REGISTRY.add(with_gold("""
    SELECT count(*) AS movies, count(DISTINCT director_name) AS directors,
           min(release_year) AS year_min, max(release_year) AS year_max,
           round(median(budget_musd), 6) AS median_budget_musd, round(median(roi), 6) AS median_roi
    FROM gold"""))
def gold_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = stored_gold(spark, sf_dir, ("release_year", "director_name", "budget_musd", "roi"))
    return _rounded(profile.headline(gold), "median_budget_musd", "median_roi")


@REGISTRY.add(with_gold("""
    SELECT min(release_year) AS release_year_min, max(release_year) AS release_year_max,
           min(budget_musd) AS budget_musd_min, max(budget_musd) AS budget_musd_max,
           min(vote_count) AS vote_count_min, max(vote_count) AS vote_count_max
    FROM gold"""))
def filter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("release_year", "budget_musd", "vote_count")
    return profile.filter_bounds(order_gold(spark, sf_dir, columns), columns)


@REGISTRY.add(with_gold("SELECT DISTINCT genre FROM by_genre"))
def distinct_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_elements(order_gold(spark, sf_dir, ("genres",)), "genres", name="genre")


def _describe_sql(quartile: str) -> str:
    measures = {
        "count": "CAST(count({c}) AS DOUBLE)",
        "null_count": "CAST(count(*) - count({c}) AS DOUBLE)",
        "mean": "avg({c})", "std": "stddev_samp({c})", "min": "CAST(min({c}) AS DOUBLE)",
        "25%": quartile.replace("{q}", "0.25"), "50%": quartile.replace("{q}", "0.5"),
        "75%": quartile.replace("{q}", "0.75"), "max": "CAST(max({c}) AS DOUBLE)",
    }
    return with_gold("\nUNION ALL ".join(
        f"SELECT '{label}' AS statistic, " + ", ".join(
            f"round({measure.replace('{c}', column)}, 6) AS {column}"
            for column in config.DESCRIBED_COLUMNS) + " FROM gold"
        for label, measure in measures.items()))


def _described(spark: SparkSession, sf_dir: str, interpolation: str) -> DataFrame:
    gold = stored_gold(spark, sf_dir, config.DESCRIBED_COLUMNS)
    return _rounded(profile.describe(gold, interpolation=interpolation), *config.DESCRIBED_COLUMNS)


@REGISTRY.add(_describe_sql(
    "list_sort(list(CAST({c} AS DOUBLE)))[CAST(floor((count({c}) - 1) * {q} + 0.5) AS BIGINT) + 1]"))
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, "nearest")


@REGISTRY.add(_describe_sql("quantile_cont(CAST({c} AS DOUBLE), {q})"))
def describe_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _described(spark, sf_dir, "linear")


@REGISTRY.add(with_gold("""
    SELECT director_name, n FROM (
      SELECT director_name, count(*) AS n FROM gold WHERE director_name IS NOT NULL
      GROUP BY director_name ORDER BY n DESC, director_name LIMIT 400)
    WHERE director_name <> ''"""))
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(order_gold(spark, sf_dir, ("director_name",)), "director_name")


_INSPECTED = """
    SELECT * FROM gold
    WHERE release_year BETWEEN 1996 AND 2000 AND budget_musd BETWEEN 0.05 AND 0.4
      AND list_has_any(genres, ['LARGE', 'PROMO'])
      AND contains(lower(coalesce(director_name, '')), lower('R#00000001'))"""


def _inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.inspect_filter(order_gold(spark, sf_dir), years=(1996, 2000),
                                  budget_musd=(0.05, 0.4), genres=("LARGE", "PROMO"),
                                  director=" R#00000001 ")


@REGISTRY.add(with_gold("""
    SELECT movie_id, title, release_year, budget_musd, director_name FROM inspected""",
    inspected=_INSPECTED))
def inspect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inspected(spark, sf_dir).select("movie_id", "title", "release_year", "budget_musd",
                                            "director_name")


@REGISTRY.add(with_gold("""
    SELECT title, release_year, roi, director_name FROM inspected ORDER BY movie_id LIMIT 50""",
    inspected=_INSPECTED))
def inspect_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.preview(_inspected(spark, sf_dir),
                           ("title", "release_year", "roi", "director_name"), n=50)


@REGISTRY.add(with_gold("""
    SELECT * REPLACE (array_to_string(genres, ', ') AS genres,
                      array_to_string(production_companies, ', ') AS production_companies)
    FROM inspected""", inspected=_INSPECTED))
def csv_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flattened(_inspected(spark, sf_dir))


@REGISTRY.add("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= 45).select(
        "l_orderkey", "l_partkey", "l_quantity")


@REGISTRY.add(" UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", count(*) AS rows FROM {name}"
    for name in ("orders", "lineitem", "events", "documents")))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_rows({name: table(spark, sf_dir, name)
                         for name in ("orders", "lineitem", "events", "documents")})


@REGISTRY.add(with_gold("""
    SELECT count(*) AS rows, count(director_name) AS with_director,
           count(*) FILTER (WHERE runtime IS NOT NULL AND director_name IS NOT NULL) AS complete
    FROM movies LEFT JOIN directors ON movie_id = id"""))
def drop_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = order_movies(spark, sf_dir).select(F.col("id").alias("movie_id"), "runtime")
    people = first_director(order_crew(spark, sf_dir), job=DIRECTOR_FLAG)
    joined = movies.join(people, "movie_id", "left")
    there = {name: F.col(name).isNotNull() for name in ("runtime", "director_name")}
    return joined.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(there["director_name"]).alias("with_director"),
        F.count_if(there["runtime"] & there["director_name"]).alias("complete"))


@REGISTRY.add("""
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 4242""")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.point_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 4242).select(
        "o_orderkey", "o_custkey", "o_totalprice")


@REGISTRY.add("""
    SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes,
           round(sum(strlen(text)) / 1000000, 3) AS size_mb
    FROM documents GROUP BY source""")
def text_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "documents").select("source", F.octet_length("text").alias("size"))
    return sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        size_mb(F.sum("size")).alias("size_mb"))


@REGISTRY.add(with_views(
    "SELECT props_k, count(*) AS n FROM parsed GROUP BY props_k",
    parsed="SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events"))
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return (
        table(spark, sf_dir, "events").select(value.alias("props_k"))
        .groupBy("props_k").agg(F.count(F.lit(1)).alias("n"))
    )
