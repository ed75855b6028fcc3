"""Documents to Silver to Gold, and the audit of all three, on the sales tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.operators import audit, gold as gold_layer, silver
from marquee.plans.oracle_views import with_gold, with_views
from marquee.plans.order_tables import (
    MIN_BUDGET, order_documents, order_gold, order_movies, table,
)
from marquee.plans.registry import REGISTRY
from marquee.session import materialize
from marquee.sources.tables import row_counts

START_YEAR = 1996
AS_OF = dt.date(2000, 6, 30)
LANGUAGE = "F"
SCOPE = {"start_year": START_YEAR, "as_of": AS_OF, "language": LANGUAGE}

IN_SCOPE_SQL = ("original_language = 'F' AND NOT adult "
             "AND release_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'")


@REGISTRY.add(with_gold("""
    SELECT * REPLACE (array_to_string(genres, ', ') AS genres,
                      array_to_string(production_companies, ', ') AS production_companies)
    FROM gold"""))
def gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_gold(spark, sf_dir).withColumns({
        name: F.array_join(name, ", ") for name in ("genres", "production_companies")})


@REGISTRY.add(with_gold("""
    SELECT count(*) AS silver_movies, count(*) FILTER (WHERE budget >= 10000 AND revenue > 0) AS gold_movies,
           count(*) - count(*) FILTER (WHERE budget >= 10000 AND revenue > 0) AS dropped
    FROM movies"""))
def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold_layer.build_counts(order_movies(spark, sf_dir), min_budget=MIN_BUDGET)


@REGISTRY.add(with_gold(f"""
    SELECT id, release_date, original_language, adult FROM movies WHERE {IN_SCOPE_SQL}"""))
def silver_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_scope(order_movies(spark, sf_dir), **SCOPE).select(
        "id", "release_date", "original_language", "adult")


# --- the JSON route ------------------------------------------------------------

DOCUMENTS_SQL = """
    SELECT o_orderkey AS id, 'Order ' || o_orderkey AS title,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS original_title,
           CAST(o_orderdate AS DATE) AS release_date,
           CAST(year(o_orderdate) AS INTEGER) AS release_year,
           CAST(month(o_orderdate) AS INTEGER) AS release_month,
           CAST(trunc(o_totalprice) AS BIGINT) AS budget,
           CASE WHEN o_orderpriority = '5-LOW' THEN 0
                ELSE CAST(trunc(o_totalprice * 2) AS BIGINT) END AS revenue,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 95 END AS runtime,
           CAST(0 AS DOUBLE) AS vote_average, o_custkey AS vote_count,
           CAST(0 AS DOUBLE) AS popularity, o_orderstatus AS original_language,
           o_orderpriority = '1-URGENT' AS adult,
           o_orderpriority || ', ' || o_orderstatus AS genres,
           o_orderstatus AS production_companies
    FROM orders"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.parse_documents(order_documents(spark, sf_dir))


@REGISTRY.add(with_views("SELECT * FROM docs", docs=DOCUMENTS_SQL))
def documents_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_movies(_parsed(spark, sf_dir)).withColumns({
        name: F.array_join(name, ", ") for name in ("genres", "production_companies")})


@REGISTRY.add(with_views(
    f"SELECT id, title, release_date, budget, revenue FROM docs WHERE {IN_SCOPE_SQL}", docs=DOCUMENTS_SQL))
def silver_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = silver.silver_scope(_parsed(spark, sf_dir), **SCOPE)
    return silver.silver_movies(scoped).select("id", "title", "release_date", "budget", "revenue")


@REGISTRY.add("""
    SELECT o_orderkey AS movie_id, CAST(1 AS INTEGER) AS pos, CAST(0 AS INTEGER) AS "order",
           o_custkey AS person_id, 'lead ' || o_orderstatus AS name,
           'as lead ' || o_orderstatus AS character
    FROM orders""")
def top_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_cast(_parsed(spark, sf_dir))


@REGISTRY.add("""
    SELECT o_orderkey AS movie_id, CAST(1 AS INTEGER) AS pos, 'Producer' AS job,
           o_custkey + 3 AS person_id, 'payer' AS name FROM orders
    UNION ALL
    SELECT o_orderkey, 2, 'Director', o_custkey + 4, 'boss' FROM orders""")
def crew_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_crew(_parsed(spark, sf_dir))


@REGISTRY.add(with_views(f"""
    SELECT 'movies' AS "table", count(*) AS rows FROM docs WHERE {IN_SCOPE_SQL}
    UNION ALL SELECT 'cast', count(*) FROM docs WHERE {IN_SCOPE_SQL}
    UNION ALL SELECT 'crew', 2 * count(*) FROM docs WHERE {IN_SCOPE_SQL}""", docs=DOCUMENTS_SQL))
def silver_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored, as build_silver does, so that the documents are parsed once and not per table.
    scoped = materialize(silver.silver_scope(_parsed(spark, sf_dir), **SCOPE), "documents")
    return row_counts(silver.silver_tables(scoped))


# --- audit ---------------------------------------------------------------------

_REASONED = """
    SELECT id,
      list_filter([
        CASE WHEN original_language <> 'F' THEN 'language is ' || original_language || ', not F' END,
        CASE WHEN adult THEN 'adult content' END,
        CASE WHEN release_date < DATE '1996-01-01'
             THEN 'released ' || release_date || ', before 1996-01-01' END,
        CASE WHEN release_date > DATE '2000-06-30'
             THEN 'released ' || release_date || ', after 2000-06-30' END],
        lambda x: x IS NOT NULL) AS silver_reasons,
      list_filter([
        CASE WHEN budget < 10000 THEN 'budget below 10000' END,
        CASE WHEN revenue <= 0 THEN 'no revenue' END],
        lambda x: x IS NOT NULL) AS gold_reasons
    FROM movies"""


def _reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.drop_reasons(order_movies(spark, sf_dir), min_budget=MIN_BUDGET, **SCOPE)


@REGISTRY.add(with_gold("""
    SELECT id, array_to_string(silver_reasons, '; ') AS silver_reasons,
           array_to_string(gold_reasons, '; ') AS gold_reasons
    FROM reasoned""", reasoned=_REASONED))
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasoned(spark, sf_dir).select("id", *[
        F.array_join(name, "; ").alias(name) for name in ("silver_reasons", "gold_reasons")])


@REGISTRY.add(with_gold("""
    SELECT layer, reason, count(*) AS n FROM (
      SELECT 'silver' AS layer, unnest(silver_reasons) AS reason FROM reasoned
      UNION ALL SELECT 'gold', unnest(gold_reasons) FROM reasoned)
    GROUP BY layer, reason""", reasoned=_REASONED))
def drop_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reason_histogram(_reasoned(spark, sf_dir))


@REGISTRY.add(with_gold("""
    SELECT layer, rule, count(*) FILTER (WHERE hit) AS n, count(*) FILTER (WHERE hit AND hits = 1) AS alone
    FROM (SELECT *, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY id, layer) AS hits FROM (
        SELECT id, unnest([{'layer': 'silver', 'rule': 'language', 'hit': original_language <> 'F'},
                           {'layer': 'silver', 'rule': 'adult', 'hit': adult},
                           {'layer': 'silver', 'rule': 'no date', 'hit': release_date IS NULL},
                           {'layer': 'silver', 'rule': 'too early', 'hit': coalesce(release_date < DATE '1996-01-01', false)},
                           {'layer': 'silver', 'rule': 'too late', 'hit': coalesce(release_date > DATE '2000-06-30', false)},
                           {'layer': 'gold', 'rule': 'budget', 'hit': budget < 10000},
                           {'layer': 'gold', 'rule': 'revenue', 'hit': revenue <= 0}], recursive := true) FROM movies))
    GROUP BY layer, rule"""))
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rule_counts(order_movies(spark, sf_dir), min_budget=MIN_BUDGET, **SCOPE)


@REGISTRY.add(with_gold("""
    SELECT m.id, 1 AS in_bronze, CAST(in_scope AS INTEGER) AS in_silver,
           CAST(priced AS INTEGER) AS in_gold,
           CASE WHEN in_scope THEN 'keep' ELSE 'drop' END AS silver_expected,
           array_to_string(silver_reasons, '; ') AS why_not_silver,
           CASE WHEN priced THEN 'keep' ELSE 'drop' END AS gold_expected,
           array_to_string(gold_reasons, '; ') AS why_not_gold,
           CASE WHEN priced AND NOT in_scope THEN 'in Gold but not in Silver'
                ELSE 'consistent' END AS note
    FROM (SELECT id, """ + f"({IN_SCOPE_SQL})" + """ AS in_scope,
                 budget >= 10000 AND revenue > 0 AS priced FROM movies) m
    JOIN reasoned USING (id)""", reasoned=_REASONED))
def layer_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = order_movies(spark, sf_dir)
    kept = silver.silver_scope(everything, **SCOPE)
    # Gold is built from all orders, so it holds rows that Silver does not.
    built = order_gold(spark, sf_dir, ("movie_id",))
    traced = audit.trace_layers(everything, kept, built, min_budget=MIN_BUDGET, **SCOPE)
    return traced.withColumns({name: F.col(name).cast("int")
                               for name in ("in_bronze", "in_silver", "in_gold")})


@REGISTRY.add(with_gold("""
    SELECT id, title, original_title FROM movies
    WHERE contains(lower(title), lower('uRgEnt for 1')) OR
          contains(lower(original_title), lower('uRgEnt for 1'))
    ORDER BY id"""))
def title_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.title_search(order_movies(spark, sf_dir), "uRgEnt for 1").select(
        "id", "title", "original_title")


@REGISTRY.add(with_gold("""
    SELECT id, original_title FROM (SELECT id, replace(original_title, 'URGENT for 1', 'Straße ΣΑΣ ' || id) AS original_title FROM movies)
    WHERE contains(replace(replace(lower(original_title), 'ß', 'ss'), 'ς', 'σ'), 'strasse σασ 1')"""))
def title_search_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters that only full case folding makes equal."""
    movies = order_movies(spark, sf_dir).select("id", "title", F.replace(
        "original_title", F.lit("URGENT for 1"), F.concat(F.lit("Straße ΣΑΣ "), F.col("id").cast("string"))).alias("original_title"))
    return audit.title_search(movies, "STRASSE σας 1").select("id", "original_title")


_SNAPSHOT = ("SELECT CAST(user_id AS VARCHAR) AS path, count(*) AS rows, "
             "CAST(max(event_id) AS VARCHAR) AS stamp FROM events {where} GROUP BY user_id")


@REGISTRY.add(with_views("""
    SELECT path, b.rows AS rows_before, a.rows AS rows_after,
           b.stamp IS DISTINCT FROM a.stamp OR b.rows IS DISTINCT FROM a.rows AS changed
    FROM before b FULL JOIN after a USING (path)""",
    before=_SNAPSHOT.format(where="WHERE ts < TIMESTAMP '2024-01-30'"),
    after=_SNAPSHOT.format(where="")))
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def snapshot(events: DataFrame) -> DataFrame:
        return events.groupBy(F.col("user_id").cast("string").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.max("event_id").cast("string").alias("stamp"))
    events = table(spark, sf_dir, "events")
    day = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return audit.snapshot_changes(snapshot(events.where(F.col("ts") < day)), snapshot(events))


_RULES = {"start_year": START_YEAR, "min_budget": MIN_BUDGET, "language": LANGUAGE}


@REGISTRY.add(with_gold("""
    SELECT 'Language' AS rule, 'original_language = F' AS value, count(*) FILTER (WHERE original_language = 'F')
             AS passing FROM movies
    UNION ALL SELECT 'Adult content', 'excluded', count(*) FILTER (WHERE NOT adult) FROM movies
    UNION ALL SELECT 'Release window', '1996 to the run date',
             count(*) FILTER (WHERE release_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30') FROM movies
    UNION ALL SELECT 'Gold budget floor', 'budget >= 10,000', count(*) FILTER (WHERE budget >= 10000) FROM movies
    UNION ALL SELECT 'Gold revenue floor', 'revenue > 0', count(*) FILTER (WHERE revenue > 0) FROM movies
    UNION ALL SELECT unnest(['Media type', 'Release granularity', 'Candidate votes', 'Sample cap']),
             unnest(['films only', 'month', 'vote_count >= 10', '10,000']), CAST(NULL AS BIGINT)"""))
def scope_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule table next to how many orders pass each rule that tests rows, on its own."""
    passing = order_movies(spark, sf_dir).select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.coalesce(passes, F.lit(False)).alias("passes"))
        for rule, passes in {
            "Language": F.col("original_language") == LANGUAGE,
            "Adult content": ~F.col("adult"),
            "Release window": F.col("release_date").between(F.lit(dt.date(START_YEAR, 1, 1)),
                                                            F.lit(AS_OF)),
            "Gold budget floor": F.col("budget") >= MIN_BUDGET,
            "Gold revenue floor": F.col("revenue") > 0,
        }.items()
    ]))).groupBy("rule").agg(F.count_if("passes").alias("passing"))
    rules = audit.scope_constraints(spark, **_RULES)
    return rules.join(F.broadcast(passing), "rule", "left").select("rule", "value", "passing")
