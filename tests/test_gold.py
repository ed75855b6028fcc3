import datetime as dt

import pytest
from conftest import film, store
from pyspark.sql import functions as F

from marquee import config
from marquee.operators import gold as operators
from marquee.plans import medallion
from marquee.session import shared_folder
from marquee.sources.sinks import overwrite_table
from marquee.sources.tables import (
    MissingTable, read_gold, read_gold_for_analytics, read_silver, row_count, schema_listing,
)

AS_OF = dt.date(2024, 1, 1)


def built(spark, layout, *documents):
    store(layout, *documents)
    medallion.build_silver(spark, layout, as_of=AS_OF)
    return medallion.build_gold(spark, layout)


def test_scope_and_money(spark, layout):
    counts = built(spark, layout, film(10, budget=50_000), film(11, revenue=0),
                   film(12, budget=1_000_000, revenue=5_000_000))
    assert counts == {"silver_movies": 3, "gold_movies": 1, "dropped": 2}
    row = read_gold(spark, layout.gold).first()
    assert (row.movie_id, row.budget_musd, row.revenue_musd, row.roi) == (12, 1.0, 5.0, 4.0)
    assert read_gold(spark, layout.gold).columns == list(config.GOLD_COLUMNS)
    summary = operators.build_counts(read_silver(spark, layout.silver("movies"), "movies")).first()
    assert summary.asDict() == counts


def test_people_and_company_picks(spark, layout):
    built(spark, layout, film(1, credits={
        "cast": [{"order": 1, "id": 901, "name": "B"}, {"order": 0, "id": 900, "name": "A"}],
        "crew": [{"job": "Producer", "id": 801, "name": "P"}, {"job": "Director", "id": 800, "name": "D"},
                 {"job": "Director", "id": 799, "name": "Other"}]},
        production_companies=[{"name": "First"}, {"name": "Alpha"}]))
    row = read_gold(spark, layout.gold).first()
    assert (row.director_id, row.director_name) == (800, "D")
    assert (row.lead_cast_id, row.lead_cast_name) == (900, "A")
    assert row.lead_production_company == "First"


def test_movies_without_people_stay(spark, layout):
    built(spark, layout, film(1, credits={}, production_companies=[]))
    row = read_gold(spark, layout.gold).first()
    assert row.director_id is None and row.lead_cast_id is None
    assert row.lead_production_company is None


def test_unneeded_joins_are_left_out(spark, layout):
    built(spark, layout, film(1))
    tables = [read_silver(spark, layout.silver(name), name) for name in ("movies", "cast", "crew")]
    slim = operators.build_gold(*tables, columns=("movie_id", "roi"))
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "crew.parquet" not in plan
    assert slim.first().roi == 2.5


def test_result_does_not_depend_on_partitioning(spark, layout):
    built(spark, layout, *[film(n, budget=100_000 * n) for n in range(1, 8)])
    tables = [read_silver(spark, layout.silver(name), name) for name in ("movies", "cast", "crew")]
    one = operators.build_gold(*[t.repartition(1) for t in tables])
    many = operators.build_gold(*[t.repartition(7) for t in tables])
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_counts_and_column_subset(spark, layout):
    assert row_count(spark, layout.gold) is None
    with pytest.raises(MissingTable):
        read_gold(spark, layout.gold, required=True)
    assert read_gold(spark, layout.gold).count() == 0
    built(spark, layout, film(1))
    assert row_count(spark, layout.gold) == 1
    slim = read_gold_for_analytics(spark, layout.gold)
    assert slim.columns == list(config.ANALYTICS_COLUMNS)
    listing = {row.column: row.dtype for row in schema_listing(slim).collect()}
    assert listing["genres"] == "array<string>" and listing["roi"] == "double"


def test_filters_reach_the_scan(spark, layout):
    built(spark, layout, film(1), film(2))
    plan = read_gold(spark, layout.gold).where(F.col("movie_id") == 2).select("roi")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(movie_id,2)" in text and "ReadSchema: struct<movie_id:bigint,roi:double>" in text


def test_failed_rewrite_keeps_the_table(spark, tmp_path):
    uri = str(tmp_path / "kept.parquet")
    overwrite_table(spark.range(5), uri)
    overwrite_table(spark.range(7), uri)
    with pytest.raises(Exception, match="broken row"):
        overwrite_table(spark.range(9).select(
            F.when(F.col("id") < 8, F.col("id")).otherwise(F.raise_error(F.lit("broken row"))).alias("id")), uri)
    assert spark.read.parquet(uri).count() == 7
    assert [path.name for path in tmp_path.iterdir()] == ["kept.parquet"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="shared folder"):
        shared_folder(Session())
