"""Every registered query with an SQL twin must agree with it on the smallest data set."""

import duckdb
import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    with duckdb.connect() as opened:
        opened.execute("SET TimeZone='UTC'")
        for name in check.TABLES:
            opened.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
        yield opened


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_agrees_with_sql(spark, connection, name):
    message, _, good = check.compare(spark, connection, SF_DIR, name, queries()[name],
                                     oracle_sql()[name])
    assert good, message


def test_entry_runs(spark):
    assert entry(spark).columns == ["genre", "avg_roi", "n"] and entry(spark).count() > 0


def test_every_twin_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_silver_tables_parse_each_document_once(spark):
    from marquee.plans import layer_queries
    counted = layer_queries.silver_tables(spark, "/root/testdata/sf0.001")
    assert "parseJson(" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_landing_reads_as_many_files_as_there_are_rows_for(spark, monkeypatch):
    from marquee.plans import landing_queries
    asked, stream = [], landing_queries.landing.document_stream

    def watched(spark, uri, **options):
        asked.append((spark.read.text(uri, wholetext=True).count(), options["max_files"]))
        return stream(spark, uri, **options)

    monkeypatch.setattr(landing_queries.landing, "document_stream", watched)
    monkeypatch.setattr(landing_queries, "ROWS_PER_FILE", 100)
    sf_dir = "/root/testdata/sf0.001"
    landed = landing_queries.landing_two_runs(spark, sf_dir).collect()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id").collect()
    first = {e.user_id for e in events if e.event_id % 4 < 2}
    assert sorted((r.id, r.run) for r in landed) == sorted(
        {(e.user_id, 1 if e.user_id in first else 2) for e in events})
    files = sum(e.event_id % 4 < 2 for e in events)
    assert asked[0] == (-(-files // 100), -(-(-(-files // 100)) // 2)) and asked[0][0] > 2


def test_gold_scans_the_lines_once(spark):
    from marquee.plans import order_tables
    columns = ("movie_id", "genres", "revenue_musd", *order_tables.PEOPLE)
    once = order_tables.order_gold(spark, SF_DIR, columns)
    assert sum("lineitem.parquet" in line for line in
               once._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line) == 1
    apart = order_tables.gold.build_gold(
        order_tables.order_movies(spark, SF_DIR), order_tables.order_cast(spark, SF_DIR),
        order_tables.order_crew(spark, SF_DIR), min_budget=order_tables.MIN_BUDGET,
        director_job=order_tables.DIRECTOR_FLAG, columns=columns)
    assert sorted(map(repr, once.collect())) == sorted(map(repr, apart.collect()))
