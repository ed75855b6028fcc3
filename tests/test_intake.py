import datetime as dt

from conftest import bodies
from pyspark.sql import functions as F

from marquee.functions import id_prefix
from marquee.operators import intake
from marquee.sources.sinks import retain_pages, write_manifest

PAGES = "page int, total_pages int, results array<struct<id:bigint>>"


def pages(spark):
    return spark.createDataFrame([
        (1, 5, [(101,), (102,), (101,), (None,)]), (2, 5, [(102,), (103,)]), (3, 5, []),
    ], PAGES)


def test_first_listing_wins_and_cap(spark):
    entries = intake.page_entries(pages(spark), max_pages=3)
    assert [r.id for r in intake.candidate_cap(entries).collect()] == [101, 102, 103]
    assert [r.id for r in intake.candidate_cap(entries, cap=2).collect()] == [101, 102]
    assert intake.page_entries(pages(spark), max_pages=1).count() == 3


def test_second_run_fetches_nothing(spark):
    candidates = intake.candidate_cap(intake.page_entries(pages(spark)))
    nothing = spark.createDataFrame([], "id bigint")
    results = spark.createDataFrame([(101, None), (102, None), (103, None)], "id bigint, error string")
    first = {r.outcome: r.n for r in intake.outcome_counts(
        intake.outcomes(candidates, nothing, results)).collect()}
    assert first == {"fetched": 3}
    landed = results.select("id")
    assert intake.new_ids(candidates, landed).count() == 0
    assert intake.known_ids(candidates, landed).count() == 3
    again = intake.outcomes(candidates, landed, results.where("1 = 0"))
    assert {r.outcome: r.n for r in intake.outcome_counts(again).collect()} == {"skipped": 3}


def test_manifest(spark, layout):
    candidates = intake.candidate_cap(intake.page_entries(pages(spark)))
    results = spark.createDataFrame([(101, None), (103, "timeout")], "id bigint, error string")
    done = intake.outcomes(candidates, spark.createDataFrame([(102,)], "id bigint"), results)
    manifest = intake.run_manifest(done, run_timestamp="t", filters={"language": "en"}, target=3)
    row = manifest.first()
    assert row.discovered_ids == [101, 102, 103] and row.errors == ["id=103: timeout"]
    assert (row.fetched, row.skipped, row.failed) == (1, 1, 1)
    assert row.filters == {"language": "en"} and row.save_discover_pages is False
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        write_manifest(manifest, layout.manifests, day)
    stored = spark.read.parquet(layout.manifests)
    assert sorted(str(r.run_date) for r in stored.collect()) == ["2024-01-01", "2024-01-02"]


def test_errors_are_cut_to_the_first_fifty(spark):
    entries = spark.range(80).select("id", F.lit(1).alias("page"), F.col("id").alias("pos"))
    results = entries.select("id", F.lit("bad").alias("error"))
    done = intake.outcomes(entries, spark.createDataFrame([], "id bigint"), results)
    row = intake.run_manifest(done, run_timestamp="t", filters={}).first()
    assert row.failed == 80 and len(row.errors) == 50 and row.errors[49] == "id=49: bad"


def test_pages_are_kept_only_when_asked(spark, layout):
    retain_pages(pages(spark), layout.discover, "2024-01-01", enabled=False)
    retain_pages(pages(spark), layout.discover, "2024-01-01")
    assert spark.read.json(layout.discover).count() == 3


def test_discover_scope(spark):
    day = dt.date(2000, 1, 1)
    frame = spark.createDataFrame([
        (1, "en", False, day, 10, 5.0), (2, "en", False, day, 10, 9.0), (3, "en", False, day, 9, 1.0),
        (4, "fr", False, day, 99, 1.0), (5, "en", True, day, 99, 1.0),
        (6, "en", False, dt.date(1979, 12, 31), 99, 1.0), (7, "en", False, None, 99, 1.0),
    ], "id bigint, original_language string, adult boolean, release_date date, vote_count bigint, "
       "popularity double")
    kept = intake.discover_scope(frame, as_of=dt.date(2024, 1, 1)).collect()
    assert [r.id for r in kept] == [2, 1]


def test_quarantine_names_the_reason(spark):
    good, bad = intake.split_readable(bodies(
        spark, {"id": 1}, '{"id": 2', {"name": "x"}, {"id": "3"}, {"id": None}, "[1]"))
    assert good.count() == 1
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["id is not a whole number", "no id", "no id", "no id", "not valid JSON"]


def test_prefixes_keep_their_zeros(spark):
    frame = spark.createDataFrame([(7,), (5_999,), (1_234_567,)], "id bigint")
    assert [r[0] for r in frame.select(id_prefix(F.col("id"))).collect()] == ["000", "005", "1234"]


def test_ids_beyond_the_target_are_a_table_and_no_cut_list(spark, layout):
    from marquee.sources.sinks import write_discovered

    entries = spark.range(80).select("id", F.lit(1).alias("page"), F.col("id").alias("pos"))
    done = intake.outcomes(entries, entries.select("id").where("id < 30"), entries.select(
        "id", F.lit(None).cast("string").alias("error")))
    row = intake.run_manifest(done, run_timestamp="t", filters={}, target=79).first()
    assert (row.skipped, row.fetched, row.failed, row.discovered_ids) == (30, 50, 0, None)
    row = intake.run_manifest(done, run_timestamp="t", filters={}, target=80).first()
    assert row.discovered_ids == list(range(80))
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        write_discovered(intake.discovered(done), layout.discovered, day)
    stored = spark.read.parquet(layout.discovered)
    assert sorted(r.id for r in stored.where("run_date = '2024-01-02'").collect()) == list(range(80))
    assert stored.count() == 160


def test_a_run_judges_all_candidates(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.01"
    users = spark.read.parquet(f"{folder}/events.parquet").select("user_id").distinct().count()
    assert users > 120
    assert sum(r.n for r in queries()["all_outcome_counts"](spark, folder).collect()) == users
    assert queries()["all_discovered"](spark, folder).count() == users
