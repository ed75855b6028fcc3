import datetime as dt
import time

import pytest
from conftest import film, store
from pyspark.sql import functions as F

from marquee import config
from marquee.operators import audit, silver
from marquee.plans import medallion
from marquee.sources import listing
from marquee.sources.documents import read_documents
from marquee.sources.layout import Layout
from marquee.sources.sinks import export_csv, publish
from marquee.sources.tables import read_gold, read_silver

AS_OF = dt.date(2024, 1, 1)


@pytest.fixture()
def built(spark, layout):
    store(layout, film(1), film(2, original_language="fr"), film(3, revenue=0),
          film(4, title="Get There", budget=5), film(5, original_title="gEt away", adult=True,
                                                      release_date="1960-01-01"))
    medallion.build_silver(spark, layout, as_of=AS_OF)
    medallion.build_gold(spark, layout)
    return layout


def test_trace(spark, built):
    docs = silver.parse_documents(read_documents(spark, built.documents))
    movies = read_silver(spark, built.silver("movies"), "movies")
    gold = read_gold(spark, built.gold)
    rows = {r.id: r for r in audit.trace_layers(docs, movies, gold, as_of=AS_OF).collect()}
    assert (rows[1].in_bronze, rows[1].in_silver, rows[1].in_gold, rows[1].note) == (
        1, 1, 1, "consistent")
    assert rows[2].silver_expected == "drop" and "language is fr" in rows[2].why_not_silver
    assert rows[2].in_silver == 0 and rows[2].note == "consistent"
    assert (rows[3].in_silver, rows[3].in_gold, rows[3].why_not_gold) == (1, 0, "no revenue")
    assert rows[5].why_not_silver == "adult content; released 1960-01-01, before 1980-01-01"

    broken = {r.id: r.note for r in audit.trace_layers(
        docs.unionByName(docs.where("id = 4")), movies.where("id <> 1"), gold.where("movie_id = 1"),
        as_of=AS_OF).collect()}
    assert broken[1] == "in Gold but not in Silver" and broken[4] == "held more than once"
    lost = {r.id: r.note for r in audit.trace_layers(
        docs, movies, gold.where("1 = 0"), as_of=AS_OF).collect()}
    assert lost[1] == "missing from Gold without a reason"


def test_reason_histogram(spark, built):
    docs = silver.parse_documents(read_documents(spark, built.documents))
    found = {(r.layer, r.reason): r.n
             for r in audit.reason_histogram(audit.drop_reasons(docs, as_of=AS_OF)).collect()}
    assert found[("gold", "no revenue")] == 1 and found[("gold", "budget below 100000")] == 1
    assert found[("silver", "adult content")] == 1


def test_title_search(spark, built):
    docs = silver.parse_documents(read_documents(spark, built.documents))
    assert [r.id for r in audit.title_search(docs, "GET").collect()] == [4, 5]
    assert audit.resolve_title(docs, "there") == 4
    for needle in ("get", "nothing like it"):
        with pytest.raises(LookupError):
            audit.resolve_title(docs, needle)


def test_inventory(spark, built):
    rows = audit.layer_inventory(spark, built).collect()
    assert [r.layer for r in rows] == list(config.LAYERS)
    by_layer = {r.layer: r for r in rows}
    assert by_layer["Bronze / discover"].files == 0 and by_layer["Bronze / discover"].rows is None
    assert by_layer["Bronze / movies"].rows == 5 and by_layer["Bronze / movies"].last_updated
    assert by_layer["Silver / movies"].rows == 3 and by_layer["Gold / gold_movies"].rows == 1
    assert by_layer["Silver / crew"].size_mb > 0


def test_snapshots_notice_a_rebuild(spark, built):
    taken = dt.datetime(2024, 1, 1)
    before = audit.table_snapshot(spark, built.gold, taken).collect()
    same = audit.table_snapshot(spark, built.gold, taken)
    frame = spark.createDataFrame(before, same.schema)
    assert audit.snapshot_changes(frame, same).first().changed is False
    time.sleep(0.01)
    store(built, film(9))
    medallion.build_silver(spark, built, as_of=AS_OF)
    medallion.build_gold(spark, built)
    row = audit.snapshot_changes(frame, audit.table_snapshot(spark, built.gold, taken)).first()
    assert row.changed and (row.rows_before, row.rows_after) == (1, 2)


def test_missing_table_has_a_stamp(spark, layout):
    files = listing.list_files(spark, layout.gold)
    assert listing.fingerprint(files).first().stamp == "missing"
    assert tuple(listing.file_stats(files).first()) == (0, 0, None)


def test_publish(spark, built, tmp_path):
    target = Layout(str(tmp_path / "elsewhere"), prefix="/team/films/")
    assert target.gold.endswith("elsewhere/team/films/gold/gold_movies.parquet")
    report = publish(spark, built, target).first()
    assert report.files > 5 and report.bytes > 0
    assert read_gold(spark, target.gold).count() == 1
    moved = read_documents(spark, target.documents)
    assert silver.parse_documents(moved).count() == 5
    assert (tmp_path / "elsewhere/team/films/bronze/movies/id_prefix=000/1.json.gz").read_bytes() == (
        tmp_path / "bronze/movies/id_prefix=000/1.json.gz").read_bytes()
    nothing = publish(spark, Layout(str(tmp_path / "void")), target).first()
    assert tuple(nothing) == (0, 0)
    with pytest.raises(ValueError):
        Layout("  ")


def test_csv_export(spark, built, tmp_path):
    export_csv(read_gold(spark, built.gold), str(tmp_path / "csv"))
    row = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert row.genres == "Mystery, War, Western" and row.title == "Harbour 1"


def test_scope_constraints(spark):
    rules = {r.rule: r.value for r in audit.scope_constraints(spark).collect()}
    assert rules["Gold budget floor"] == "budget >= 100,000" and rules["Sample cap"] == "10,000"
    assert rules["Candidate votes"] == "vote_count >= 10" and "1980" in rules["Release window"]


def test_missing_amounts_and_forbidden_gold_rows(spark, built):
    docs = silver.parse_documents(read_documents(spark, built.documents))
    movies = read_silver(spark, built.silver("movies"), "movies")
    gold = read_gold(spark, built.gold)
    without = movies.withColumn("budget", F.lit(None).cast(movies.schema["budget"].dataType))
    row = next(r for r in audit.trace_layers(docs.withColumn("budget", F.lit(None).cast(docs.schema["budget"].dataType)),
                                             without, gold, as_of=AS_OF).collect() if r.id == 1)
    assert row.gold_expected == "drop" and "budget below" in row.why_not_gold
    assert row.note == "in Gold against the rules"
    alone = {r.id: r for r in audit.trace_layers(docs.where("id <> 1"), movies, gold, as_of=AS_OF).collect()}
    assert alone[1].silver_expected == "unknown" and alone[1].note == "missing from Bronze"


def test_rule_counts_take_one_row_per_rule(spark):
    rows = [("en", False, dt.date(2005, 1, 1), 200_000, 5), ("fr", True, None, None, 0), ("fr", False, dt.date(1900, 1, 1), 5, None),
            (None, None, dt.date(2040, 1, 1), 200_000, 1), ("en", False, dt.date(2005, 1, 1), 200_000, 0)]
    movies = spark.createDataFrame(rows, "original_language string, adult boolean, release_date date, budget long, revenue long")
    got = {(r.layer, r.rule): (r.n, r.alone) for r in audit.rule_counts(movies, as_of=dt.date(2024, 1, 1)).collect()}
    assert got == {("silver", "language"): (3, 0), ("silver", "adult"): (2, 0), ("silver", "no date"): (1, 0),
                   ("silver", "too early"): (1, 0), ("silver", "too late"): (1, 0), ("gold", "budget"): (2, 0),
                   ("gold", "revenue"): (3, 1)}
    assert len(audit.rule_counts(movies.limit(0)).collect()) == 7


def test_titles_are_found_by_full_case_folding(spark):
    from marquee.functions import case_folded
    titles = ["Die Straße", "ΟΔΥΣΣΕΥΣ ΣΑΣ", "ﬁne", "İstanbul", "STRASSE", "plain", "ǅ", "ŉ", "Ꭰ", None]
    docs = spark.createDataFrame(list(enumerate(titles)), "id long, title string").withColumn("original_title", F.lit(None).cast("string"))

    def found(needle):
        return [r.id for r in audit.title_search(docs, needle).collect()]

    assert found("STRASSE") == [0, 4] and found("straße") == [0, 4] and found("σας") == [1] and found("FINE") == [2]
    folded = [r[0] for r in docs.orderBy("id").select(case_folded(F.col("title"))).collect()]
    assert folded == [None if t is None else t.casefold() for t in titles]
