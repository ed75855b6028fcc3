import pytest
from pyspark.sql import functions as F

from marquee.operators import analytics, profile
from marquee.sources.sinks import csv_frame

FRAME = ("title string, release_year int, release_month int, budget_musd double, "
         "revenue_musd double, roi double, vote_average double, vote_count bigint, "
         "director_name string, lead_production_company string, genres array<string>, movie_id bigint")


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([
        ("Tide", 1994, 3, 12.0, 18.0, 0.5, 5.5, 40, "Ines Roth", "Northlight", ["Mystery"], 11),
        ("Kiln", 1994, 3, 8.0, 2.0, -0.75, 4.0, 8, "Ines Roth", "Northlight", ["Mystery", "War"], 12),
        ("Salt", 1999, 3, 16.0, 56.0, 2.5, 6.5, 120, "Oskar Lind", "Harbour", ["War"], 13),
        ("Reed", 2003, 9, 25.0, 100.0, 3.0, 8.0, 300, "Oskar Lind", "Harbour", ["Mystery", "Western"], 14),
        ("Loom", 2003, 9, 4.0, 22.0, 4.5, 6.5, 65, "Oskar Lind", "Northlight", ["Western"], 15),
        ("Fern", 2011, 10, 90.0, 180.0, 1.0, 6.0, 210, "Priya Nair", "Cobalt", ["War"], 16),
        ("Dusk", 2011, 10, 30.0, 45.0, 0.5, 9.0, 15, "Teo Vance", "Cobalt", ["Mystery"], 17),
    ], FRAME)


def test_roi_by_genre(gold):
    rows = [tuple(row) for row in analytics.roi_by_genre(gold).collect()]
    assert rows == [("Western", 3.75, 2), ("War", pytest.approx(2.75 / 3), 3), ("Mystery", 0.8125, 4)]


def test_leaderboards(gold):
    directors = analytics.top_directors(gold, min_movies=2).collect()
    assert [row.director_name for row in directors] == ["Oskar Lind", "Ines Roth"]
    assert (directors[0].avg_budget_musd, directors[0].avg_vote_average, directors[0].n_movies) == (
        15.0, 7.0, 3)
    companies = analytics.top_production_companies(gold, min_movies=2).collect()
    assert [row.lead_production_company for row in companies] == ["Cobalt", "Harbour", "Northlight"]
    assert companies[0].avg_revenue_musd == 112.5 and companies[1].median_roi == 2.75
    assert companies[2].median_roi == 0.5
    assert analytics.top_directors(gold, n=1, min_movies=1).first().director_name == "Priya Nair"


def test_buckets(spark):
    frame = spark.createDataFrame([(-0.5,), (0.0,), (1.5,), (3.0,), (5.0,), (None,)], "roi double")
    found = [row.roi_bucket for row in analytics.classify_roi(frame).collect()]
    assert found == ["Flop", "Flop", "Average", "Hit", "Hit", "Average"]
    assert analytics.classify_roi(frame.drop("roi").withColumn("x", F.lit(1))).first().roi_bucket is None


def test_matrix(gold):
    cells = {(r.release_month, r.genre): r for r in analytics.month_genre_matrix(gold).collect()}
    assert cells[(3, "War")].value is None and cells[(3, "War")].n == 2
    assert cells[(3, "Mystery")].value is None
    loose = {(r.release_month, r.genre): r.value
             for r in analytics.month_genre_matrix(gold, min_n=0).collect()}
    assert loose[(9, "Western")] == 3.75 and loose[(3, "War")] == 0.875
    counts = {(r.release_month, r.genre): r.value
              for r in analytics.month_genre_matrix(gold, metric="count").collect()}
    assert counts[(3, "Mystery")] == 2.0 and counts[(10, "War")] == 1.0
    with pytest.raises(ValueError):
        analytics.month_genre_matrix(gold, metric="mean_roi")


def test_month_labels_agree(gold):
    months = gold.select("release_month").distinct()
    joined = {tuple(r) for r in analytics.with_month_labels(months).collect()}
    assert joined == {tuple(r) for r in analytics.month_labels(months).collect()}
    assert (10, "Oct") in joined


def test_missing_columns_give_typed_empty_results(gold):
    bare = gold.select("title")
    for result in (analytics.roi_by_genre(bare), analytics.top_directors(bare),
                   analytics.top_production_companies(bare), analytics.month_genre_matrix(bare)):
        assert result.count() == 0 and len(result.columns) >= 3


def test_empty_input(gold):
    none = gold.where("1 = 0")
    assert analytics.roi_by_genre(none).count() == 0
    assert analytics.month_genre_matrix(none).count() == 0
    assert analytics.top_production_companies(none).count() == 0
    row = profile.headline(none).first()
    assert row.movies == 0 and row.median_roi == 0.0


def test_scatter_sample_and_lines(gold):
    scatter = analytics.scatter_frame(gold)
    assert scatter.count() == 7
    few = analytics.seeded_sample(scatter, "movie_id", n=3)
    again = analytics.seeded_sample(scatter.repartition(5), "movie_id", n=3)
    assert few.count() == 3 and sorted(map(str, few.collect())) == sorted(map(str, again.collect()))
    assert {r.roi_bucket: r["count"] for r in analytics.bucket_counts(scatter).collect()} == {
        "Average": 4, "Hit": 2, "Flop": 1}
    lines = [tuple(r) for r in analytics.reference_lines(scatter, hit=2.5).collect()]
    assert lines == [(4.0, 4.0, "Break-even"), (90.0, 90.0, "Break-even"),
                     (4.0, 14.0, "Hit line (roi=2.5)"), (90.0, 315.0, "Hit line (roi=2.5)")]


def test_filters(gold):
    assert analytics.analytics_filter(gold, years=(2003, 2011), min_votes=100).count() == 2
    assert analytics.analytics_filter(gold, genres=("War", "Western")).count() == 5
    assert analytics.analytics_filter(gold, genres=()).count() == 7
    assert profile.inspect_filter(gold, budget_musd=(12, 30), genres=["Mystery"]).count() == 3
    assert profile.inspect_filter(gold, director=" oSk ").count() == 3
    assert profile.inspect_filter(gold, director="o.k").count() == 0


def test_profile(gold):
    rows = {r.statistic: r for r in profile.describe(gold, ["roi", "vote_count"]).collect()}
    assert list(rows) == ["count", "null_count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert rows["count"].roi == 7.0 and rows["50%"].vote_count == 65.0 and rows["50%"].roi == 1.0
    line = profile.headline(gold).first()
    assert (line.movies, line.directors, line.year_min, line.median_budget_musd, line.median_roi) == (
        7, 4, 1994, 16.0, 1.0)
    bounds = profile.filter_bounds(gold, ["release_month"]).first()
    assert tuple(bounds) == (3, 10)
    assert [r.value for r in profile.distinct_elements(gold, "genres").collect()] == [
        "Mystery", "War", "Western"]
    with pytest.raises(ValueError):
        profile.preview(gold, ["title"], n=5)
    assert [r.title for r in profile.preview(gold, ["title"], n=10).collect()][:2] == ["Tide", "Kiln"]


def test_top_values_drop_empty_text_after_the_limit(spark):
    frame = spark.createDataFrame([("",), ("",), ("b",), ("a",), (None,)], "name string")
    assert [r.name for r in profile.top_values(frame, "name", limit=2).collect()] == ["a"]
    assert [r.name for r in profile.top_values(frame, "name").collect()] == ["a", "b"]


def test_csv_frame_joins_lists(gold):
    assert csv_frame(gold).where("movie_id = 14").first().genres == "Mystery, Western"
