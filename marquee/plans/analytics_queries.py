"""Aggregate views over Gold, on the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.operators import analytics
from marquee.plans.oracle_views import with_gold
from marquee.plans.order_tables import order_gold, stored_gold
from marquee.plans.registry import REGISTRY


def _matrix_sql(value: str, masked_below: int | None) -> str:
    shown = value if masked_below is None else (
        f"CASE WHEN count(*) >= {masked_below} THEN {value} END")
    return with_gold(f"""
        SELECT release_month, genre, round({shown}, 6) AS value, count(*) AS n,
               ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']
                 [release_month] AS month_label
        FROM by_genre GROUP BY release_month, genre""")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


@REGISTRY.add(with_gold("""
    SELECT genre, round(avg(roi), 6) AS avg_roi, count(*) AS n FROM by_genre GROUP BY genre"""))
def genre_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(analytics.roi_by_genre(order_gold(spark, sf_dir, ("genres", "roi"))),
                    "avg_roi")


@REGISTRY.add(with_gold("""
    SELECT director_name, count(*) AS n_movies, round(avg(budget_musd), 6) AS avg_budget_musd,
           round(avg(vote_average), 6) AS avg_vote_average
    FROM gold WHERE director_name IS NOT NULL
    GROUP BY director_name HAVING count(*) >= 3
    ORDER BY avg(budget_musd) DESC, director_name LIMIT 15"""))
def top_directors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = order_gold(spark, sf_dir, ("director_name", "budget_musd", "vote_average"))
    return _rounded(analytics.top_directors(gold), "avg_budget_musd", "avg_vote_average")


@REGISTRY.add(with_gold("""
    SELECT lead_production_company, count(*) AS n_movies,
           round(avg(revenue_musd), 6) AS avg_revenue_musd, round(median(roi), 6) AS median_roi
    FROM gold WHERE lead_production_company IS NOT NULL
    GROUP BY lead_production_company HAVING count(*) >= 3
    ORDER BY avg(revenue_musd) DESC, lead_production_company LIMIT 15"""))
def top_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = stored_gold(spark, sf_dir, ("lead_production_company", "revenue_musd", "roi"))
    return _rounded(analytics.top_production_companies(gold), "avg_revenue_musd", "median_roi")


def _matrix(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    columns = ("release_month", "genres", "roi", "revenue_musd")
    # A count needs one pass over Gold, a median two.
    build = order_gold if options.get("metric") == "count" else stored_gold
    gold = build(spark, sf_dir, columns)
    labelled = analytics.with_month_labels(analytics.month_genre_matrix(gold, **options))
    return _rounded(labelled, "value")


@REGISTRY.add(_matrix_sql("median(roi)", 3))
def month_genre_median_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, metric="median_roi")


@REGISTRY.add(_matrix_sql("median(revenue_musd)", 3))
def month_genre_median_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, metric="median_revenue_musd")


@REGISTRY.add(_matrix_sql("CAST(count(*) AS DOUBLE)", None))
def month_genre_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, metric="count")


@REGISTRY.add(_matrix_sql("median(roi)", 600))
def month_genre_thin_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, metric="median_roi", min_n=600)


@REGISTRY.add(with_gold("""
    SELECT release_month, count(*) AS n,
           ['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']
             [release_month] AS month_label
    FROM gold GROUP BY release_month"""))
def month_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = order_gold(spark, sf_dir, ("release_month",)).groupBy("release_month").agg(
        F.count(F.lit(1)).alias("n"))
    return analytics.month_labels(months)


_SCATTER_SQL = """
    SELECT movie_id, title, director_name, release_year, budget_musd, revenue_musd, roi,
           CASE WHEN roi <= 0 THEN 'Flop' WHEN roi >= 3 THEN 'Hit' ELSE 'Average' END
             AS roi_bucket
    FROM gold WHERE budget_musd > 0 AND revenue_musd > 0"""


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [c for c in analytics.SCATTER_COLUMNS if c != "roi_bucket"]
    return analytics.scatter_frame(order_gold(spark, sf_dir, ("movie_id", *columns)))


@REGISTRY.add(with_gold(
    "SELECT roi_bucket, count(*) AS count FROM scatter GROUP BY roi_bucket",
    scatter=_SCATTER_SQL))
def roi_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.bucket_counts(
        analytics.scatter_frame(order_gold(spark, sf_dir, ("budget_musd", "revenue_musd", "roi"))))


@REGISTRY.add(with_gold("""
    SELECT * FROM scatter
    ORDER BY CAST('0x' || substr(md5('sample-0:' || movie_id), 1, 8) AS BIGINT), movie_id
    LIMIT 6000""", scatter=_SCATTER_SQL))
def scatter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.seeded_sample(_scatter(spark, sf_dir), "movie_id")


@REGISTRY.add(with_gold("""
    SELECT low AS budget_musd, low AS revenue_musd, 'Break-even' AS label FROM ends
    UNION ALL SELECT high, high, 'Break-even' FROM ends
    UNION ALL SELECT low, low * 4.0, 'Hit line (roi=3)' FROM ends
    UNION ALL SELECT high, high * 4.0, 'Hit line (roi=3)' FROM ends""",
    scatter=_SCATTER_SQL,
    ends="SELECT min(budget_musd) AS low, max(budget_musd) AS high FROM scatter"))
def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reference_lines(
        analytics.scatter_frame(order_gold(spark, sf_dir, ("budget_musd", "revenue_musd", "roi"))))


@REGISTRY.add(with_gold("""
    SELECT movie_id, release_year, vote_count, array_to_string(genres, ', ') AS genres
    FROM gold
    WHERE release_year BETWEEN 1996 AND 1999 AND vote_count >= 3
      AND list_has_any(genres, ['PROMO', 'SMALL'])"""))
def analytics_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = order_gold(spark, sf_dir, ("movie_id", "release_year", "vote_count", "genres"))
    kept = analytics.analytics_filter(gold, years=(1996, 1999), min_votes=3,
                                      genres=("PROMO", "SMALL"))
    return kept.withColumn("genres", F.array_join("genres", ", "))
