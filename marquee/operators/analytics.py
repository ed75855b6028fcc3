"""Aggregate views over Gold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee import config
from marquee.functions import (
    hash_fraction, month_label, overlaps_any, roi_bucket,
)
from marquee.operators.quantiles import exact_quantiles
from marquee.session import materialize

# Metric name -> Gold column whose median is shown; None counts rows.
MATRIX_METRICS = {"median_roi": "roi", "median_revenue_musd": "revenue_musd", "count": None}


def _typed_empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def analytics_filter(gold: DataFrame, *, years: tuple[int, int] | None = None,
                     min_votes: int = 0, genres: Sequence[str] = ()) -> DataFrame:
    """Year range (inclusive), vote floor and any-match genre selection."""
    kept = gold.where(F.col("vote_count") >= min_votes)
    if years is not None:
        kept = kept.where(F.col("release_year").between(*years))
    return kept.where(overlaps_any(F.col("genres"), genres)) if genres else kept


def per_genre(df: DataFrame, *columns: str) -> DataFrame:
    """One row per list entry, under the name ``genre``; empty lists give no rows."""
    return (
        df.select(*columns, F.explode("genres").alias("genre"))
        .where(F.col("genre").isNotNull())
    )


def roi_by_genre(gold: DataFrame) -> DataFrame:
    """Mean ROI and number of movies per genre, best first."""
    if "genres" not in gold.columns:
        return _typed_empty(gold, "genre string, avg_roi double, n bigint")
    return (
        per_genre(gold, "roi").groupBy("genre")
        .agg(F.avg("roi").alias("avg_roi"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc_nulls_first("avg_roi"), "genre")
    )


def top_groups(gold: DataFrame, key: str, aggregates: dict[str, Column], *, order_by: str,
               n: int = config.LEADERBOARD_SIZE,
               min_rows: int = config.MIN_GROUP_ROWS) -> DataFrame:
    """The ``n`` groups with the largest ``order_by`` among those with ``min_rows`` rows.

    Ties are broken by the key, and the result never exceeds ``n`` rows.
    """
    return (
        gold.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_movies"),
             *[expression.alias(name) for name, expression in aggregates.items()])
        .where(F.col("n_movies") >= min_rows)
        .orderBy(F.desc_nulls_first(order_by), key)
        .limit(n)
    )


def top_directors(gold: DataFrame, *, n: int = config.LEADERBOARD_SIZE,
                  min_movies: int = config.MIN_GROUP_ROWS) -> DataFrame:
    """Directors by mean budget, with their mean rating."""
    if "director_name" not in gold.columns:
        return _typed_empty(gold, "director_name string, n_movies bigint, "
                                  "avg_budget_musd double, avg_vote_average double")
    return top_groups(
        gold, "director_name",
        {"avg_budget_musd": F.avg("budget_musd"), "avg_vote_average": F.avg("vote_average")},
        order_by="avg_budget_musd", n=n, min_rows=min_movies,
    )


def top_production_companies(gold: DataFrame, *, n: int = config.LEADERBOARD_SIZE,
                             min_movies: int = config.MIN_GROUP_ROWS) -> DataFrame:
    """Lead companies by mean revenue, with their exact median ROI.

    The ranking needs only sums and counts; medians are then worked out for the at
    most ``n`` companies that made the list. The list is stored, so the planner sees how
    small it is.
    """
    key = "lead_production_company"
    if key not in gold.columns:
        return _typed_empty(gold, f"{key} string, n_movies bigint, "
                                  "avg_revenue_musd double, median_roi double")
    leaders = materialize(
        top_groups(gold, key, {"avg_revenue_musd": F.avg("revenue_musd")},
                   order_by="avg_revenue_musd", n=n, min_rows=min_movies), "leaders")
    members = gold.select(key, "roi").join(leaders.select(key), key, "left_semi")
    medians = exact_quantiles(members, [key], "roi", {"median_roi": 0.5}, rows="_rows")
    return (
        leaders.join(medians.drop("_rows"), key, "left")
        .orderBy(F.desc_nulls_first("avg_revenue_musd"), key)
        .select(key, "n_movies", "avg_revenue_musd", "median_roi")
    )


def classify_roi(gold: DataFrame, *, hit: float = config.HIT_ROI,
                 flop: float = config.FLOP_ROI) -> DataFrame:
    """Add ``roi_bucket``; without a ``roi`` column the bucket is NULL."""
    if "roi" not in gold.columns:
        return gold.withColumn("roi_bucket", F.lit(None).cast("string"))
    return gold.withColumn("roi_bucket", roi_bucket(F.col("roi"), hit, flop))


def month_genre_matrix(gold: DataFrame, *, metric: str = "median_roi",
                       min_n: int = config.MIN_GROUP_ROWS) -> DataFrame:
    """Long-form release month x genre matrix of a median or a row count.

    Medians of cells with fewer than ``min_n`` rows are blanked; counts never are.
    """
    if metric not in MATRIX_METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {sorted(MATRIX_METRICS)}")
    if "genres" not in gold.columns:
        return _typed_empty(gold, "release_month int, genre string, value double, n bigint")
    keys = ["release_month", "genre"]
    source = MATRIX_METRICS[metric]
    if source is None:
        cells = (
            per_genre(gold, "release_month").where(F.col("release_month").isNotNull())
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("value", F.col("n").cast("double"))
        )
    else:
        rows = per_genre(gold, "release_month", source).where(F.col("release_month").isNotNull())
        cells = exact_quantiles(rows, keys, source, {"value": 0.5})
        if min_n > 0:
            cells = cells.withColumn("value", F.when(F.col("n") >= min_n, F.col("value")))
    return cells.select(*keys, "value", "n").orderBy(*keys)


def month_lookup(df: DataFrame) -> DataFrame:
    """The twelve (release_month, month_label) rows."""
    return df.sparkSession.createDataFrame(
        list(enumerate(config.MONTHS, start=1)), "release_month int, month_label string")


def with_month_labels(df: DataFrame) -> DataFrame:
    """Left join to the twelve month labels (a lookup of fixed size, hence broadcast)."""
    return df.join(F.broadcast(month_lookup(df)), "release_month", "left")


def month_labels(df: DataFrame) -> DataFrame:
    """The same labels as an expression, when no join is wanted."""
    return df.withColumn("month_label", month_label(F.col("release_month")))


SCATTER_COLUMNS = ("title", "director_name", "release_year", "budget_musd", "revenue_musd",
                   "roi", "roi_bucket")


def scatter_frame(gold: DataFrame, *, hit: float = config.HIT_ROI,
                  flop: float = config.FLOP_ROI) -> DataFrame:
    """Classified rows with positive budget and revenue."""
    return classify_roi(gold, hit=hit, flop=flop).where(
        (F.col("budget_musd") > 0) & (F.col("revenue_musd") > 0))


def seeded_sample(df: DataFrame, key: str, *, n: int = config.SCATTER_ROWS,
                  seed: int = 0) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the key: the same rows on any cluster."""
    return (
        df.withColumn("_draw", hash_fraction(F.col(key), f"sample-{seed}"))
        .orderBy("_draw", key).limit(n).drop("_draw")
    )


def bucket_counts(scatter: DataFrame) -> DataFrame:
    return (
        scatter.groupBy("roi_bucket").agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "roi_bucket")
    )


def reference_lines(scatter: DataFrame, *, hit: float = config.HIT_ROI) -> DataFrame:
    """End points of the break-even and the hit line over the budget range: four rows."""
    ends = scatter.agg(F.coalesce(F.min("budget_musd"), F.lit(0.1)).alias("low"),
                       F.coalesce(F.max("budget_musd"), F.lit(1.0)).alias("high"))
    hit_label = f"Hit line (roi={hit:g})"
    points = [
        F.struct(F.col(end).alias("budget_musd"),
                 (F.col(end) * factor).alias("revenue_musd"),
                 F.lit(label).alias("label"))
        for label, factor in (("Break-even", 1.0), (hit_label, 1.0 + hit))
        for end in ("low", "high")
    ]
    return ends.select(F.inline(F.array(*points)))
