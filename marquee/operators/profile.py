"""Looking at a table: filters, previews, bounds, profiles and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marquee import config
from marquee.functions import contains_text, overlaps_any
from marquee.operators.quantiles import exact_quantiles


def inspect_filter(gold: DataFrame, *, years: tuple[int, int] | None = None,
                   budget_musd: tuple[float, float] | None = None,
                   genres: Sequence[str] = (), director: str = "") -> DataFrame:
    """Inclusive ranges, any-match genres and a director substring, all optional."""
    kept = gold
    if years is not None:
        kept = kept.where(F.col("release_year").between(*years))
    if budget_musd is not None:
        kept = kept.where(F.col("budget_musd").between(*budget_musd))
    if genres:
        kept = kept.where(overlaps_any(F.col("genres"), genres))
    if director.strip():
        kept = kept.where(contains_text(F.col("director_name"), director.strip()))
    return kept


def preview(df: DataFrame, columns: Sequence[str], *, n: int = 100,
            order_by: str = "movie_id") -> DataFrame:
    """The first ``n`` rows by ``order_by``; between 10 and 1,000 rows may be asked for."""
    if not 10 <= n <= 1000:
        raise ValueError("a preview shows between 10 and 1000 rows")
    return df.orderBy(order_by).limit(n).select(*columns)


def filter_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value of each column, in one pass."""
    return df.agg(*[
        function(name).alias(f"{name}_{label}")
        for name in columns for label, function in (("min", F.min), ("max", F.max))
    ])


def distinct_elements(df: DataFrame, column: str, *, name: str = "value") -> DataFrame:
    """Sorted distinct elements of a list column."""
    return (
        df.select(F.explode(column).alias(name))
        .where(F.col(name).isNotNull())
        .distinct().orderBy(name)
    )


def element_counts(df: DataFrame, column: str, *, k: int, name: str = "value") -> DataFrame:
    """The ``k`` most frequent elements of a list column; ties go to the smaller name."""
    return (
        df.select(F.explode(column).alias(name))
        .where(F.col(name).isNotNull() & (F.col(name) != ""))
        .groupBy(name).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), name).limit(k)
    )


def top_values(df: DataFrame, column: str, *, limit: int = config.TOP_VALUES_LIMIT) -> DataFrame:
    """Most frequent values first, then by value. Empty text is dropped after the limit."""
    ranked = (
        df.where(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column).limit(limit)
    )
    return ranked.where(F.col(column) != "")


def headline(gold: DataFrame, *, approximate_directors: bool = False) -> DataFrame:
    """Rows, distinct directors, year range, median budget and median ROI: one row."""
    directors = (F.approx_count_distinct("director_name") if approximate_directors
                 else F.count_distinct("director_name"))
    totals = gold.agg(
        F.count(F.lit(1)).alias("movies"), directors.alias("directors"),
        F.min("release_year").alias("year_min"), F.max("release_year").alias("year_max"),
    )
    medians = _column_quantiles(gold, ("budget_musd", "roi"), {"median": 0.5}, "linear")
    spread = medians.agg(*[
        F.coalesce(F.max(F.when(F.col("column") == name, F.col("median"))), F.lit(0.0))
        .alias(f"median_{name}") for name in ("budget_musd", "roi")
    ])
    # Two one-row results laid over each other.
    both = totals.unionByName(spread, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


def describe(df: DataFrame, columns: Sequence[str] = config.DESCRIBED_COLUMNS, *,
             interpolation: str = "nearest") -> DataFrame:
    """Count, null count, mean, deviation, extremes and quartiles, one row per statistic."""
    columns = list(columns)
    measures = {
        "count": lambda c: F.count(c).cast("double"),
        "null_count": lambda c: F.count_if(F.col(c).isNull()).cast("double"),
        "mean": lambda c: F.avg(c),
        "std": lambda c: F.stddev_samp(c),
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    moments = df.agg(*[
        measure(name).alias(f"{label}|{name}")
        for label, measure in measures.items() for name in columns
    ])
    quartiles = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    by_column = _column_quantiles(df, columns, quartiles, interpolation)
    spread = by_column.agg(*[
        F.max(F.when(F.col("column") == name, F.col(label))).alias(f"{label}|{name}")
        for label in quartiles for name in columns
    ])
    order = ["count", "null_count", "mean", "std", "min", *quartiles, "max"]

    def laid_out(one_row: DataFrame, labels: Sequence[str]) -> DataFrame:
        return one_row.select(F.inline(F.array(*[
            F.struct(F.lit(order.index(label)).alias("_place"), F.lit(label).alias("statistic"),
                     *[F.col(f"`{label}|{name}`").alias(name) for name in columns])
            for label in labels
        ])))

    return (
        laid_out(moments, list(measures)).unionByName(laid_out(spread, list(quartiles)))
        .orderBy("_place").drop("_place")
    )


def _column_quantiles(df: DataFrame, columns: Sequence[str], quantiles: dict[str, float],
                      interpolation: str) -> DataFrame:
    """Quantiles of several columns at once: (column, n, <quantiles>)."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("value"))
        for name in columns
    ])))
    return exact_quantiles(long, ["column"], "value", quantiles, interpolation=interpolation)
