"""Regression metrics, importances and their tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee import config
from marquee.modeling.boosting import variant_errors
from marquee.session import materialize

METRICS = ("r2", "mae", "rmse")
#: Rows that are ordered in one task, about.
ROWS_PER_RANGE = 20_000


def _metric_columns(actual: str, predicted: str) -> list[Column]:
    y, p = F.col(actual), F.col(predicted)
    residual = F.sum((y - p) * (y - p))
    return [
        (1 - F.try_divide(residual, F.count(y) * F.var_pop(y))).alias("r2"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
    ]


def regression_metrics(df: DataFrame, *, actual: str = "y_true", predicted: str = "y_pred",
                       by: tuple[str, ...] = ()) -> DataFrame:
    """Unweighted R2, MAE and RMSE, overall or per group, in one aggregate."""
    return (df.groupBy(*by) if by else df.groupBy()).agg(*_metric_columns(actual, predicted))


def money_metrics(df: DataFrame, *, actual: str = "y_true", predicted: str = "y_pred",
                  floor: float = 1.0) -> DataFrame:
    """MAE and RMSE in original units; MAPE over rows with actual >= ``floor``, else NaN."""
    y, p = F.col(actual), F.col(predicted)
    relative = F.avg(F.when(y >= floor, F.abs(y - p) / y))
    return df.agg(
        F.avg(F.abs(y - p)).alias("mae_musd"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse_musd"),
        F.coalesce(relative, F.lit(float("nan"))).alias("mape_over_1M"),
    )


def axis_bounds(df: DataFrame, *, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Common lower and upper bound of actual and predicted values."""
    return df.agg(F.least(F.min(actual), F.min(predicted)).alias("low"),
                  F.greatest(F.max(actual), F.max(predicted)).alias("high"))


def long_metrics(one_row: DataFrame, target: str, split: str) -> DataFrame:
    """(target, split, metric, value) rows of a one-row metrics frame."""
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(target).alias("target"), F.lit(split).alias("split"),
                 F.lit(name).alias("metric"), F.col(name).cast("double").alias("value"))
        for name in one_row.columns
    ])))


def top_importances(importance: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` most important features, for a report."""
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(n)


def stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def wide_metrics(metrics: DataFrame) -> DataFrame:
    """One row per (target, split) with R2, MAE and RMSE side by side."""
    return metrics.where(F.col("metric").isin(*METRICS)).groupBy("target", "split").agg(*[
        F.max(F.when(F.col("metric") == name, F.col("value"))).alias(name) for name in METRICS])


def _in_ranges(df: DataFrame, values: str, *, key: str, repeats: int, seed: int, groups: int) -> DataFrame:
    """Every row once per ``repeat`` with its range ``_group``, the ``donor`` values of the next row
    of the range, NULL for the last, and whether it is the ``_first``."""
    spread = df.withColumn("repeat", F.explode(F.array(*[F.lit(r) for r in range(repeats)])))
    mark = F.md5(F.concat_ws(":", F.lit(f"donor-{seed}"), F.col("repeat"), F.col(key)).cast("binary"))
    start = F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint")
    dealt = spread.withColumn("_mark", mark).withColumn(
        "_group", F.shiftright(start * F.lit(groups).cast("bigint"), 32))
    order = Window.partitionBy("repeat", "_group").orderBy("_mark", key)
    return dealt.withColumns({"donor": F.lead(values).over(order), "_first": F.row_number().over(order) == 1})


def _next_head(head: str) -> Column:
    """The ``head`` of the next range that has rows, on the circle of a repeat's ranges."""
    circle = Window.partitionBy("repeat").orderBy("_group")
    everything = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lead(head).over(circle), F.first(head).over(everything))


def with_donor(df: DataFrame, *, key: str, repeats: int, seed: int, groups: int) -> DataFrame:
    """Pair every row, once per repeat, with the features of a random other row.

    In each repeat the rows are ordered by the MD5 of the key (equal ones by the key) and
    closed into one circle: the donor is the next row on it. Every row is donor exactly once,
    so a column taken from the donors is a permutation of the original. ``groups`` ranges of
    the MD5 are ordered apart, and the last row of each takes the first of the next range that
    has any; how many there are doesn't change the result.
    """
    stored = materialize(_in_ranges(df, "features", key=key, repeats=repeats, seed=seed, groups=groups), "donors")
    # One row per repeat and range: a small table, whatever the number of rows.
    heads = stored.where("_first").select("repeat", "_group", _next_head("features").alias("_next"))
    columns = [*df.columns, "repeat", "donor"]
    inner = stored.where("donor is not null").select(*columns)
    last = stored.where("donor is null").drop("donor").join(heads, ["repeat", "_group"])
    return inner.unionByName(last.withColumnRenamed("_next", "donor").select(*columns))


def permutation_importance(holdout: DataFrame, predict: Callable[[DataFrame], DataFrame],
                           names: list[str], *, key: str = "movie_id", repeats: int = 5,
                           seed: int = config.SEED, vectors: bool = True,
                           trees: Sequence[tuple] | None = None) -> DataFrame:
    """Drop in R2 when one feature is shuffled: (feature, importance_mean, importance_std).

    ``holdout`` has the key, ``y_true`` and ``features`` (array of double); ``predict``
    adds ``y_pred`` from ``features``, a vector unless ``vectors`` is false. All variants of all features are
    scored in one job. Where ``predict`` is a sum of weighted ``trees``, a variant is scored by what it changes.
    """
    ready = array_to_vector if vectors else (lambda values: values)
    groups = max(1, holdout.count() // ROWS_PER_RANGE)
    paired = with_donor(holdout, key=key, repeats=repeats, seed=seed, groups=groups)
    intact = predict(holdout.select("y_true", ready(F.col("features")).alias("features")))
    if trees is not None:
        n, variance = holdout.agg(F.count("y_true"), F.var_pop("y_true")).first()
        worse = variant_errors(paired, trees, len(names)).select("_index", "repeat", (
            1 - F.try_divide("total", F.lit(n * variance if n else None).cast("double"))).alias("r2"))
        return _losses(worse, regression_metrics(intact).first()["r2"], names)
    variants = paired.select(
        "y_true", "repeat", "features", "donor",
        F.explode(F.array(*[F.lit(index) for index in range(len(names))])).alias("_index"))
    shuffled = F.transform("features", lambda value, position: F.when(
        position == F.col("_index"), F.get("donor", position)).otherwise(value))
    scored = predict(variants.select("y_true", "repeat", "_index",
                                     ready(shuffled).alias("features")))
    worse = regression_metrics(scored, by=("_index", "repeat")).select("_index", "repeat", "r2")
    return _losses(worse, regression_metrics(intact).first()["r2"], names)


def linear_importance(holdout: DataFrame, factors: Sequence[float], intercept: float, names: list[str], *,
                      key: str = "movie_id", repeats: int = 5, seed: int = config.SEED) -> DataFrame:
    """:func:`permutation_importance` of the model ``intercept`` + ``factors`` times ``features``.

    Shuffling one feature moves a prediction by the donor's term minus the row's own, so every pair
    of rows is met once for all features. Each range is summed where it was ordered; the sums, first
    and last row of a range are all that is stored.
    """
    own = [F.get("features", F.lit(place)) * F.lit(float(factor)) for place, factor in enumerate(factors)]
    rows = holdout.select(key, "y_true", F.array(*own).alias("terms"),
                          (F.col("y_true") - sum(own, F.lit(float(intercept)))).alias("error"))
    n, variance, intact = rows.agg(
        F.count("y_true"), F.var_pop("y_true"), F.sum(F.col("error") * F.col("error"))).first()
    scale = n * variance if n else None

    def residuals(error: Column, terms: Column, donor: Column) -> list[Column]:
        moved = [error - (F.get(donor, F.lit(place)) - F.get(terms, F.lit(place))) for place in range(len(names))]
        return [F.coalesce(F.sum(left * left), F.lit(0.0)) for left in moved]

    paired = _in_ranges(rows.drop("y_true"), "terms", key=key, repeats=repeats, seed=seed,
                        groups=max(1, n // ROWS_PER_RANGE))
    inner = residuals(F.col("error"), F.col("terms"), F.col("donor"))
    ranges = materialize(paired.groupBy("repeat", "_group").agg(
        F.array(*inner).alias("inner"), F.max(F.when(F.col("_first"), F.col("terms"))).alias("head"),
        F.max(F.when(F.col("donor").isNull(), F.struct("error", "terms"))).alias("tail")), "ranges")
    closed = ranges.withColumn("next", _next_head("head"))
    last = residuals(F.col("tail.error"), F.col("tail.terms"), F.col("next"))
    totals = closed.groupBy("repeat").agg(F.array(*[
        F.sum(F.get("inner", F.lit(place))) + column for place, column in enumerate(last)]).alias("totals"))
    worse = totals.select("repeat", F.posexplode("totals").alias("_index", "_total")).select(
        "repeat", "_index", (1 - F.try_divide("_total", F.lit(scale).cast("double"))).alias("r2"))
    return _losses(worse, 1 - intact / scale if scale else None, names)


def _losses(worse: DataFrame, base: float | None, names: list[str]) -> DataFrame:
    """Mean and deviation of ``base`` minus the R2 of all repeats, per feature, the largest first."""
    labels = F.array(*[F.lit(name) for name in names])
    return (
        worse.groupBy("_index").agg(
            (F.lit(base).cast("double") - F.avg("r2")).alias("importance_mean"),
            F.stddev_pop("r2").alias("importance_std"))
        .select(F.get(labels, F.col("_index")).alias("feature"), "importance_mean",
                "importance_std")
        .orderBy(F.desc("importance_mean"), "feature")
    )
