"""Exact grouped quantiles that never gather a group.

The built-in exact ``median``/``percentile`` keeps every distinct value of a group in
one aggregation buffer, so a group holding a third of a very large table would have to
fit in one task. Here a group is spread out instead:

1. every value falls into a cell of a fixed, order-preserving grid (4,096 cells per
   doubling), and cells are counted per group - a small, map-side combined aggregate;
2. running totals over the cells of a group tell which cells hold the wanted ranks, at
   most two per quantile and group; this table is written out;
3. only values of those cells are looked at again, counted per distinct value, and
   the ranks are read off.

The data is read twice but never shuffled as a whole: step 1 moves cell counts, and
because the table of step 2 is stored, the planner knows its true size and broadcasts
it only if it is below the broadcast threshold. Beyond that it shuffles on (group,
cell), which spreads a hot group over its cells. The result is exact either way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.session import materialize

# Fixed values of the grid.
CELLS_PER_DOUBLING = 4096
SMALLEST_POSITIVE = 5_000_000   # keeps cells of positive numbers above the zero cell
LARGEST = 10_000_000            # cell shared by infinities
NOT_A_NUMBER = 10_000_001       # NaN sorts above everything, as elsewhere in Spark


def grid_cell(value: Column) -> Column:
    """Cell number of a double; larger values never get a smaller cell. NULL stays NULL."""
    steps = F.least(F.floor(F.log2(F.abs(value)) * CELLS_PER_DOUBLING),
                    F.lit(LARGEST - SMALLEST_POSITIVE)) + SMALLEST_POSITIVE
    return (
        F.when(F.isnan(value), F.lit(NOT_A_NUMBER))
        .when(value == 0, F.lit(0))
        .when(value > 0, steps)
        .when(value < 0, -steps)
        .cast("bigint")
    )


def _ranks(quantile: float, interpolation: str, total: Column) -> tuple[Column, Column, Column]:
    """Zero-based lower and upper rank of a quantile and the weight of the upper one."""
    position = (total - 1) * F.lit(float(quantile))
    if interpolation == "nearest":
        rank = F.floor(position + 0.5)
        return rank, rank, F.lit(0.0)
    if interpolation == "linear":
        return F.floor(position), F.ceil(position), position - F.floor(position)
    raise ValueError(f"unknown interpolation {interpolation!r}")


def _target_cells(data: DataFrame, keys: list[str], quantiles: dict[str, float],
                  interpolation: str, rows: str) -> DataFrame:
    """The cells holding a wanted rank: keys, cell, values before it, values and rows in all.

    A group without any value keeps one row, its cell being NULL.
    """
    cells = data.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_count"))
    group = Window.partitionBy(*keys)
    upwards = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = F.when(F.col("_cell").isNotNull(), F.col("_count")).otherwise(0)
    ranked = cells.select(
        *keys, "_cell", "_count",
        (F.sum(values).over(upwards) - F.col("_count")).alias("_start"),
        F.sum(values).over(group).alias("_total"),
        F.sum("_count").over(group).alias(rows),
    )
    holds_a_rank = reduce(lambda a, b: a | b, [
        (rank >= F.col("_start")) & (rank < F.col("_start") + F.col("_count"))
        for probability in quantiles.values()
        for rank in _ranks(probability, interpolation, F.col("_total"))[:2]
    ])
    return (
        ranked.where((F.col("_cell").isNotNull() & holds_a_rank) | (F.col("_total") == 0))
        .drop("_count")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: dict[str, float], *, interpolation: str = "linear",
                    rows: str = "n") -> DataFrame:
    """One row per group: the keys, its row count (NULL values included) and the quantiles.

    ``quantiles`` maps result column names to probabilities. NULL values do not take
    part; a group without any value gets NULL quantiles. The first of the two passes
    runs when this function is called.
    """
    keys = list(keys)
    data = df.select(*keys, F.col(value).cast("double").alias("_value"))
    data = data.withColumn("_cell", grid_cell(F.col("_value")))
    targets = materialize(_target_cells(data, keys, quantiles, interpolation, rows), "cells")

    looked_for = targets.where(F.col("_cell").isNotNull()).select(
        *[F.col(key).alias(f"_t_{key}") for key in keys],
        F.col("_cell").alias("_t_cell"), "_start", "_total", rows,
    )
    same = reduce(lambda a, b: a & b,
                  [F.col(key).eqNullSafe(F.col(f"_t_{key}")) for key in keys],
                  F.col("_cell") == F.col("_t_cell"))
    counted = (
        data.join(looked_for, same)
        .groupBy(*keys, "_cell", "_start", "_total", rows, "_value")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    within = Window.partitionBy(*keys, "_cell").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    placed = counted.withColumn("_end", F.col("_start") + F.sum("_count").over(within))
    first = F.col("_end") - F.col("_count")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("_end")), F.col("_value")))

    picks, results = [], []
    for index, (name, probability) in enumerate(quantiles.items()):
        low, high, weight = _ranks(probability, interpolation, F.col("_total"))
        picks += [at(low).alias(f"_low{index}"), at(high).alias(f"_high{index}")]
        low_value, high_value = F.col(f"_low{index}"), F.col(f"_high{index}")
        results.append(
            F.when(low_value == high_value, low_value)
            .otherwise((1 - weight) * low_value + weight * high_value).alias(name)
        )
    picked = placed.groupBy(*keys, rows, "_total").agg(*picks).select(*keys, rows, *results)
    valueless = targets.where(F.col("_cell").isNull()).select(
        *keys, rows, *[F.lit(None).cast("double").alias(name) for name in quantiles])
    return picked.unionByName(valueless)
