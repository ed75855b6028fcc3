import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marquee.operators.quantiles import exact_quantiles, grid_cell

QUARTILES = {"a": 0.25, "b": 0.5, "c": 0.75}


def brute(values, probability, interpolation):
    ordered = sorted(values)
    position = (len(ordered) - 1) * probability
    if interpolation == "nearest":
        return ordered[math.floor(position + 0.5)]
    low, high = ordered[math.floor(position)], ordered[math.ceil(position)]
    return low if low == high else low + (position - math.floor(position)) * (high - low)


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_matches_brute_force_with_a_hot_group(spark, interpolation):
    rng = random.Random(3)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), 1.25, 0.0])) for _ in range(4000)]
    rows += [(f"g{rng.randrange(40)}", rng.lognormvariate(0, 4)) for _ in range(1500)]
    rows += [("hot", None), ("g1", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    result = exact_quantiles(frame, ["k"], "v", QUARTILES, interpolation=interpolation).collect()
    groups = {}
    for key, value in rows:
        groups.setdefault(key, []).append(value)
    assert len(result) == len(groups)
    for row in result:
        values = [v for v in groups[row.k] if v is not None]
        assert row.n == len(groups[row.k])
        for name, probability in QUARTILES.items():
            assert row[name] == pytest.approx(brute(values, probability, interpolation), abs=1e-12)


def test_groups_without_values_and_null_keys(spark):
    frame = spark.createDataFrame(
        [("x", None), ("x", None), (None, 1.0), (None, 3.0)], "k string, v double")
    rows = {row.k: row for row in exact_quantiles(frame, ["k"], "v", {"m": 0.5}).collect()}
    assert rows["x"].m is None and rows["x"].n == 2
    assert rows[None].m == 2.0


def test_special_values(spark):
    frame = spark.createDataFrame(
        [(float("inf"),), (-float("inf"),), (-0.0,), (0.0,), (5e-324,)], "v double")
    row = exact_quantiles(frame.withColumn("k", F.lit(1)), ["k"], "v",
                          {"low": 0.0, "mid": 0.5, "high": 1.0}).first()
    assert (row.low, row.mid, row.high) == (-float("inf"), 0.0, float("inf"))


def test_unknown_interpolation(spark):
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([(1, 1.0)], "k int, v double"), ["k"], "v",
                        {"m": 0.5}, interpolation="midpoint")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, width=64), min_size=2, max_size=60))
def test_cells_never_fall_as_values_rise(spark, values):
    ordered = np.sort(np.array(values))
    frame = spark.createDataFrame([(float(v),) for v in ordered], "v double")
    cells = [row[0] for row in frame.select(grid_cell(F.col("v"))).collect()]
    assert cells == sorted(cells)


def test_agrees_with_the_built_in_median(spark):
    frame = spark.range(10_000).select(
        (F.col("id") % 7).alias("k"), F.abs(F.xxhash64("id") % 1000).cast("double").alias("v"))
    ours = {r.k: r.m for r in exact_quantiles(frame, ["k"], "v", {"m": 0.5}).collect()}
    theirs = {r.k: r.m for r in frame.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert ours == theirs
