import math
import pickle
from functools import partial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marquee.functions import clipped_log_weight, implied_roi, post_processed
from marquee.modeling import evaluation, training
from marquee.modeling.encoding import fit_target_encoding, oof_target_encode
from marquee.modeling.features import (
    CATEGORICAL, SCENARIO_SCHEMA, FeatureSpec, feature_frame, fit_vocabulary, training_rows, with_split,
)
from marquee.sources.layout import Layout
from marquee.sources.tables import MissingTable

COLUMNS = ("movie_id bigint, budget_musd double, runtime int, release_month int, "
           "genres array<string>, director_name string, lead_production_company string, "
           "lead_cast_name string, revenue_musd double, vote_average double, vote_count bigint")


def films(spark, n):
    """Rows spread evenly by multiples of irrational numbers; returns fall with the budget."""
    rows = []
    for number in range(1, n + 1):
        budget = 3 + 97 * (number * math.sqrt(2) % 1)
        liking = number * math.sqrt(3) % 1
        kinds = [name for bit, name in enumerate(["Mystery", "War", "Western", "Family"]) if number >> bit & 1]
        revenue = 1.5 + 2.2 * budget - 0.012 * budget ** 2 + 9 * liking
        rating = 3.5 + 4 * liking + 0.8 * ("War" in kinds)
        rows.append((number - 1, budget, 75 + number * 37 % 95, 1 + number * 5 % 12, kinds,
                     f"Director {number * 11 % 7}", f"House {number * number % 5}", f"Actor {number % 13}",
                     revenue, rating, 30 + number * number * 17 % 2900))
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def gold(spark):
    return films(spark, 96)


def test_feature_frame(spark, gold):
    spec = fit_vocabulary(gold, k=3)
    assert len(spec.genres) == 3 and {"Mystery", "War"} <= set(spec.genres)
    frame = feature_frame(gold, spec, keep=["movie_id"])
    assert frame.columns == ["movie_id", *spec.columns] and frame.count() == 96
    hot = frame.select(*spec.multi_hot_columns).collect()
    assert {value for row in hot for value in row} == {0, 1}
    assert fit_vocabulary(gold.select("movie_id")).genres == ()


def test_scenario_features(spark):
    frame = spark.createDataFrame([
        (1, 50.0, 100.0, 7, ["Action", "Unheard"], "", None, "X"), (2, None, None, None, None, "D", "S", "L"),
    ], SCENARIO_SCHEMA)
    one, two = feature_frame(frame, FeatureSpec(("Action", "Drama"))).collect()
    assert one.month_sin == pytest.approx(math.sin(math.pi)) and one.month_cos == pytest.approx(-1.0)
    assert (one.genre_Action, one.genre_Drama) == (1, 0)
    assert (one.director_name, one.lead_production_company) == ("Unknown", "Unknown")
    assert (two.budget_musd, two.runtime, two.month_sin, two.month_cos) == (0.0, 0.0, 0.0, 1.0)
    assert (two.genre_Action, two.genre_Drama) == (0, 0)


def test_training_rows(spark, gold):
    holes = gold.withColumn("revenue_musd", F.when(F.col("movie_id") < 5, 0.0)
                            .when(F.col("movie_id") > 9, F.col("revenue_musd")))
    assert training_rows(holes, "revenue_musd").count() == 86
    assert training_rows(holes, "vote_average").count() == 96


def test_split_ignores_partitioning(gold):
    one = with_split(gold.repartition(1)).select("movie_id", "fold", "is_holdout").collect()
    many = with_split(gold.repartition(9)).select("movie_id", "fold", "is_holdout").collect()
    assert sorted(one) == sorted(many)


def shrunk(values, prior_values):
    prior, spread = np.mean(prior_values), np.var(prior_values)
    if len(values) == 0 or spread * len(values) + np.var(values) == 0:
        return prior
    weight = spread * len(values) / (spread * len(values) + np.var(values))
    return weight * np.mean(values) + (1 - weight) * prior


def test_out_of_fold_encoding_matches_numpy(gold):
    named = with_split(gold)
    rows = oof_target_encode(named, ["director_name"], "vote_average").collect()
    assert len(rows) == 96
    for row in rows:
        others = [r for r in rows if r.encoder_fold != row.encoder_fold]
        same = [r.vote_average for r in others if r.director_name == row.director_name]
        expected = shrunk(same, [r.vote_average for r in others])
        assert row.director_name_encoded == pytest.approx(expected, abs=1e-9)


def test_full_encoding_and_unseen_names(gold):
    encoding = fit_target_encoding(gold, ["director_name"], "vote_average")
    rows = gold.collect()
    table = {r.category: r.encoding for r in encoding.table.collect()}
    everything = [r.vote_average for r in rows]
    for name, value in table.items():
        mine = [r.vote_average for r in rows if r.director_name == name]
        assert value == pytest.approx(shrunk(mine, everything), abs=1e-9)
    unseen = gold.limit(1).withColumn("director_name", F.lit("Nobody"))
    assert encoding.apply(unseen).first().director_name_encoded == pytest.approx(np.mean(everything))


def test_constant_target_encodes_to_the_mean(gold):
    flat = gold.withColumn("y", F.lit(3.0))
    encoded = oof_target_encode(with_split(flat), ["director_name"], "y")
    assert {round(r.director_name_encoded, 9) for r in encoded.collect()} == {3.0}


def test_metrics_match_numpy(spark):
    rng = np.random.default_rng(1)
    y, p = rng.uniform(0, 5, 50), rng.uniform(0, 5, 50)
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y_true double, y_pred double")
    row = evaluation.regression_metrics(frame).first()
    assert row.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.mae == pytest.approx(np.abs(y - p).mean()) and row.rmse == pytest.approx(
        np.sqrt(((y - p) ** 2).mean()))
    big = y >= 1
    assert evaluation.money_metrics(frame).first().mape_over_1M == pytest.approx(
        (np.abs(y - p)[big] / y[big]).mean())
    assert math.isnan(evaluation.money_metrics(frame, floor=9.0).first().mape_over_1M)
    low, high = evaluation.axis_bounds(frame).first()
    assert (low, high) == (min(y.min(), p.min()), max(y.max(), p.max()))


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)) * [1.0, 5.0, 0.2]
    y = x @ [2.0, -0.3, 4.0] + rng.normal(size=60)
    frame = spark.createDataFrame(
        [([float(v) for v in row], float(t)) for row, t in zip(x, y)], "features array<double>, y_label double")
    model = training.fit_ridge(frame, training.TrainOptions())
    z = (x - x.mean(0)) / x.std(0)
    scaled = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert model.coefficients.toArray() == pytest.approx(scaled / x.std(0), rel=1e-6)


def test_donors_are_a_permutation(spark):
    frame = spark.range(500).select("id", F.array(F.col("id").cast("double")).alias("features"))
    paired = evaluation.with_donor(frame, key="id", repeats=3, seed=1, groups=4).collect()
    for repeat in range(3):
        rows = [r for r in paired if r.repeat == repeat]
        assert sorted(r.donor[0] for r in rows) == [float(n) for n in range(500)]
        assert sum(r.donor[0] == r.features[0] for r in rows) == 0
    assert len({tuple(r.donor[0] for r in sorted(paired) if r.repeat == k) for k in range(3)}) == 3


def test_importance_finds_the_feature_that_matters(spark):
    frame = spark.range(2000).select(
        "id", F.array(F.rand(1), F.rand(2)).alias("features")).withColumn(
        "y_true", 3 * F.col("features")[0])
    from pyspark.ml.regression import LinearRegression
    fitted = LinearRegression(labelCol="y_true", predictionCol="y_pred").fit(
        frame.withColumn("features", array_to_vector("features")))
    result = evaluation.permutation_importance(frame, fitted.transform, ["signal", "noise"], key="id")
    rows = result.collect()
    assert [r.feature for r in rows] == ["signal", "noise"]
    assert rows[0].importance_mean == pytest.approx(2.0, abs=0.15)
    assert abs(rows[1].importance_mean) < 0.01 and rows[0].importance_std > 0


def test_post_processing(spark):
    frame = spark.createDataFrame([(-5.0,), (1.0,), (50.0,)], "raw double")
    money = [r[0] for r in frame.select(post_processed(F.col("raw"), "revenue_musd", "log1p")).collect()]
    stars = [r[0] for r in frame.select(post_processed(F.col("raw"), "vote_average", "identity")).collect()]
    assert money[0] == 0.0 and money[1] == pytest.approx(math.e - 1) and stars == [0.0, 1.0, 10.0]
    assert frame.select(implied_roi(F.lit(3.0), F.lit(0.0))).first()[0] == 0.0
    assert frame.select(clipped_log_weight(F.lit(-4))).first()[0] == 0.0


def test_training_end_to_end(spark, gold, tmp_path):
    layout = Layout(str(tmp_path))
    gold_table = gold.withColumns({
        name: F.lit(None).cast(kind) for name, kind in (
            ("title", "string"), ("original_title", "string"), ("release_year", "int"),
            ("budget", "bigint"), ("revenue", "bigint"), ("roi", "double"), ("popularity", "double"),
            ("production_companies", "array<string>"), ("director_id", "bigint"), ("lead_cast_id", "bigint"))})
    options = training.TrainOptions(iterations=3, folds=2, repeats=1)
    with pytest.raises(MissingTable):
        training.train_from_layout(spark, layout, options)
    gold_table.write.parquet(layout.gold)
    fitted = training.train_from_layout(spark, layout, options)
    counts = fitted["revenue"].counts
    assert counts["n_train"] + counts["n_test"] == counts["n_rows"] == 96
    splits = {(r.target, r.split) for r in spark.read.parquet(layout.metrics).collect()}
    assert ("revenue", "holdout, original units") in splits and ("rating", "cross-validation") in splits
    assert ("rating", "holdout, original units") not in splits
    wide = evaluation.wide_metrics(fitted["rating"].metrics).collect()
    assert {r.split for r in wide} == {"holdout", "ridge", "cross-validation"}
    assert fitted["revenue"].importance.count() == len(fitted["revenue"].spec.columns)

    assert training.bundle_exists(spark, layout.model("rating"))
    with pytest.raises(MissingTable):
        training.load(spark, layout.uri("nowhere"))
    revenue = training.load(spark, layout.model("revenue"))
    rating = training.load(spark, layout.model("rating"))
    scenarios = spark.createDataFrame([
        (1, 60.0, 110.0, 6, ["War"], "Director 1", "House 1", "Actor 1"),
        (2, 0.0, 90.0, 1, [], "Never Seen", None, ""),
    ], SCENARIO_SCHEMA)
    rows = {r.scenario_id: r for r in training.score_scenarios(revenue, rating, scenarios).collect()}
    fresh = {r.scenario_id: r for r in training.score_scenarios(
        fitted["revenue"], fitted["rating"], scenarios).collect()}
    assert rows == fresh and len(rows) == 2
    assert all(r.predicted_revenue_musd >= 0 and 0 <= r.predicted_rating <= 10 for r in rows.values())
    assert rows[2].implied_roi == 0.0


def test_too_little_data_is_refused(spark, gold):
    with pytest.raises(ValueError, match="usable rows"):
        training.train_target(gold.limit(10), training.RATING)
    with pytest.raises(ValueError, match="empty"):
        training.train(gold.limit(0))


def test_boosting_ends_after_a_patience_of_rounds():
    assert training.rounds_kept([5.0, 5.0, 4.0, 3.0, 2.0], 2, 1e-7) is None
    assert training.rounds_kept([5.0, 5.0, 4.0, 4.0, 4.5, 3.0], 2, 1e-7) == 5
    assert training.rounds_kept([5.0, 4.0], 2, 1e-7) is None


def test_trees_are_cut_where_the_patience_ran_out(spark, tmp_path):
    rows = spark.range(200).select(
        (F.xxhash64("id") % 100).cast("double").alias("y_label"), F.lit(1.0).alias("weight"),
        (F.col("id") % 5 == 0).alias("is_validation"),
        F.array(F.xxhash64("id", F.lit("a")) % 50 * 1.0, F.xxhash64("id", F.lit("b")) % 50 * 1.0)
        .alias("features"))
    options = training.TrainOptions(iterations=12, patience=3, min_leaf=2)
    model = training.fit_trees(rows, options, weighted=True)
    vectors = training.as_vectors(rows)
    errors = model.evaluateEachIteration(vectors.where("is_validation"), "squared")
    assert model.getNumTrees == training.rounds_kept(errors, 3, 1e-7) < 12
    model.write().save(f"{tmp_path}/trees")
    again = training.GBTRegressionModel.load(f"{tmp_path}/trees")
    wanted = [r.y_pred for r in model.transform(vectors).collect()]
    assert len(set(wanted)) > 1 and wanted == [r.y_pred for r in again.transform(vectors).collect()]


def test_registered_models_run_the_whole_job(spark, monkeypatch):
    from marquee.plans import model_queries

    asked = []

    class Fitted:
        metrics, importance = "metrics", "importance"

    monkeypatch.setattr(model_queries, "_gold_for_models", lambda *_: None)
    monkeypatch.setattr(training, "train_target", lambda gold, plan, options=training.TrainOptions():
                        asked.append(options) or Fitted)
    assert model_queries.gbt_holdout(spark, "") == "metrics"
    assert model_queries.permutation_importance(spark, "") == "importance"
    assert asked == [training.TrainOptions()] * 2


def boosted_rows(spark, n=400):
    return spark.range(n).select(
        (F.col("id") % 20 + F.xxhash64("id") % 10).cast("double").alias("y_label"), (1.0 + F.col("id") % 3).alias("weight"),
        (F.col("id") % 5 == 0).alias("is_validation"),
        F.array((F.col("id") % 20).cast("double"), F.xxhash64("id", F.lit("b")) % 50 * 1.0).alias("features"))


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_go_on_where_the_last_one_ended(spark, weighted):
    rows = boosted_rows(spark)
    whole = training.Boosting(rows, training.TrainOptions(), weighted=weighted)
    whole.grow(6)
    parts = training.Boosting(rows, training.TrainOptions(), weighted=weighted)
    for rounds in (1, 2, 3):
        parts.grow(rounds)
    assert len(parts.trees) == 7 and parts.errors == pytest.approx(whole.errors, rel=1e-9)
    assert len(parts.errors) == 7 and parts.errors[-1] < parts.errors[0]
    model = training.ensemble(parts.trees, parts.weights, 2, weighted=weighted)
    scored = model.transform(training.as_vectors(rows)).where("is_validation")
    weight = F.col("weight") if weighted else F.lit(1.0)
    error = scored.select(F.sum(weight * (F.col("y_label") - F.col("y_pred")) ** 2) / F.sum(weight)).first()[0]
    assert parts.errors[-1] == pytest.approx(error, rel=1e-9)
    margins = parts.table.select((F.col("margin")).alias("m"), "features").collect()
    assert len(margins) == 400


def test_without_validation_rows_all_rounds_are_grown(spark):
    rows = boosted_rows(spark, 100).withColumn("is_validation", F.lit(False))
    model = training.fit_trees(rows, training.TrainOptions(iterations=4, block=3), weighted=False)
    assert model.getNumTrees == 5 and model.treeWeights == [1.0, 0.05, 0.05, 0.05, 0.05]


@pytest.mark.parametrize("groups", [1, 3, 50])
def test_donors_follow_one_order_whatever_the_ranges(spark, groups):
    import hashlib
    frame = spark.range(60).select("id", F.array(F.col("id").cast("double")).alias("features"))
    paired = evaluation.with_donor(frame, key="id", repeats=2, seed=1, groups=groups).collect()
    for repeat in range(2):
        circle = sorted(range(60), key=lambda i: (hashlib.md5(f"donor-1:{repeat}:{i}".encode()).hexdigest(), i))
        after = {a: b for a, b in zip(circle, circle[1:] + circle[:1])}
        assert {r.id: int(r.donor[0]) for r in paired if r.repeat == repeat} == after


def test_ridge_ignores_features_that_never_vary(spark):
    frame = spark.createDataFrame([([1.0, 2.0], 3.0), ([1.0, 4.0], 5.0), ([1.0, 9.0], 7.0)], "features array<double>, y_label double")
    model = training.fit_ridge(frame, training.TrainOptions())
    assert model.coefficients[0] == 0.0 and model.coefficients[1] > 0
    predicted = [r.y_pred for r in model.transform(frame).collect()]
    assert predicted == pytest.approx([r.y_pred for r in model.transform(training.as_vectors(frame)).collect()])
    with pytest.raises(ValueError, match="at least one row"):
        training.fit_ridge(frame.limit(0), training.TrainOptions())


def test_a_failing_save_leaves_the_old_bundle(spark, gold, tmp_path):
    from dataclasses import replace
    from pyspark.ml.linalg import DenseVector

    frame = training.as_vectors(boosted_rows(spark, 60))
    boosting = training.Boosting(boosted_rows(spark, 60), training.TrainOptions(), weighted=False)
    model = training.ensemble(boosting.trees, boosting.weights, 2)
    ridge = training.RidgeModel(DenseVector([1.0, 2.0]), 0.5)
    encoding = fit_target_encoding(gold, ["director_name"], "vote_average")
    table = spark.createDataFrame([("rating", "holdout", "r2", 0.5)], "target string, split string, metric string, value double")
    predictions = frame.select(F.col("y_label").alias("y_true"), F.lit(1.0).alias("y_pred"))
    bundle = training.FittedTarget(training.RATING, FeatureSpec(("War",)), encoding, ridge, lambda: model,
                                   lambda _: predictions, lambda _: table, counts={"n_rows": 60})
    uri = f"{tmp_path}/model"
    training.save(bundle, uri)

    def broken(_):
        raise OSError("no table")

    with pytest.raises(OSError):
        training.save(replace(bundle, measure=broken, counts={"n_rows": 1}), uri)
    again = training.load(spark, uri)
    assert again.counts == {"n_rows": 60} and again.ridge == ridge and again.importance is None
    assert again.metrics.collect() == table.collect() and again.spec == bundle.spec
    training.save(replace(bundle, counts={"n_rows": 2}), uri)
    assert training.load(spark, uri).counts == {"n_rows": 2}
    assert sum(p.name.startswith("version-") for p in (tmp_path / "model").iterdir()) == 1


def test_large_labels_keep_their_scatter(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], 1e9 + i % 7) for i in range(70)], "movie_id long, name string, y double")
    small = rows.withColumn("y", F.col("y") - 1e9)
    shifted, plain = (sorted((r.category, r.encoding) for r in fit_target_encoding(df, ["name"], "y").table.collect())
                      for df in (rows, small))
    assert [e - 1e9 for _, e in shifted] == pytest.approx([e for _, e in plain], abs=1e-5)
    encoded = [sorted(oof_target_encode(with_split(df), ["name"], "y").select("movie_id", "name_encoded").collect()) for df in (rows, small)]
    assert [r[1] - 1e9 for r in encoded[0]] == pytest.approx([r[1] for r in encoded[1]], abs=1e-5)


@pytest.mark.parametrize("weighted", [False, True])
def test_trees_equal_those_of_spark_whatever_the_tasks(spark, monkeypatch, weighted):
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = boosted_rows(spark).withColumn("is_validation", F.lit(False))
    whole = training.Boosting(rows, training.TrainOptions(), weighted=weighted)
    whole.grow(3)
    vectors = training.as_vectors(rows)
    mean = vectors.agg(F.sum(F.col("weight") * F.col("y_label")) / F.sum("weight")).first()[0] if weighted else vectors.agg(F.avg("y_label")).first()[0]
    learner = DecisionTreeRegressor(labelCol="rest", predictionCol="y_pred", maxDepth=5, minInstancesPerNode=10, maxBins=256)
    tree = (learner.setWeightCol("weight") if weighted else learner).fit(vectors.withColumn("rest", F.col("y_label") - mean))
    wanted = [r[0] + 0.0 for r in tree.transform(vectors).orderBy("features", "y_label").select(F.round(F.col("y_pred") * 0.05 + mean, 9)).collect()]
    model = training.ensemble(whole.trees[:2], whole.weights[:2], 2, weighted=weighted)
    assert [r[0] for r in model.transform(vectors).orderBy("features", "y_label").select(F.round("y_pred", 9)).collect()] == wanted
    stored = model.trees[1]
    assert stored.numNodes == tree.numNodes and stored.depth == tree.depth == 5
    assert stored._java_obj.rootNode().impurity() == pytest.approx(tree._java_obj.rootNode().impurity())

    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    parts = training.Boosting(rows, training.TrainOptions(), weighted=weighted)
    assert parts.tasks > 1
    parts.grow(3)
    for one, other in zip(whole.trees, parts.trees):
        assert list(one.feature) == list(other.feature) and one.value == pytest.approx(other.value, abs=1e-9)


def test_a_block_of_few_rows_takes_few_jobs(spark):
    boosting = training.Boosting(boosted_rows(spark), training.TrainOptions(), weighted=False)
    spark.sparkContext.setJobGroup("block", "one block")
    boosting.grow(25)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(boosting.trees) == 26 and len(spark.sparkContext.statusTracker().getJobIdsForGroup("block")) < 25


def test_folds_are_fitted_in_one_pass_and_equal_single_fits(spark, monkeypatch):
    rows = spark.range(400).select(
        F.col("id").alias("movie_id"), (F.col("id") % 7 * 1.5).alias("budget_musd"), (F.col("id") % 11 * 1.0).alias("runtime"),
        F.lit(0.25).alias("month_sin"), F.sin("id").alias("month_cos"), (F.col("id") % 2).cast("int").alias("genre_A"),
        *[F.concat(F.lit(name), (F.col("id") % k).cast("string")).alias(name) for k, name in zip((13, 17, 90), CATEGORICAL)],
        (F.col("id") % 7 + F.col("id") % 13 / 3 + F.cos("id")).alias("y_label"), F.lit(1.0).alias("y_raw"),
        F.lit(1.0).alias("weight"), F.lit(False).alias("is_validation"),
        (F.xxhash64("id") % 5).alias("encoder_fold"), F.pmod(F.col("id") * 7 + F.col("id") % 3, F.lit(5)).alias("fold")).localCheckpoint()
    spec, options = FeatureSpec(("A",)), training.TrainOptions()
    apart = training.cross_validated(rows, spec, options, training.fit_ridge).first()
    monkeypatch.setattr(training, "prepare", None)
    stored, write = [], training.materialize
    monkeypatch.setattr(training, "materialize", lambda df, name, **options: stored.append(name) or write(df, name, **options))
    fits = training.fit_ridges(rows, spec, options, part="fold", tests=range(5))
    assert sorted(fits.models) == [0, 1, 2, 3, 4] and fits.models[0].coefficients[2] == 0.0 and not stored
    assert list(training.ridge_cross_validated(rows, spec, options).first()) == pytest.approx(list(apart), rel=1e-9)
    assert fits.scored().count() == 400
    with pytest.raises(ValueError, match="at least one row"):
        training.fit_ridges(rows.limit(0), spec, options, part="fold", tests=[1])


@pytest.mark.parametrize("per_range", [1, 7, 1000])
def test_linear_importance_equals_scoring_every_variant(spark, monkeypatch, per_range):
    from pyspark.ml.linalg import DenseVector
    monkeypatch.setattr(evaluation, "ROWS_PER_RANGE", per_range)
    rows = spark.range(60).select(
        F.col("id").alias("movie_id"), (F.col("id") * 1.0).alias("y_true"),
        F.array((F.col("id") % 7).cast("double"), F.col("id") / 9, F.lit(4.0)).alias("features"))
    model = training.RidgeModel(DenseVector([-0.5, 8.0, 3.0]), 1.25)
    names = ["a", "b", "constant"]
    ours = evaluation.linear_importance(rows, [-0.5, 8.0, 3.0], 1.25, names).collect()
    scored = evaluation.permutation_importance(rows, model.transform, names).collect()
    assert [row.feature for row in ours] == [row.feature for row in scored]
    for one, other in zip(ours, scored):
        assert one.importance_mean == pytest.approx(other.importance_mean, abs=1e-9)
        assert one.importance_std == pytest.approx(other.importance_std, abs=1e-9)
    assert evaluation.linear_importance(rows.limit(0), [1.0, 1.0, 1.0], 0.0, names).count() == 0


def test_ridges_store_what_they_need_only(spark):
    """No weight, votes or early-stopping flag: the Gold of a ridge doesn't even have them."""
    gold = spark.createDataFrame(
        [(1, 2.0, 90, 3, ["War"], "d", "c", "l", 5.0)],
        "movie_id bigint, budget_musd double, runtime int, release_month int, genres array<string>, "
        "director_name string, lead_production_company string, lead_cast_name string, vote_average double")
    rows = training.labelled_rows(gold, training.RATING, training.TrainOptions(), FeatureSpec(("War",)),
                                  carried=("y_label", "is_holdout", "encoder_fold"))
    assert rows.columns[:4] == ["movie_id", "y_label", "is_holdout", "encoder_fold"]
    assert not {"weight", "y_raw", "fold", "is_validation"} & set(rows.columns) and rows.first().y_label == 5.0


def test_labels_of_several_targets_share_one_table(spark, gold):
    """Both targets' rows, labels and splits equal those stored apart."""
    spec, options, carried = FeatureSpec(("War",)), training.TrainOptions(), ("is_holdout", "encoder_fold")
    odd = gold.withColumns({
        "revenue_musd": F.when(F.col("movie_id") % 5 > 1, F.col("revenue_musd")).when(F.col("movie_id") % 5 == 1, 0.0),
        "vote_average": F.when(F.col("movie_id") % 3 > 0, F.col("vote_average"))})
    plans = (training.REVENUE, training.RATING)
    together = training.labelled_together(odd, plans, options, spec, carried)
    assert together[0].inputFiles() == together[1].inputFiles()
    for plan, rows in zip(plans, together):
        apart = training.labelled_rows(odd, plan, options, spec, ("y_label", *carried))
        assert rows.columns == apart.columns and 0 < rows.count() < odd.count()
        assert rows.orderBy("movie_id").collect() == apart.orderBy("movie_id").collect()


@pytest.mark.parametrize("weighted", [False, True])
def test_shared_codes_keep_every_tree(spark, monkeypatch, weighted):
    """Features that share a code, joined packs and several tasks: the trees of a code per feature."""
    from marquee.modeling import boosting

    rows = spark.range(600).select(
        (F.col("id") % 7 * 2 + F.col("id") % 3 + F.xxhash64("id") % 5).cast("double").alias("y_label"),
        (1.0 + F.col("id") % 4).alias("weight"), (F.col("id") % 9 == 0).alias("is_validation"),
        F.array(*[(F.xxhash64("id", F.lit(k)) % 40 + F.col("id") % m).cast("double") for k, m in enumerate((2, 3, 7))],
                (F.col("id") % 3).cast("double"), (F.col("id") % 2).cast("double")).alias("features"))
    options = training.TrainOptions()
    shared = training.Boosting(rows, options, weighted=weighted)
    assert len(shared.coding.groups) < 5
    shared.grow(4)
    monkeypatch.setattr(training, "Coding", partial(boosting.Coding, joint=1))
    apart = training.Boosting(rows, options, weighted=weighted)
    assert len(apart.coding.groups) == 5
    stored = spark.read.parquet(apart.path).collect()
    apart.grow(4)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 160)
    assert len(list(boosting.blocks(stored, apart.coding))) > 1
    alone = boosting.boost_alone(stored, apart.coding, rounds=4, depth=5, min_leaf=10, step=0.05, weighted=weighted)
    found = pickle.loads(next(alone)[0])[0]
    for tree, one in zip(found, apart.trees[1:], strict=True):
        assert list(tree.feature) == list(one.feature) and tree.value == pytest.approx(one.value, abs=1e-9)
    monkeypatch.setattr(training, "ROWS_PER_TASK", 100)
    several = training.Boosting(rows, options, weighted=weighted)
    assert several.tasks > 1
    several.grow(4)
    for other in (apart, several):
        assert other.errors == pytest.approx(shared.errors, rel=1e-9)
        for one, tree in zip(shared.trees, other.trees):
            assert list(one.feature) == list(tree.feature) and list(one.rows) == list(tree.rows)
            assert one.value == pytest.approx(tree.value, abs=1e-9) and one.squares == pytest.approx(tree.squares, rel=1e-9)


def test_blocks_of_rounds_store_the_packed_rows_once(spark, tmp_path):
    """A block replaces the rows that the block before it stored, and nothing is left behind a fit."""
    from marquee import session

    def stored():
        return [path for path in session._SCRATCH[spark.sparkContext.applicationId] if "/packs-" in path]

    before = len(stored())
    boosting = training.Boosting(boosted_rows(spark), training.TrainOptions(), weighted=False)
    boosting.grow(2)
    boosting.grow(2)
    assert len(stored()) == before + 1
    boosting.close()
    training.fit_trees(boosted_rows(spark), training.TrainOptions(iterations=4, block=2), weighted=False)
    assert len(stored()) == before


def test_importance_of_trees_equals_scoring_every_variant(spark):
    rows = spark.range(500).select(
        F.col("id").alias("movie_id"), F.lit(1.0).alias("weight"), F.lit(False).alias("is_validation"),
        (F.col("id") % 13 + F.col("id") % 4 * 3 + F.cos("id")).alias("y_label"),
        F.array((F.col("id") % 13).cast("double"), (F.col("id") % 4).cast("double"), F.cos("id"), F.lit(4.0)).alias("features"))
    model = training.fit_trees(rows, training.TrainOptions(iterations=12, step=0.3), weighted=False)
    held = rows.select("movie_id", F.col("y_label").alias("y_true"), "features")
    names = ["a", "b", "c", "constant"]
    one = evaluation.permutation_importance(held, model.transform, names, trees=model.grown).collect()
    other = evaluation.permutation_importance(held, model.transform, names).collect()
    assert [row.feature for row in one] == [row.feature for row in other] and one[0].importance_mean > 0.1
    for ours, scored in zip(one, other):
        assert ours.importance_mean == pytest.approx(scored.importance_mean, abs=1e-9)
        assert ours.importance_std == pytest.approx(scored.importance_std, abs=1e-9)


def test_scenarios_of_one_file_are_scored_by_all_cores(spark, gold):
    ids = []

    class Model:
        def transform(self, rows):
            ids.append(rows.rdd.getNumPartitions())
            return rows.withColumn("y_pred", F.lit(1.0))

    encoding = fit_target_encoding(gold, list(CATEGORICAL), "vote_average")
    bundle = training.FittedTarget(training.RATING, FeatureSpec(("War",)), encoding, None, Model, None, None)
    scenarios = spark.createDataFrame([(1, 60.0, 110.0, 6, ["War"], "Director 1", "House 1", "Actor 1")], SCENARIO_SCHEMA).coalesce(1)
    assert training.score(bundle, scenarios).count() == 1
    assert ids[0] >= spark.sparkContext.defaultParallelism
