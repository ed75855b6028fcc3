"""Fit, evaluate, keep and apply the revenue and rating models."""

from __future__ import annotations

import json
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressionModel, GBTRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType

from marquee import config
from marquee.functions import clipped_log_weight, implied_roi, post_processed
from marquee.modeling import evaluation
from marquee.modeling.boosting import (
    PACK_ROWS, STORED, Block, Coding, Tree, blocks, boost, boost_alone, constant, learn_cuts, packs,
)
from marquee.modeling.encoding import (
    FitEncodings, TargetEncoding, category_sums, encoded_name, fit_encodings, fit_target_encoding,
    oof_target_encode,
)
from marquee.modeling.features import (
    CATEGORICAL, FeatureSpec, feature_frame, fit_vocabulary, training_rows, with_split,
)
from marquee.session import delete_scratch, materialize, scratch_path, shared_folder
from marquee.sources.layout import (
    Layout, child_names, delete_path, path_exists, read_small_file, replace_small_file,
)
from marquee.sources.sinks import overwrite_table
from marquee.sources.tables import MissingTable, read_gold

#: Twice as many rows are boosted by several tasks; fewer are held by one, in some 20 bytes each.
ROWS_PER_TASK = 4_000_000
#: Steps that the driver runs side by side at most.
MOST_THREADS = 8
#: The file that names a saved bundle's current version.
POINTER = "current"


@dataclass(frozen=True)
class TargetPlan:
    """What is predicted and how."""

    name: str
    column: str
    label: str
    transform: str = "identity"
    weight: str | None = None


REVENUE = TargetPlan("revenue", "revenue_musd", "Revenue (million USD)", "log1p")
RATING = TargetPlan("rating", "vote_average", "User rating (0-10)", weight="vote_count")


@dataclass(frozen=True)
class TrainOptions:
    iterations: int = 500
    block: int = 25                 # rounds between two writings of the margins
    step: float = 0.05
    patience: int = 25
    tolerance: float = 1e-7
    min_leaf: int = 10
    max_depth: int = 5
    max_bins: int = 256
    ridge_alpha: float = 1.0
    folds: int = config.FOLDS
    repeats: int = 5
    seed: int = config.SEED
    min_rows: int = config.MIN_TRAINING_ROWS
    key: str = "movie_id"
    cross_validate: bool = True
    importance: bool = True


@dataclass
class FittedTarget:
    """One target's models. What takes long is worked out when first asked for, and once."""

    plan: TargetPlan
    spec: FeatureSpec
    encoding: TargetEncoding
    ridge: RidgeModel
    fit: Callable[[], GBTRegressionModel]
    predict: Callable[[FittedTarget], DataFrame]
    measure: Callable[[FittedTarget], DataFrame]
    rank: Callable[[FittedTarget], DataFrame] | None = None
    counts: dict[str, int] = field(default_factory=dict)

    @cached_property
    def model(self) -> GBTRegressionModel:
        return self.fit()

    @cached_property
    def predictions(self) -> DataFrame:
        """y_true and y_pred of the holdout, in original units."""
        return self.predict(self)

    @cached_property
    def metrics(self) -> DataFrame:
        """target, split, metric, value."""
        return self.measure(self)

    @cached_property
    def importance(self) -> DataFrame | None:
        """feature, importance_mean, importance_std, the largest first."""
        return self.rank(self) if self.rank else None


# --- assembling ------------------------------------------------------------------

def model_columns(spec: FeatureSpec) -> list[str]:
    """Numeric model inputs, in the order of the feature columns."""
    return [encoded_name(name) if name in CATEGORICAL else name for name in spec.columns]


def _features(df: DataFrame, spec: FeatureSpec, keep: Sequence[str | Column]) -> DataFrame:
    values = [F.col(f"`{name}`").cast("double") for name in model_columns(spec)]
    return df.select(*keep, F.array(*values).alias("features"))


def as_vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("features"))


@dataclass
class Prepared:
    """Encoded rows for one fit; ``train`` was encoded out of fold."""

    train: DataFrame
    test: DataFrame
    encoding: TargetEncoding


def prepare(rows: DataFrame, spec: FeatureSpec, is_test, *, key: str) -> Prepared:
    """Encode both sides and store them: every fit and score below reads these tables."""
    carried = [key, "y_label", "y_raw", "weight", "is_validation"]
    train_rows = rows.where(~is_test)
    sums = category_sums(train_rows, CATEGORICAL, "y_label", F.col("encoder_fold"))
    encoding = fit_target_encoding(train_rows, CATEGORICAL, "y_label", sums=sums)
    train = oof_target_encode(train_rows, CATEGORICAL, "y_label", sums=sums)
    test = encoding.apply(rows.where(is_test))
    return Prepared(
        materialize(_features(train, spec, carried), "train"),
        materialize(_features(test, spec, carried), "test"),
        encoding,
    )


def labelled_rows(gold: DataFrame, plan: TargetPlan, options: TrainOptions, spec: FeatureSpec,
                  carried: Sequence[str] = ("y_raw", "y_label", "weight", "is_holdout", "is_validation", "fold",
                                            "encoder_fold")) -> DataFrame:
    """Feature rows with label, weight and split columns, stored: every fit reads them several times.

    Only the columns ``carried`` are worked out and stored beside key and features.
    """
    raw = F.col(plan.column).cast("double")
    named = training_rows(gold, plan.column).withColumns({
        "y_raw": raw, "y_label": F.log1p(raw) if plan.transform == "log1p" else raw})
    if "weight" in carried:
        named = named.withColumn(
            "weight", F.lit(1.0) if plan.weight is None else clipped_log_weight(F.col(plan.weight)))
    split = with_split(named, options.key, seed=options.seed, folds=options.folds)
    return materialize(feature_frame(split, spec, keep=[options.key, *carried]), "labelled")


def labelled_together(gold: DataFrame, plans: Sequence[TargetPlan], options: TrainOptions, spec: FeatureSpec,
                      carried: Sequence[str]) -> list[DataFrame]:
    """The rows of :func:`labelled_rows` for each plan, from one stored table with all their labels.

    A label is NULL there where the plan leaves the row out.
    """
    labels = {}
    for plan in plans:
        raw = F.col(plan.column).cast("double")
        usable = F.col(plan.column) > 0 if plan.column == "revenue_musd" else F.col(plan.column).isNotNull()
        labels[f"y_{plan.name}"] = F.when(usable, F.log1p(raw) if plan.transform == "log1p" else raw)
    named = gold.dropna(subset=["budget_musd", "release_month", "genres"]).withColumns(labels)
    split = with_split(named, options.key, seed=options.seed, folds=options.folds)
    stored = materialize(feature_frame(split, spec, keep=[options.key, *labels, *carried]), "labelled")
    return [stored.where(F.col(own).isNotNull()).withColumnRenamed(own, "y_label").drop(*set(labels) - {own})
            for own in labels]


# --- fitting -----------------------------------------------------------------------

def rounds_kept(errors: Sequence[float], patience: int, tolerance: float) -> int | None:
    """Rounds until the last ``patience`` of them all failed to gain on the one before them."""
    for kept in range(patience + 1, len(errors) + 1):
        bound = errors[kept - patience - 1] - tolerance
        if not any(error < bound for error in errors[kept - patience:kept]):
            return kept
    return None


_NODES = ("treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
          "rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: struct<featureIndex: int, "
          "leftCategoriesOrThreshold: array<double>, numCategories: int>>")


def ensemble(trees: Sequence[Tree], weights: Sequence[float], features: int, *, weighted: bool = False) -> GBTRegressionModel:
    """Single trees as one boosted model of Spark, which sums their weighted predictions.

    Spark makes the model from stored nodes: a model of as many leaves is saved with Spark ML,
    its table of nodes is replaced, and the whole is loaded.
    """
    spark = SparkSession.active()
    jvm, gateway = spark._jvm.org.apache.spark.ml.regression, spark.sparkContext._gateway
    leaf = DecisionTreeRegressor(featuresCol="features", labelCol="y_label", maxDepth=0).fit(
        spark.createDataFrame([(DenseVector([0.0] * features), 0.0)], ["features", "y_label"]))
    every = gateway.new_array(jvm.DecisionTreeRegressionModel, len(trees))
    factors = gateway.new_array(spark._jvm.double, len(trees))
    for number, weight in enumerate(weights):
        every[number], factors[number] = leaf._java_obj, float(weight)
    named = GBTRegressor(featuresCol="features", labelCol="y_label", predictionCol="y_pred")
    if weighted:
        named = named.setWeightCol("weight")
    java = jvm.GBTRegressionModel(f"boosted-{uuid.uuid4().hex}", every, factors, features)
    model = named._copyValues(GBTRegressionModel(java))
    model._transfer_params_to_java()
    path = scratch_path(spark, "trees")
    model.write().save(path)
    nodes = [(number, node) for number, tree in enumerate(trees) for node in tree.node_rows()]
    spark.createDataFrame(nodes, _NODES, verifySchema=False).coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    model = GBTRegressionModel.load(path)
    model.grown = list(zip(trees, weights))
    return model


class Boosting:
    """Boosted trees grown in blocks of rounds, each block going on where the last one ended.

    The binned rows are stored with what is left to predict of each and are written anew after each
    block, so no tree is ever fitted twice and a lost executor costs one block at most.
    """

    def __init__(self, train: DataFrame, options: TrainOptions, *, weighted: bool) -> None:
        self.options, self.weighted, self.spark = options, weighted, train.sparkSession
        shared_folder(self.spark)
        weight = (F.col("weight") if weighted else F.lit(1.0)).cast("double")
        self.rows = train.select("features", F.col("y_label").cast("double").alias("y_label"),
                                 weight.alias("weight"), "is_validation")
        learned, y = ~F.col("is_validation"), F.col("y_label")
        facts = self.rows.agg(
            F.count(F.lit(1)), F.count_if(learned), F.sum(F.when(learned, weight)), F.sum(F.when(learned, weight * y)),
            F.sum(F.when(learned, weight * y * y)), F.max(F.size("features"))).first()
        rows, n, total, self.features = facts[0], facts[1], facts[2], facts[5]
        mean = facts[3] / total
        self.trees, self.weights = [constant(mean, n, total, facts[4])], [1.0]
        self.coding = Coding(learn_cuts(self.rows.where(learned), n, min(options.max_bins, n)))
        # Rows that one task can't hold are dealt to all cores, in parts that are worth a task.
        shared = min(20 * rows // ROWS_PER_TASK, 2 * self.spark.sparkContext.defaultParallelism)
        self.tasks = 1 if rows < 2 * ROWS_PER_TASK else max(2, shared)
        size = max(1, min(PACK_ROWS, rows // (4 * self.tasks)))
        self.path = self._store(packs(self.rows, self.coding, mean, weighted, size))
        #: Validation errors, before the first round and after each.
        self.errors: list[float] = []

    def _store(self, packed: DataFrame) -> str:
        path = scratch_path(self.spark, "packs")
        packed.write.parquet(path)
        return path

    def grow(self, rounds: int) -> None:
        """One block: ``rounds`` more trees, their validation errors, and what is left anew."""
        options = self.options
        how = dict(rounds=rounds, coding=self.coding, depth=options.max_depth, min_leaf=options.min_leaf,
                   step=options.step, weighted=self.weighted)
        stored = self.spark.read.schema(STORED).parquet(self.path).where("codes is not null")
        former = self.path
        if self.tasks == 1:
            grown = stored.coalesce(1).rdd.mapPartitions(partial(boost_alone, **how))
            self.path = self._store(self.spark.createDataFrame(grown, STORED, verifySchema=False))
            found = self.spark.read.schema(STORED).parquet(self.path).where("grown is not null").select("grown").first()
            trees, errors = pickle.loads(found["grown"])
        else:
            data = stored.repartition(self.tasks).rdd.mapPartitions(partial(blocks, coding=self.coding))
            trees, errors, data = boost(data.persist(StorageLevel.MEMORY_AND_DISK), **how)
            self.path = self._store(self.spark.createDataFrame(data.map(Block.stored), STORED, verifySchema=False))
            data.unpersist()
        delete_scratch(self.spark, former)
        # The error after the block before is known already.
        self.errors += [float(total / weight) for total, weight in errors[bool(self.errors):] if weight]
        self.trees += trees
        self.weights += [options.step] * rounds

    def close(self) -> None:
        delete_scratch(self.spark, self.path)

    @property
    def table(self) -> DataFrame:
        """The rows with what the trees so far predict for each, its ``margin``."""
        model = ensemble(self.trees, self.weights, self.features, weighted=self.weighted)
        return model.transform(as_vectors(self.rows)).withColumnRenamed("y_pred", "margin")


def fit_trees(train: DataFrame, options: TrainOptions, *, weighted: bool) -> GBTRegressionModel:
    """Boosted trees that stop early on the validation share of the training rows.

    Boosting starts from the mean and ends once ``patience`` rounds in a row gain nothing on the
    validation rows; it keeps the rounds up to there. Without validation rows it takes all
    ``iterations``. The first tree of the model is the mean, at full weight.
    """
    boosting = Boosting(train, options, weighted=weighted)
    kept = None
    while kept is None and len(boosting.trees) <= options.iterations:
        boosting.grow(min(options.block, options.iterations + 1 - len(boosting.trees)))
        kept = rounds_kept(boosting.errors, options.patience, options.tolerance)
    boosting.close()
    return ensemble(boosting.trees[:kept], boosting.weights[:kept], boosting.features, weighted=weighted)


@dataclass(frozen=True)
class RidgeModel:
    coefficients: DenseVector
    intercept: float

    def transform(self, rows: DataFrame) -> DataFrame:
        """``y_pred`` from ``features`` (a vector or an array of double)."""
        values = F.col("features")
        if not isinstance(rows.schema["features"].dataType, ArrayType):
            values = vector_to_array(values)
        total = F.lit(0.0)
        for place, factor in enumerate(self.coefficients.toArray().tolist()):
            total += F.get(values, F.lit(place)) * F.lit(factor)
        return rows.withColumn("y_pred", F.lit(self.intercept) + total)


def _products(rows: DataFrame, fits: Sequence[int], plain: int, encoded: int,
              centre: Sequence[float]) -> dict[int, np.ndarray]:
    """Per fit the sums of all products of (1, features, y), of distances from ``centre``.

    ``rows`` have ``part`` and ``values``: y, the plain features and the encoded ones of each fit
    in turn. A fit takes the rows of all parts but its own. Tasks return one matrix for each fit.
    """
    size = 2 + plain + encoded
    offsets = np.array([0.0, *centre])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(fits), size, size))
        for batch in batches:
            values = batch["values"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            parts = batch["part"].to_numpy(zero_copy_only=False)
            for number, fit in enumerate(fits):
                own = values[parts != fit]
                first = 1 + plain + number * encoded
                row = np.column_stack([np.ones(len(own)), own[:, 1:1 + plain], own[:, first:first + encoded], own[:, 0]])
                row -= offsets
                totals[number] += row.T @ row
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.arange(len(fits)), size * size), pa.int32()),
            pa.array(np.tile(np.arange(size * size), len(fits)), pa.int32()), pa.array(totals.ravel())],
            ["number", "place", "total"])

    sums = rows.select("part", "values").mapInArrow(add, "number int, place int, total double").groupBy(
        "number", "place").agg(F.sum("total").alias("total")).collect()
    totals = np.zeros((len(fits), size * size))
    for row in sums:
        totals[row["number"], row["place"]] = row["total"]
    return {fit: total.reshape(size, size) for fit, total in zip(fits, totals)}


def _ridge_of(products: np.ndarray, centre: Sequence[float], alpha: float) -> RidgeModel:
    """The closed form on scaled features. Features that never vary get no weight."""
    n = products[0, 0]
    if not n:
        raise ValueError("ridge needs at least one row")
    shift = products[0, 1:] / n
    means = np.array(centre) + shift
    scatter = products[1:, 1:] - n * np.outer(shift, shift)
    spread = np.sqrt(np.maximum(np.diag(scatter)[:-1] / n, 0.0))
    # What rounding leaves of a constant is no variation.
    varies = spread > 1e-10 * np.abs(means[:-1])
    scales = np.where(varies, spread, 1.0)
    gram = scatter[:-1, :-1] / np.outer(scales, scales) * np.outer(varies, varies)
    solved = np.linalg.solve(gram + alpha * np.eye(len(scales)), scatter[:-1, -1] / scales * varies)
    factors = solved / scales
    return RidgeModel(DenseVector(factors), float(means[-1] - factors @ means[:-1]))


def fit_ridge(train: DataFrame, options: TrainOptions) -> RidgeModel:
    """Ridge on scaled features in closed form, never weighted.

    Means first, then the products of all pairs of centred features, summed by numpy in the
    tasks; only those sums reach the driver.
    """
    first = train.select("features").first()
    if first is None:
        raise ValueError("ridge needs at least one row")
    y = F.col("y_label").cast("double")
    x = [F.col("features")[place] for place in range(len(first["features"]))]
    centre = list(train.agg(*map(F.avg, [*x, y])).first())
    rows = train.select(F.lit(0).alias("part"), F.concat(F.array(y), F.col("features")).alias("values"))
    return _ridge_of(_products(rows, [-1], len(x), 0, centre)[-1], centre, options.ridge_alpha)


@dataclass(frozen=True)
class RidgeFits:
    """Ridges that each leave one part of the rows out, and the encodings that go with them."""

    rows: DataFrame
    spec: FeatureSpec
    part: str
    encodings: FitEncodings
    models: dict[int, RidgeModel]

    def held(self, *keep: str | Column) -> DataFrame:
        """The rows left out, with ``features`` as the fit that left them out encodes them."""
        own = self.rows.where(F.col(self.part).isin(list(self.models)))
        return _features(self.encodings.apply_held(own, self.part), self.spec, keep)

    def scored(self) -> DataFrame:
        """y_true and y_pred of the rows left out, with their part."""
        lists = F.create_map(*[entry for fit, model in self.models.items() for entry in (
            F.lit(fit), F.array(*map(F.lit, [model.intercept, *model.coefficients.toArray().tolist()])))])
        held = self.held(self.part, F.col("y_label").alias("y_true")).withColumn(
            "_factors", F.try_element_at(lists, F.col(self.part).cast("int")))
        total = F.lit(0.0)
        for place in range(len(self.spec.columns)):
            total += F.get("features", F.lit(place)) * F.get("_factors", F.lit(place + 1))
        return held.select(self.part, "y_true", (F.get("_factors", F.lit(0)) + total).alias("y_pred"))


def fit_ridges(rows: DataFrame, spec: FeatureSpec, options: TrainOptions, *, part: str,
               tests: Sequence[int]) -> RidgeFits:
    """A ridge for each value of ``part`` in ``tests``, fitted to the rows of all other parts.

    Encoders are fitted anew for each. The rows are read once for the sums of all encoders and
    once for the products of all fits, however many there are; nothing of their size is stored.
    """
    tests = list(tests)
    encodings = fit_encodings(rows, CATEGORICAL, "y_label", fold="encoder_fold", part=part, tests=tests)
    y = F.col("y_label").cast("double")
    plain = [F.col(f"`{name}`").cast("double") for name in spec.columns if name not in CATEGORICAL]
    *means, mean = rows.agg(*map(F.avg, [*plain, y])).first()
    if mean is None:
        raise ValueError("ridge needs at least one row")
    centre = [*means, *[mean] * len(CATEGORICAL), mean]
    absent = F.lit(float("nan"))
    each = [F.coalesce(F.get(encoded_name(name), F.lit(number)), absent)
            for number in range(len(tests)) for name in CATEGORICAL]
    ready = encodings.apply_learned(rows, "encoder_fold").select(
        F.col(part).cast("int").alias("part"), F.array(y, *plain, *each).alias("values"))
    products = _products(ready, tests, len(plain), len(CATEGORICAL), centre)
    return RidgeFits(rows, spec, part, encodings, {
        fit: _ridge_of(total, centre, options.ridge_alpha) for fit, total in products.items()})


def ridge_cross_validated(rows: DataFrame, spec: FeatureSpec, options: TrainOptions) -> DataFrame:
    """Mean fold metrics of the ridge; encoder and model are fitted anew per fold."""
    scored = fit_ridges(rows, spec, options, part="fold", tests=range(options.folds)).scored()
    return evaluation.regression_metrics(scored, by=("fold",)).agg(*[
        F.avg(name).alias(name) for name in evaluation.METRICS])


def _scored(model, rows: DataFrame) -> DataFrame:
    ready = rows if isinstance(model, RidgeModel) else as_vectors(rows)
    return model.transform(ready).withColumn("y_true", F.col("y_label"))


def in_parallel(spark: SparkSession, work: Sequence[Callable[[], object]]) -> list:
    """The results of independent driver-side steps, run side by side.

    Every thread takes over the caller's job group, pool and other local properties.
    """
    with ThreadPool(min(len(work), MOST_THREADS)) as pool:
        return pool.map(lambda step: step(), [inheritable_thread_target(spark)(step) for step in work])


def cross_validated(rows: DataFrame, spec: FeatureSpec, options: TrainOptions,
                    fit: Callable[[DataFrame, TrainOptions], object] | None = None, *,
                    beside: Sequence[Callable[[], object]] = ()) -> DataFrame:
    """Mean fold metrics; encoder and model are refitted per fold, unweighted, all folds at once.

    ``fit`` is given the training rows of a fold and returns what predicts; the trees by default.
    Every fold reads ``rows``, which should therefore be stored, as :func:`labelled_rows` are.
    Further steps ``beside`` them are taken at the same time.
    """
    fit = fit or (lambda train, options: fit_trees(train, options, weighted=False))

    def fold(number: int) -> DataFrame:
        part = prepare(rows, spec, F.col("fold") == number, key=options.key)
        scored = _scored(fit(part.train, options), part.test)
        return materialize(evaluation.regression_metrics(scored), "fold-metrics")

    steps = [partial(fold, number) for number in range(options.folds)]
    folds = in_parallel(rows.sparkSession, [*beside, *steps])[len(beside):]
    return evaluation.stacked(folds).agg(*[
        F.avg(name).alias(name) for name in evaluation.METRICS])


def train_target(gold: DataFrame, plan: TargetPlan,
                 options: TrainOptions = TrainOptions()) -> FittedTarget:
    """Fit one target; what it reaches on the holdout and in folds is measured when asked for.

    The genre vocabulary is learned from training rows only.
    """
    needed = list(dict.fromkeys([
        options.key, "budget_musd", "runtime", "release_month", "genres", *CATEGORICAL,
        plan.column, *([plan.weight] if plan.weight else [])]))
    source = materialize(gold.select(*needed), "gold")
    usable = training_rows(source, plan.column)
    n_rows = usable.count()
    if n_rows < options.min_rows:
        raise ValueError(f"{plan.column}: {n_rows} usable rows, at least "
                         f"{options.min_rows} are needed")
    flagged = with_split(usable, options.key, seed=options.seed, folds=options.folds)
    spec = fit_vocabulary(flagged.where(~F.col("is_holdout")))

    rows = labelled_rows(source, plan, options, spec)
    data = prepare(rows, spec, F.col("is_holdout"), key=options.key)
    ridge = fit_ridge(data.train, options)

    def scored_holdout(bundle: FittedTarget) -> DataFrame:
        return _scored(bundle.model, data.test).select("y_raw", "y_true", "y_pred")

    def predict(bundle: FittedTarget) -> DataFrame:
        in_units = F.expm1("y_pred") if plan.transform == "log1p" else F.col("y_pred")
        return materialize(scored_holdout(bundle).select(F.col("y_raw").alias("y_true"), in_units.alias("y_pred")),
                           "predictions")

    def measure(bundle: FittedTarget) -> DataFrame:
        tables = []
        if options.cross_validate:
            folds = cross_validated(rows, spec, options, beside=[lambda: bundle.model])
            tables.append(evaluation.long_metrics(folds, plan.name, "cross-validation"))
        tables += [
            evaluation.long_metrics(evaluation.regression_metrics(scored_holdout(bundle)), plan.name, "holdout"),
            evaluation.long_metrics(evaluation.regression_metrics(_scored(ridge, data.test)), plan.name, "ridge"),
        ]
        if plan.transform == "log1p":
            tables.append(evaluation.long_metrics(
                evaluation.money_metrics(bundle.predictions), plan.name, "holdout, original units"))
        return materialize(evaluation.stacked(tables), "metrics")

    def rank(bundle: FittedTarget) -> DataFrame:
        return materialize(evaluation.permutation_importance(
            data.test.select(options.key, F.col("y_label").alias("y_true"), "features"),
            bundle.model.transform, spec.columns, key=options.key, repeats=options.repeats,
            seed=options.seed, trees=bundle.model.grown), "importance")

    n_test = data.test.count()
    return FittedTarget(
        plan, spec, data.encoding, ridge, partial(fit_trees, data.train, options, weighted=plan.weight is not None),
        predict, measure, rank if options.importance else None,
        {"n_rows": n_rows, "n_test": n_test, "n_train": n_rows - n_test})


def train(gold: DataFrame, options: TrainOptions = TrainOptions()) -> dict[str, FittedTarget]:
    """Both targets from one Gold table; an empty table is refused."""
    if gold.isEmpty():
        raise ValueError("the Gold table is empty; build the layers first")
    fitted = {plan.name: train_target(gold, plan, options) for plan in (REVENUE, RATING)}
    fit_all(list(fitted.values()))
    return fitted


def fit_all(bundles: Sequence[FittedTarget]) -> None:
    """Fit the trees of several targets side by side."""
    spark = bundles[0].encoding.table.sparkSession
    in_parallel(spark, [partial(getattr, bundle, "model") for bundle in bundles])


def train_from_layout(spark: SparkSession, layout: Layout,
                      options: TrainOptions = TrainOptions()) -> dict[str, FittedTarget]:
    """Read Gold, train both targets and store models, tables and metrics."""
    fitted = train(read_gold(spark, layout.gold, required=True), options)
    for name, bundle in fitted.items():
        save(bundle, layout.model(name))
    overwrite_table(evaluation.stacked([bundle.metrics for bundle in fitted.values()]), layout.metrics)
    return fitted


# --- scoring -------------------------------------------------------------------------

def score(bundle: FittedTarget, scenarios: DataFrame, *, output: str = "prediction") -> DataFrame:
    """Any number of scenarios with their prediction added as a column.

    Missing and empty names count as "Unknown", unseen ones get the overall mean.
    """
    whole = scenarios.withColumn("_scenario", F.struct(*scenarios.columns))
    rows = feature_frame(whole, bundle.spec, keep=["_scenario"])
    ready = _features(bundle.encoding.apply(rows), bundle.spec, ["_scenario"])
    # Hundreds of trees a row are worth all cores, however few files the scenarios come from.
    spread = ready.repartition(2 * scenarios.sparkSession.sparkContext.defaultParallelism)
    raw = bundle.model.transform(as_vectors(spread))
    return raw.select("_scenario.*", post_processed(
        F.col("y_pred"), bundle.plan.column, bundle.plan.transform).alias(output))


def score_scenarios(revenue: FittedTarget, rating: FittedTarget, scenarios: DataFrame) -> DataFrame:
    """Scenarios with predicted revenue, rating and the return the revenue implies.

    The second model scores the output of the first, so the two need no join.
    """
    fit_all([revenue, rating])
    both = score(rating, score(revenue, scenarios, output="predicted_revenue_musd"),
                 output="predicted_rating")
    return both.withColumn(
        "implied_roi", implied_roi(F.col("predicted_revenue_musd"), F.col("budget_musd")))


# --- keeping -------------------------------------------------------------------------

def save(bundle: FittedTarget, uri: str) -> None:
    """Store models with Spark ML persistence and everything else as tables, all or nothing.

    Every save writes a folder of its own below ``uri`` and then switches the small pointer
    file ``current`` to it. Until then the former bundle stays whole, and a save that fails
    leaves it in place; folders that nothing points to any more are deleted last.
    """
    spark = bundle.encoding.table.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    folder = f"{uri}/{version}"
    bundle.encoding.table.write.parquet(f"{folder}/encoding")
    bundle.metrics.write.parquet(f"{folder}/metrics")  # fits the trees beside the folds, if need be
    bundle.model.write().save(f"{folder}/trees")
    bundle.predictions.write.parquet(f"{folder}/predictions")
    if bundle.importance is not None:
        bundle.importance.write.parquet(f"{folder}/importance")
    facts = {"plan": vars(bundle.plan), "genres": list(bundle.spec.genres),
             "encoded": list(bundle.encoding.columns), "prior": bundle.encoding.prior,
             "ridge": [*bundle.ridge.coefficients.toArray().tolist(), bundle.ridge.intercept],
             "counts": bundle.counts, "has_importance": bundle.importance is not None}
    spark.createDataFrame([(json.dumps(facts),)], "value string").write.text(f"{folder}/facts")
    replace_small_file(spark, f"{uri}/{POINTER}", version)
    for name in child_names(spark, uri):
        if name.startswith("version-") and name != version:
            delete_path(spark, f"{uri}/{name}")


def bundle_exists(spark: SparkSession, uri: str) -> bool:
    return path_exists(spark, f"{uri}/{POINTER}")


def load(spark: SparkSession, uri: str) -> FittedTarget:
    """The bundle that the pointer of ``uri`` names, for scoring and reports."""
    if not bundle_exists(spark, uri):
        raise MissingTable(f"no model at {uri}; train first")
    folder = f"{uri}/{read_small_file(spark, f'{uri}/{POINTER}')}"
    facts = json.loads(spark.read.text(f"{folder}/facts").first()["value"])
    *factors, intercept = facts["ridge"]

    def stored(name: str) -> Callable[[FittedTarget], DataFrame]:
        return lambda _: spark.read.parquet(f"{folder}/{name}")

    return FittedTarget(
        TargetPlan(**facts["plan"]), FeatureSpec(tuple(facts["genres"])),
        TargetEncoding(tuple(facts["encoded"]), spark.read.parquet(f"{folder}/encoding"),
                       facts["prior"]),
        RidgeModel(DenseVector(factors), intercept), partial(GBTRegressionModel.load, f"{folder}/trees"),
        stored("predictions"), stored("metrics"), stored("importance") if facts["has_importance"] else None,
        facts["counts"])
