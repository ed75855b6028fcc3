"""Features, encodings, metrics and models, on the sales tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.functions import clipped_log_weight, implied_roi as roi_of, post_processed
from marquee.modeling import evaluation, training
from marquee.modeling.encoding import encoded_name, fit_target_encoding, oof_target_encode
from marquee.modeling.features import (
    CATEGORICAL, CYCLICAL, FeatureSpec, feature_frame as features_of, fit_vocabulary,
    training_rows, with_split,
)
from marquee.operators.profile import element_counts
from marquee.plans.oracle_views import with_gold, with_views
from marquee.plans.order_tables import order_gold, stored_gold, table
from marquee.plans.registry import REGISTRY
from marquee.session import materialize

_FEATURES = ("movie_id", "budget_musd", "runtime", "release_month", "genres", *CATEGORICAL)
_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _hash(key: str, salt: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}:' || {key}), 1, 8) AS BIGINT)"


# --- features ------------------------------------------------------------------

@REGISTRY.add(with_gold("""
    SELECT genre, count(*) AS n FROM by_genre GROUP BY genre ORDER BY n DESC, genre LIMIT 15"""))
def top_genre_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return element_counts(order_gold(spark, sf_dir, ("genres",)), "genres", k=15, name="genre")


@REGISTRY.add(with_gold("""
    SELECT movie_id, round(ln(1 + revenue_musd), 9) AS label FROM gold
    WHERE budget_musd IS NOT NULL AND release_month IS NOT NULL AND genres IS NOT NULL
      AND revenue_musd > 0"""))
def train_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = order_gold(spark, sf_dir,
                      ("movie_id", "budget_musd", "release_month", "genres", "revenue_musd"))
    return training_rows(gold, "revenue_musd").select(
        "movie_id", F.round(F.log1p("revenue_musd"), 9).alias("label"))


def _feature_sql(source: str, key: str, genres: tuple[str, ...]) -> str:
    angle = "2 * pi() * (coalesce(release_month, 1) - 1) / 12"
    hot = ", ".join(f"CAST(coalesce(list_contains(genres, '{g}'), false) AS INTEGER) AS \"genre_{g}\""
                    for g in genres)
    names = ", ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE {c} END AS {c}"
                      for c in CATEGORICAL)
    return f"""
        SELECT {key}, coalesce(CAST(budget_musd AS DOUBLE), 0.0) AS budget_musd,
               coalesce(CAST(runtime AS DOUBLE), 0.0) AS runtime,
               round(sin({angle}), 6) + 0.0 AS month_sin, round(cos({angle}), 6) + 0.0 AS month_cos,
               {hot}, {names}
        FROM {source}"""


def _rounded_angles(df: DataFrame) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.withColumns({name: F.round(name, 6) + F.lit(0.0) for name in CYCLICAL})


@REGISTRY.add(with_gold(_feature_sql("gold", "movie_id", _TYPES)))
def feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = stored_gold(spark, sf_dir, _FEATURES)
    return _rounded_angles(features_of(gold, fit_vocabulary(gold), keep=["movie_id"]))


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks about one film; names are partly missing, empty or unseen."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("scenario_id"),
        F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)).alias("budget_musd"),
        (F.col("c_nationkey") * 10).cast("double").alias("runtime"),
        (F.col("c_nationkey") % 12 + 1).cast("int").alias("release_month"),
        F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.array(F.lit("PROMO"), "c_mktsegment"))
        .alias("genres"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "")
        .otherwise(F.concat(F.lit("Supplier#"), F.lpad(F.col("c_nationkey").cast("string"), 9, "0")))
        .alias("director_name"),
        F.when(F.col("c_nationkey") > 5, F.concat(F.lit("Brand#"), F.col("c_nationkey")
                                                  .cast("string")))
        .alias("lead_production_company"),
        F.col("c_name").alias("lead_cast_name"),
    )


_SCENARIOS = """
    SELECT c_custkey AS scenario_id, greatest(c_acctbal / 10000, 0.0) AS budget_musd,
           CAST(c_nationkey * 10 AS DOUBLE) AS runtime,
           CAST(c_nationkey % 12 + 1 AS INTEGER) AS release_month,
           CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN ['PROMO', c_mktsegment] END AS genres,
           CASE WHEN c_mktsegment = 'MACHINERY' THEN ''
                ELSE 'Supplier#' || lpad(CAST(c_nationkey AS VARCHAR), 9, '0') END AS director_name,
           CASE WHEN c_nationkey > 5 THEN 'Brand#' || c_nationkey END AS lead_production_company,
           c_name AS lead_cast_name
    FROM customer"""


@REGISTRY.add(with_views(_feature_sql("scenarios", "scenario_id", ("PROMO", "BUILDING")),
                         scenarios=_SCENARIOS))
def scenario_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_angles(features_of(_scenarios(spark, sf_dir), FeatureSpec(("PROMO", "BUILDING")),
                                       keep=["scenario_id"]))


_SPLIT = f"""
    SELECT o_orderkey, {_hash('o_orderkey', 'split-42')} / 4294967296.0 < 0.2 AS is_holdout,
           {_hash('o_orderkey', 'validation-42')} / 4294967296.0 < 0.15 AS is_validation,
           {_hash('o_orderkey', 'folds-42')} % 5 AS fold,
           {_hash('o_orderkey', 'encoder-42')} % 5 AS encoder_fold
    FROM orders"""


@REGISTRY.add(_SPLIT)
def split_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


# --- target encoding -----------------------------------------------------------

def _encoded_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = order_gold(spark, sf_dir, ("movie_id", "vote_average", *CATEGORICAL))
    named = gold.withColumns({
        name: F.coalesce(F.col(name), F.lit("Unknown")) for name in CATEGORICAL})
    return materialize(with_split(named), "encoder-input")


_LABELLED = f"""
    SELECT movie_id, vote_average AS y,
           coalesce(director_name, 'Unknown') AS director_name,
           coalesce(lead_production_company, 'Unknown') AS lead_production_company,
           coalesce(lead_cast_name, 'Unknown') AS lead_cast_name,
           {_hash('movie_id', 'encoder-42')} % 5 AS k,
           {_hash('movie_id', 'split-42')} / 4294967296.0 < 0.2 AS is_holdout
    FROM gold"""


def _shrunk(n: str, mean: str, scatter: str, prior: str, spread: str) -> str:
    return (f"CASE WHEN coalesce({n}, 0) = 0 OR {spread} * {n} + {scatter} = 0 THEN {prior} "
            f"ELSE ({spread} * {n} * {mean} + {scatter} * {prior}) / ({spread} * {n} + {scatter}) END")


def _oof_sql() -> str:
    views = {"labelled": _LABELLED,
             "priors": "SELECT f.k, avg(y) AS prior, var_pop(y) AS spread FROM labelled l "
                       "JOIN (SELECT DISTINCT k FROM labelled) f ON l.k <> f.k GROUP BY f.k"}
    for name in CATEGORICAL:
        views[f"enc_{name}"] = f"""
            SELECT c.{name} AS category, f.k, count(*) AS n, avg(y) AS mean, var_pop(y) AS scatter
            FROM labelled c JOIN (SELECT DISTINCT k FROM labelled) f ON c.k <> f.k
            GROUP BY c.{name}, f.k"""
    columns = ", ".join(
        f"round({_shrunk(f'e{i}.n', f'e{i}.mean', f'e{i}.scatter', 'p.prior', 'p.spread')}, 6) "
        f"AS {encoded_name(name)}" for i, name in enumerate(CATEGORICAL))
    joins = " ".join(
        f"LEFT JOIN enc_{name} e{i} ON e{i}.category = l.{name} AND e{i}.k = l.k"
        for i, name in enumerate(CATEGORICAL))
    return with_gold(f"SELECT movie_id, {columns} FROM labelled l JOIN priors p ON p.k = l.k {joins}",
                     **views)


@REGISTRY.add(_oof_sql())
def oof_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = oof_target_encode(_encoded_input(spark, sf_dir), CATEGORICAL, "vote_average")
    return encoded.select("movie_id", *[
        F.round(encoded_name(name), 6).alias(encoded_name(name)) for name in CATEGORICAL])


def _full_sql() -> str:
    views = {"labelled": _LABELLED,
             "prior": "SELECT avg(y) AS prior, var_pop(y) AS spread FROM labelled "
                      "WHERE NOT is_holdout"}
    for name in CATEGORICAL:
        views[f"enc_{name}"] = f"""
            SELECT {name} AS category, count(*) AS n, avg(y) AS mean, var_pop(y) AS scatter
            FROM labelled WHERE NOT is_holdout GROUP BY {name}"""
    columns = ", ".join(
        f"round({_shrunk(f'e{i}.n', f'e{i}.mean', f'e{i}.scatter', 'p.prior', 'p.spread')}, 6) "
        f"AS {encoded_name(name)}" for i, name in enumerate(CATEGORICAL))
    joins = " ".join(f"LEFT JOIN enc_{name} e{i} ON e{i}.category = l.{name}"
                     for i, name in enumerate(CATEGORICAL))
    return with_gold(f"SELECT movie_id, {columns} FROM labelled l, prior p {joins} WHERE is_holdout"
                     .replace("FROM labelled l, prior p", "FROM labelled l JOIN prior p ON true"),
                     **views)


@REGISTRY.add(_full_sql())
def full_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _encoded_input(spark, sf_dir)
    encoding = fit_target_encoding(rows.where(~F.col("is_holdout")), CATEGORICAL, "vote_average")
    return encoding.apply(rows.where("is_holdout")).select("movie_id", *[
        F.round(encoded_name(name), 6).alias(encoded_name(name)) for name in CATEGORICAL])


# --- transforms and metrics ------------------------------------------------------

@REGISTRY.add(with_gold("""
    SELECT movie_id, round(ln(1 + revenue_musd), 9) AS log_revenue,
           round(exp(budget_musd) - 1, 9) AS back FROM gold"""))
def target_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_gold(spark, sf_dir, ("movie_id", "revenue_musd", "budget_musd")).select(
        "movie_id", F.round(F.log1p("revenue_musd"), 9).alias("log_revenue"),
        F.round(F.expm1("budget_musd"), 9).alias("back"))


@REGISTRY.add("""
    SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 9) AS weight FROM customer""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(clipped_log_weight(F.col("c_acctbal")), 9).alias("weight"))


@REGISTRY.add("""
    SELECT c_custkey, round(greatest(exp(c_acctbal / 2000) - 1, 0), 6) AS revenue,
           least(greatest(c_acctbal / 500, 0), 10) AS rating,
           CASE WHEN c_nationkey > 0 THEN (c_acctbal - c_nationkey) / c_nationkey ELSE 0 END
             AS implied_roi
    FROM customer""")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.round(post_processed(balance / 2000, "revenue_musd", "log1p"), 6).alias("revenue"),
        post_processed(balance / 500, "vote_average", "identity").alias("rating"),
        roi_of(balance, F.col("c_nationkey")).alias("implied_roi"))


def _guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget taken as a guess of the revenue."""
    return order_gold(spark, sf_dir, ("revenue_musd", "budget_musd")).select(
        F.col("revenue_musd").alias("y_true"), F.col("budget_musd").alias("y_pred"))


_GUESSES = "SELECT revenue_musd AS y, budget_musd AS p FROM gold"


@REGISTRY.add(with_gold("""
    SELECT round(1 - sum((y - p) ^ 2) / (count(y) * var_pop(y)), 6) AS r2,
           round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse
    FROM guesses""", guesses=_GUESSES))
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.regression_metrics(_guesses(spark, sf_dir))
    return scores.select(*[F.round(name, 6).alias(name) for name in scores.columns])


@REGISTRY.add(with_gold("""
    SELECT round(avg(abs(y - p)), 6) AS mae_musd, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse_musd,
           round(avg(abs(y - p) / y) FILTER (WHERE y >= 0.2), 6) AS "mape_over_1M"
    FROM guesses""", guesses=_GUESSES))
def money_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.money_metrics(_guesses(spark, sf_dir), floor=0.2)
    return scores.select(*[F.round(name, 6).alias(name) for name in scores.columns])


@REGISTRY.add(with_gold("""
    SELECT least(min(y), min(p)) AS low, greatest(max(y), max(p)) AS high FROM guesses""",
    guesses=_GUESSES))
def axis_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.axis_bounds(_guesses(spark, sf_dir))


# --- ridge: the closed form, in SQL too ---------------------------------------------

_OPTIONS = training.TrainOptions()
_INPUTS = [encoded_name(name) if name in CATEGORICAL else name for name in FeatureSpec(_TYPES).columns]


def _gold_for_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_gold(spark, sf_dir, (
        *_FEATURES, "revenue_musd", "vote_average", "vote_count"))


def _gold_for_ridges(spark: SparkSession, sf_dir: str, *plans: training.TargetPlan) -> DataFrame:
    """Ridges are never weighted, so they need the targets only."""
    return stored_gold(spark, sf_dir, (*_FEATURES, *[plan.column for plan in plans]))


def _labelled(gold: DataFrame, plan: training.TargetPlan, **carried: Sequence[str]):
    spec = fit_vocabulary(gold)
    return spec, training.labelled_rows(gold, plan, _OPTIONS, spec, **carried)


def _holdout_ridge(gold: DataFrame, plan: training.TargetPlan, *more: str) -> training.RidgeFits:
    """The ridge that leaves the holdout out, which is part 1; its rows carry the columns ``more`` too."""
    return _ridge_on(*_labelled(gold, plan, carried=("y_label", "is_holdout", "encoder_fold", *more)))


def _ridge_on(spec: FeatureSpec, rows: DataFrame) -> training.RidgeFits:
    return training.fit_ridges(rows.withColumn("held", F.col("is_holdout").cast("int")), spec, _OPTIONS,
                               part="held", tests=[1])


def _inputs_sql(source: str, table: str, encodings: list[str]) -> str:
    """The model inputs of rows of ``table`` as one list, encodings given as expressions."""
    angle = f"2 * pi() * (coalesce({table}.release_month, 1) - 1) / 12"
    hot = [f"CAST(coalesce(list_contains({table}.genres, '{g}'), false) AS DOUBLE)" for g in _TYPES]
    plain = [f"coalesce(CAST({table}.{c} AS DOUBLE), 0.0)" for c in ("budget_musd", "runtime")]
    return f"[{', '.join([*plain, f'sin({angle})', f'cos({angle})', *hot, *encodings])}]"


def _ridge_views(name: str, label: str, where: str, members: str) -> dict[str, str]:
    """Views that fit a ridge per group g, and apply it to the group's test rows.

    ``members`` lists (g, movie_id, is_test); Gauss-Jordan elimination solves the normal equations.
    """
    lab, tr, te = f"{name}_lab", f"{name}_train", f"{name}_test"
    names = ", ".join(f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'Unknown' ELSE {c} END AS {c}" for c in CATEGORICAL)
    views = {
        lab: f"""
            SELECT g, is_test, movie_id, {label} AS y, budget_musd, runtime, release_month, genres, {names},
                   {_hash('movie_id', 'encoder-42')} % 5 AS k
            FROM gold JOIN ({members}) m USING (movie_id)
            WHERE budget_musd IS NOT NULL AND release_month IS NOT NULL AND genres IS NOT NULL AND {where}""",
        f"{name}_prior": f"SELECT g, avg(y) AS prior, var_pop(y) AS spread FROM {lab} WHERE NOT is_test GROUP BY g",
        f"{name}_oof_prior": f"""
            SELECT l.g, f.k, avg(y) AS prior, var_pop(y) AS spread FROM {lab} l
            JOIN (SELECT DISTINCT g, k FROM {lab}) f ON l.g = f.g AND l.k <> f.k WHERE NOT is_test GROUP BY l.g, f.k"""}
    for c in CATEGORICAL:
        views[f"{name}_full_{c}"] = f"""
            SELECT g, {c} AS category, count(*) AS n, avg(y) AS mean, var_pop(y) AS scatter
            FROM {lab} WHERE NOT is_test GROUP BY g, {c}"""
        views[f"{name}_oof_{c}"] = f"""
            SELECT l.g, l.{c} AS category, f.k, count(*) AS n, avg(y) AS mean, var_pop(y) AS scatter
            FROM {lab} l JOIN (SELECT DISTINCT g, k FROM {lab}) f ON l.g = f.g AND l.k <> f.k
            WHERE NOT is_test GROUP BY l.g, l.{c}, f.k"""
    encodings = [_shrunk(f"e{i}.n", f"e{i}.mean", f"e{i}.scatter", "p.prior", "p.spread") for i in range(len(CATEGORICAL))]

    def joined(kind: str, fold: str) -> str:
        return " ".join(f"LEFT JOIN {name}_{kind}_{c} e{i} ON e{i}.g = l.g AND e{i}.category = l.{c}{fold.format(f'e{i}')}"
                        for i, c in enumerate(CATEGORICAL))

    views |= {
        tr: f"""
            SELECT l.g, l.movie_id, l.y, {_inputs_sql(lab, 'l', encodings)} AS x FROM {lab} l
            JOIN {name}_oof_prior p ON p.g = l.g AND p.k = l.k {joined('oof', ' AND {}.k = l.k')} WHERE NOT l.is_test""",
        te: f"""
            SELECT l.g, l.movie_id, l.y, {_inputs_sql(lab, 'l', encodings)} AS x FROM {lab} l
            JOIN {name}_prior p ON p.g = l.g {joined('full', '')} WHERE l.is_test""",
        f"{name}_long": f"""
            SELECT g, movie_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM {tr}""",
        f"{name}_scale": f"""
            SELECT g, j, avg(v) AS m, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS s
            FROM {name}_long GROUP BY g, j""",
        f"{name}_z": f"""
            SELECT g, movie_id, j, (v - m) / s AS z FROM {name}_long JOIN {name}_scale USING (g, j)""",
        f"{name}_mean": f"SELECT g, avg(y) AS centre FROM {tr} GROUP BY g",
        f"{name}_gram": f"""
            SELECT a.g, a.j AS i, b.j, sum(a.z * b.z) + CASE WHEN a.j = b.j THEN 1 ELSE 0 END AS v
            FROM {name}_z a JOIN {name}_z b ON a.g = b.g AND a.movie_id = b.movie_id GROUP BY a.g, a.j, b.j
            UNION ALL
            SELECT z.g, z.j, {len(_INPUTS) + 1}, sum(z.z * (t.y - centre)) FROM {name}_z z
            JOIN {tr} t ON t.g = z.g AND t.movie_id = z.movie_id JOIN {name}_mean c ON c.g = z.g GROUP BY z.g, z.j""",
        f"{name}_solved": f"""
            SELECT g, 0 AS k, list(r ORDER BY i) AS m
            FROM (SELECT g, i, list(v ORDER BY j) AS r FROM {name}_gram GROUP BY g, i) GROUP BY g
            UNION ALL
            SELECT g, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k + 1
                THEN list_transform(r, lambda v: v / r[k + 1])
                ELSE list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
            FROM {name}_solved WHERE k < {len(_INPUTS)}""",
        f"{name}_coef": f"""
            SELECT g, list(m[CAST(j AS INTEGER)][{len(_INPUTS) + 1}] / s ORDER BY j) AS b,
                   any_value(centre) - sum(m[CAST(j AS INTEGER)][{len(_INPUTS) + 1}] / s * c.m) AS b0
            FROM {name}_solved JOIN {name}_scale c USING (g) JOIN {name}_mean USING (g)
            WHERE k = {len(_INPUTS)} GROUP BY g""".replace("m[CAST", "solved.m[CAST").replace(
                f"FROM {name}_solved JOIN", f"FROM {name}_solved solved JOIN"),
        f"{name}_scored": f"""
            SELECT g, movie_id, y, x, b, b0 + list_inner_product(x, b) AS p FROM {te} JOIN {name}_coef USING (g)""",
    }
    return views


_HOLDOUT = f"SELECT 0 AS g, movie_id, {_hash('movie_id', 'split-42')} / 4294967296.0 < 0.2 AS is_test FROM gold"
_FOLDS = f"""SELECT g, movie_id, {_hash('movie_id', 'folds-42')} % 5 = g AS is_test
             FROM gold, (SELECT unnest(range(5)) AS g) f"""
_MONEY = ("ln(1 + revenue_musd)", "revenue_musd > 0")
_STARS = ("vote_average", "vote_average IS NOT NULL")


def _with_ridge(body: str, **views: str) -> str:
    return with_gold(body, **views).replace("WITH ", "WITH RECURSIVE ", 1)


_R2 = "1 - sum((y - p) ^ 2) / (count(y) * var_pop(y))"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@REGISTRY.add(_with_ridge(f"""
    SELECT round({_R2}, 6) AS r2, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) ^ 2)), 6) AS rmse
    FROM money_scored""", **_ridge_views("money", *_MONEY, _HOLDOUT)))
def ridge_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    ridge = _holdout_ridge(_gold_for_ridges(spark, sf_dir, training.REVENUE), training.REVENUE)
    return _rounded(evaluation.regression_metrics(ridge.scored()))


@REGISTRY.add(_with_ridge(f"""
    SELECT round(avg(r2), 6) AS r2, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse
    FROM (SELECT {_R2} AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ^ 2)) AS rmse
          FROM money_scored GROUP BY g)""", **_ridge_views("money", *_MONEY, _FOLDS)))
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation of the ridge: encoder and model are fitted anew in every fold."""
    spec, rows = _labelled(_gold_for_ridges(spark, sf_dir, training.REVENUE), training.REVENUE,
                           carried=("y_label", "fold", "encoder_fold"))
    return _rounded(training.ridge_cross_validated(rows, spec, _OPTIONS))


_IMPORTANCE = f"""
    SELECT names[j] AS feature, round(max(base) - avg(r2), 6) AS importance_mean,
           round(stddev_pop(r2), 6) AS importance_std
    FROM (SELECT j, repeat, {_R2} AS r2 FROM shuffled GROUP BY j, repeat)
    JOIN (SELECT {_R2} AS base FROM money_scored) ON true
    JOIN (SELECT {[*FeatureSpec(_TYPES).columns]} AS names) ON true GROUP BY ALL"""
_SHUFFLED = {**_ridge_views("money", *_MONEY, _HOLDOUT), "marked": f"""
        SELECT *, md5('donor-42:' || repeat || ':' || movie_id) AS mark
        FROM money_scored, (SELECT unnest(range({_OPTIONS.repeats})) AS repeat) r""",
    "paired": """
        SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS d
        FROM marked WINDOW w AS (PARTITION BY repeat ORDER BY mark, movie_id)""",
    "shuffled": """
        SELECT y, repeat, j, p + b[j] * (d[j] - x[j]) AS p
        FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM paired)"""}


@REGISTRY.add(_with_ridge(f"SELECT * FROM ({_IMPORTANCE}) ORDER BY importance_mean DESC, feature LIMIT 5", **_SHUFFLED))
def top_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most important features of the ridge, as in a report."""
    return evaluation.top_importances(ridge_importance(spark, sf_dir), n=5)


_THREE = f"{_R2} AS r2, avg(abs(y - p)) AS mae, sqrt(avg((y - p) ^ 2)) AS rmse"


@REGISTRY.add(_with_ridge(f"""
    SELECT target, split, round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse FROM (
        SELECT 'revenue' AS target, 'ridge' AS split, {_THREE} FROM money_scored
        UNION ALL SELECT 'rating', 'ridge', {_THREE} FROM stars_scored
        UNION ALL SELECT 'rating', 'cross-validation', avg(r2), avg(mae), avg(rmse)
                  FROM (SELECT {_THREE} FROM folds_scored GROUP BY g))""",
    **_ridge_views("money", *_MONEY, _HOLDOUT), **_ridge_views("stars", *_STARS, _HOLDOUT),
    **_ridge_views("folds", *_STARS, _FOLDS)))
def metrics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of both targets side by side, a row per target and split."""
    gold = _gold_for_ridges(spark, sf_dir, training.REVENUE, training.RATING)

    def holdout(plan: training.TargetPlan, *more: str) -> tuple[training.RidgeFits, DataFrame]:
        ridge = _holdout_ridge(gold, plan, *more)
        return ridge, evaluation.long_metrics(evaluation.regression_metrics(ridge.scored()), plan.name, "ridge")

    (_, money), (ridge, stars) = training.in_parallel(
        spark, [partial(holdout, training.REVENUE), partial(holdout, training.RATING, "fold")])
    folds = training.ridge_cross_validated(ridge.rows, ridge.spec, _OPTIONS)
    tables = [money, stars, evaluation.long_metrics(folds, training.RATING.name, "cross-validation")]
    return _rounded(evaluation.wide_metrics(materialize(evaluation.stacked(tables), "metrics")))


@REGISTRY.add(_with_ridge(_IMPORTANCE, **_SHUFFLED))
def ridge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of R2 of the ridge when one feature is shuffled, on the holdout."""
    ridge = _holdout_ridge(_gold_for_ridges(spark, sf_dir, training.REVENUE), training.REVENUE)
    held = materialize(ridge.held("movie_id", F.col("y_label").alias("y_true")), "held")
    model = ridge.models[1]
    return _rounded(evaluation.linear_importance(
        held, model.coefficients.toArray().tolist(), model.intercept, ridge.spec.columns,
        repeats=_OPTIONS.repeats, seed=_OPTIONS.seed))


def _ridge_bundle(spec: FeatureSpec, rows: DataFrame, plan: training.TargetPlan) -> training.FittedTarget:
    fits = _ridge_on(spec, rows)
    ridge = fits.models[1]

    def absent(bundle: training.FittedTarget) -> DataFrame:
        raise LookupError("this bundle only scores")

    return training.FittedTarget(plan, fits.spec, fits.encodings.of(1), ridge, lambda: ridge, absent, absent)


def _scenario_score(name: str) -> str:
    encodings = [_shrunk(f"e{i}.n", f"e{i}.mean", f"e{i}.scatter", "p.prior", "p.spread") for i in range(len(CATEGORICAL))]
    joins = " ".join(f"LEFT JOIN {name}_full_{c} e{i} ON e{i}.category = "
                     f"CASE WHEN s.{c} IS NULL OR s.{c} = '' THEN 'Unknown' ELSE s.{c} END"
                     for i, c in enumerate(CATEGORICAL))
    return f"""SELECT scenario_id, s.budget_musd AS budget, b0 + list_inner_product({_inputs_sql('', 's', encodings)}, b) AS p
               FROM scenarios s JOIN {name}_prior p ON true JOIN {name}_coef ON true {joins}"""


@REGISTRY.add(_with_ridge("""
    SELECT scenario_id, round(greatest(exp(m.p) - 1, 0), 6) AS predicted_revenue_musd,
           round(least(greatest(r.p, 0), 10), 6) AS predicted_rating,
           round(CASE WHEN budget > 0 THEN (greatest(exp(m.p) - 1, 0) - budget) / budget ELSE 0 END, 4) AS implied_roi
    FROM money_scenario m JOIN (SELECT scenario_id, p FROM stars_scenario) r USING (scenario_id)""",
    scenarios=_SCENARIOS, **_ridge_views("money", *_MONEY, _HOLDOUT), **_ridge_views("stars", *_STARS, _HOLDOUT),
    money_scenario=_scenario_score("money"), stars_scenario=_scenario_score("stars")))
def ridge_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenarios scored by the two ridges, with the return that the revenue implies."""
    gold = _gold_for_ridges(spark, sf_dir, training.REVENUE, training.RATING)
    plans, spec = (training.REVENUE, training.RATING), fit_vocabulary(gold)
    labelled = training.labelled_together(gold, plans, _OPTIONS, spec, ("is_holdout", "encoder_fold"))
    bundles = training.in_parallel(spark, [
        partial(_ridge_bundle, spec, rows, plan) for plan, rows in zip(plans, labelled)])
    scored = training.score_scenarios(*bundles, _scenarios(spark, sf_dir))
    return scored.select("scenario_id", F.round("predicted_revenue_musd", 6).alias("predicted_revenue_musd"),
                         F.round("predicted_rating", 6).alias("predicted_rating"),
                         F.round("implied_roi", 4).alias("implied_roi"))


# --- boosted trees: no SQL twin -------------------------------------------------------

@REGISTRY.add()
def gbt_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.train_target(_gold_for_models(spark, sf_dir), training.RATING, _OPTIONS).metrics


@REGISTRY.add()
def cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, rows = _labelled(_gold_for_models(spark, sf_dir), training.REVENUE)
    return training.cross_validated(rows, spec, _OPTIONS)


@REGISTRY.add()
def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fitted trees, on the holdout."""
    return training.train_target(
        _gold_for_models(spark, sf_dir), training.REVENUE, _OPTIONS).importance


@REGISTRY.add()
def score_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold_for_models(spark, sf_dir)
    revenue = training.train_target(gold, training.REVENUE, _OPTIONS)
    rating = training.train_target(gold, training.RATING, _OPTIONS)
    return training.score_scenarios(revenue, rating, _scenarios(spark, sf_dir)).select(
        "scenario_id", "predicted_revenue_musd", "predicted_rating", "implied_roi")
