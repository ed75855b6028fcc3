"""Gold rows to model features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from marquee import config
from marquee.functions import (
    hash_bucket, hash_fraction, known_or_unknown, month_angle, multi_hot,
)
from marquee.operators.profile import element_counts

NUMERIC = ("budget_musd", "runtime")
CYCLICAL = ("month_sin", "month_cos")
CATEGORICAL = ("director_name", "lead_production_company", "lead_cast_name")
SCENARIO_SCHEMA = ("scenario_id bigint, budget_musd double, runtime double, release_month int, "
                   "genres array<string>, director_name string, lead_production_company string, "
                   "lead_cast_name string")


@dataclass(frozen=True)
class FeatureSpec:
    """What was learned about the feature columns: the genre vocabulary."""

    genres: tuple[str, ...] = ()

    @property
    def multi_hot_columns(self) -> list[str]:
        return [f"genre_{genre}" for genre in self.genres]

    @property
    def columns(self) -> list[str]:
        return [*NUMERIC, *CYCLICAL, *self.multi_hot_columns, *CATEGORICAL]


def fit_vocabulary(df: DataFrame, *, k: int = config.TOP_GENRES) -> FeatureSpec:
    """The ``k`` most frequent genres; at most ``k`` names reach the driver."""
    if "genres" not in df.columns:
        return FeatureSpec()
    return FeatureSpec(tuple(row.genre for row in
                             element_counts(df, "genres", k=k, name="genre").collect()))


def training_rows(gold: DataFrame, target: str) -> DataFrame:
    """Rows with budget, month, genres and target; revenue must also be positive."""
    kept = gold.dropna(subset=["budget_musd", "release_month", "genres", target])
    return kept.where(F.col(target) > 0) if target == "revenue_musd" else kept


def feature_frame(df: DataFrame, spec: FeatureSpec, *, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` plus all feature columns in fixed order, computed in one projection.

    Categories stay text here; they are encoded against a target later.
    """
    angle = month_angle(F.col("release_month"))
    computed: dict[str, Column] = {
        "budget_musd": F.coalesce(F.col("budget_musd").cast("double"), F.lit(0.0)),
        "runtime": F.coalesce(F.col("runtime").cast("double"), F.lit(0.0)),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
        **{f"genre_{genre}": multi_hot(F.col("genres"), genre) for genre in spec.genres},
        **{name: known_or_unknown(F.col(name)) for name in CATEGORICAL},
    }
    return df.select(*keep, *[computed[name].alias(name) for name in spec.columns])


def with_split(df: DataFrame, key: str = "movie_id", *, seed: int = config.SEED,
               test_fraction: float = config.TEST_FRACTION,
               validation_fraction: float = config.VALIDATION_FRACTION,
               folds: int = config.FOLDS) -> DataFrame:
    """Add holdout flag, early-stopping flag and the two kinds of folds.

    Each is a salted hash of the key: repeatable, independent of partitioning, and
    carried as a column, so weights and labels can never be split differently.
    """
    column = F.col(key)
    return df.withColumns({
        "is_holdout": hash_fraction(column, f"split-{seed}") < test_fraction,
        "is_validation": hash_fraction(column, f"validation-{seed}") < validation_fraction,
        "fold": hash_bucket(column, folds, f"folds-{seed}"),
        "encoder_fold": hash_bucket(column, folds, f"encoder-{seed}"),
    })
