"""Target encoding of categories, shrunk towards the overall mean.

Empirical-Bayes shrinkage after Micci-Barreca (2001): a category's mean counts the more
the more rows it has and the less they scatter. Training rows are encoded out of fold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.session import materialize


def encoded_name(column: str) -> str:
    return f"{column}_encoded"


def shrunk_mean(n: Column, total: Column, squares: Column, prior_mean: Column,
                prior_variance: Column) -> Column:
    """Encoding from a category's count, sum and sum of squares.

    Without rows, or if nothing scatters anywhere, the prior mean is all there is.
    """
    mean = F.try_divide(total, n)
    scatter = F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0))
    weight = F.try_divide(prior_variance * n, prior_variance * n + scatter)
    return F.coalesce(weight * mean + (1 - weight) * prior_mean, prior_mean)


def _variance(n: Column, total: Column, squares: Column) -> Column:
    mean = F.try_divide(total, n)
    return F.greatest(F.try_divide(squares, n) - mean * mean, F.lit(0.0))


_SUMS = ("n", "total", "squares")


def _centre(df: DataFrame, label: str) -> float:
    """The overall mean. Sums are taken of distances from it, so that squares of large labels
    don't swallow their scatter."""
    return df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0


def _sums(label: str, centre: float) -> list[Column]:
    y = F.col(label).cast("double") - F.lit(centre)
    return [F.count(y).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares")]


def _long(df: DataFrame, columns: Sequence[str], *carried: str) -> DataFrame:
    """One row per (row, encoded column), so all columns are aggregated in one pass."""
    return df.select(*carried, F.inline(F.array(*[
        F.struct(F.lit(name).alias("feature"), F.col(name).alias("category"))
        for name in columns
    ])))


@dataclass(frozen=True)
class CategorySums:
    """Sums of the label per (fit, feature, category, fold), stored: all encodings come from them."""

    table: DataFrame          # fit, feature, category, fold, n, total, squares
    centre: float             # the mean, from which the label's distances were summed
    feature: str              # any feature: every row has one category of it

    def overall(self, *by: str) -> DataFrame:
        """The same sums over all rows, per fit and ``by``; one row each."""
        one = self.table.where(F.col("feature") == self.feature)
        return materialize(one.groupBy("fit", *by).agg(*[F.sum(name).alias(name) for name in _SUMS]), "overall")


def category_sums(df: DataFrame, columns: Sequence[str], label: str, fold: Column, *,
                  part: Column | None = None, tests: Sequence[int] = (0,)) -> CategorySums:
    """One pass for the mean and one for the sums, whatever is encoded from them.

    With ``part`` there is a fit for each value of it in ``tests``, which learns from the rows
    of all other parts; the rows are read once for all fits. Without, one fit takes all rows.
    """
    centre = _centre(df, label)
    marked = df.withColumns({"_fold": fold, "_part": F.lit(-1) if part is None else part})
    sums = _long(marked, columns, "_part", "_fold", label).groupBy(
        "_part", "feature", "category", F.col("_fold").alias("fold")).agg(*_sums(label, centre))
    fits = sums.withColumn("fit", F.explode(F.array(*map(F.lit, tests)))).where(F.col("_part") != F.col("fit"))
    return CategorySums(
        materialize(fits.groupBy("fit", "feature", "category", "fold").agg(
            *[F.sum(name).alias(name) for name in _SUMS]), "category-sums"), centre, columns[0])


def fold_encodings(sums: CategorySums) -> tuple[DataFrame, DataFrame]:
    """(fit, feature, category, fold, encoding) out of fold, and the (fit, fold, prior_mean) beside it.

    What the other folds hold is the category's total minus its own fold.
    """
    of_category = Window.partitionBy("fit", "feature", "category")
    others = sums.table.select("fit", "feature", "category", "fold", *[
        (F.sum(name).over(of_category) - F.col(name)).alias(name) for name in _SUMS])

    # One row per fit and fold.
    everything = Window.partitionBy("fit")
    priors = sums.overall("fold").select("fit", "fold", *[
        (F.sum(name).over(everything) - F.col(name)).alias(f"p_{name}") for name in _SUMS])
    priors = materialize(priors.select(
        "fit", "fold", F.try_divide("p_total", "p_n").alias("prior_mean"),
        _variance(F.col("p_n"), F.col("p_total"), F.col("p_squares")).alias("prior_variance")), "priors")
    encodings = others.join(F.broadcast(priors), ["fit", "fold"]).select(
        "fit", "feature", "category", "fold",
        (shrunk_mean(F.col("n"), F.col("total"), F.col("squares"), F.col("prior_mean"),
                     F.col("prior_variance")) + sums.centre).alias("encoding"))
    return encodings, priors.select("fit", "fold", (F.col("prior_mean") + sums.centre).alias("prior_mean"))


def full_encodings(sums: CategorySums) -> tuple[DataFrame, dict[int, float]]:
    """(fit, feature, category, encoding) from all rows of a fit, and the prior of every fit."""
    facts = {row["fit"]: row for row in sums.overall().select(
        "fit", F.try_divide("total", "n").alias("mean"),
        _variance(F.col("n"), F.col("total"), F.col("squares")).alias("variance")).collect()}

    def fact(name: str) -> Column:
        pairs = [F.lit(value) for fit, row in facts.items() for value in (fit, row[name] or 0.0)]
        return F.try_element_at(F.create_map(*pairs), F.col("fit")) if pairs else F.lit(0.0)

    whole = sums.table.groupBy("fit", "feature", "category").agg(*[F.sum(name).alias(name) for name in _SUMS])
    table = whole.select("fit", "feature", "category", (shrunk_mean(
        F.col("n"), F.col("total"), F.col("squares"), fact("mean"), fact("variance")) + sums.centre).alias("encoding"))
    return table, {fit: (row["mean"] or 0.0) + sums.centre for fit, row in facts.items()}


def _look_up(df: DataFrame, table: DataFrame, columns: Sequence[str],
             fold: str | None) -> DataFrame:
    """Attach each column's encoding. The tables are stored, so their size is known to
    the planner; a frequent category in a table too large to broadcast is left to the
    adaptive skew join, which may split the left side of a left join."""
    for name in columns:
        part = table.where(F.col("feature") == name).select(
            F.col("category").alias("_category"),
            *([F.col("fold").alias("_fold")] if fold else []),
            F.col("encoding").alias(encoded_name(name)),
        )
        matches = F.col(name) == F.col("_category")
        if fold:
            matches &= F.col(fold) == F.col("_fold")
        df = df.join(part, matches, "left").drop("_category", "_fold")
    return df


def oof_target_encode(df: DataFrame, columns: Sequence[str], label: str, *,
                      fold: str = "encoder_fold", sums: CategorySums | None = None) -> DataFrame:
    """Encode each row from the rows of all other folds.

    Sums per (category, fold) are taken once, unless given.
    """
    encodings, priors = fold_encodings(sums or category_sums(df, columns, label, F.col(fold)))
    stored = materialize(encodings.drop("fit"), "fold-encodings", partition_by=["feature"])
    encoded = _look_up(df, stored, columns, fold)
    fallback = priors.select(F.col("fold").alias("_fold"), "prior_mean")
    encoded = encoded.join(F.broadcast(fallback), F.col(fold) == F.col("_fold"), "left")
    return encoded.withColumns({
        encoded_name(name): F.coalesce(encoded_name(name), "prior_mean") for name in columns
    }).drop("_fold", "prior_mean")


@dataclass(frozen=True)
class TargetEncoding:
    """Encodings learned from all training rows; unseen categories get ``prior``."""

    columns: tuple[str, ...]
    table: DataFrame          # feature, category, encoding
    prior: float

    def apply(self, df: DataFrame) -> DataFrame:
        encoded = _look_up(df, self.table, self.columns, None)
        return encoded.withColumns({
            encoded_name(name): F.coalesce(F.col(encoded_name(name)), F.lit(self.prior))
            for name in self.columns})


def fit_target_encoding(df: DataFrame, columns: Sequence[str], label: str, *,
                        sums: CategorySums | None = None) -> TargetEncoding:
    """The encodings of all rows; ``sums`` of the same rows and columns spare the passes over them."""
    table, priors = full_encodings(sums or category_sums(df, columns, label, F.lit(0)))
    return TargetEncoding(tuple(columns), materialize(table.drop("fit"), "encodings", partition_by=["feature"]),
                          next(iter(priors.values()), 0.0))


@dataclass(frozen=True)
class FitEncodings:
    """Encodings of several fits that leave out a part of the rows each: out of fold for the rows a
    fit learns from, and in full for the part it leaves out."""

    columns: tuple[str, ...]
    learned: DataFrame        # feature, category, fold, encoding: an array with a value per fit
    held: DataFrame           # feature, category, fold (the fit), encoding
    priors: dict[int, float]

    def apply_learned(self, df: DataFrame, fold: str) -> DataFrame:
        """Arrays with a value per fit; NULL within them where the fit leaves the row out."""
        return _look_up(df, self.learned, self.columns, fold)

    def apply_held(self, df: DataFrame, part: str) -> DataFrame:
        """Every row as the fit that leaves its ``part`` out encodes it."""
        prior = F.try_element_at(F.create_map(*[F.lit(v) for pair in self.priors.items() for v in pair]), F.col(part))
        encoded = _look_up(df, self.held, self.columns, part)
        return encoded.withColumns({
            encoded_name(name): F.coalesce(F.col(encoded_name(name)), prior) for name in self.columns})

    def of(self, fit: int) -> TargetEncoding:
        return TargetEncoding(self.columns, self.held.where(F.col("fold") == fit).drop("fold"), self.priors[fit])


def fit_encodings(df: DataFrame, columns: Sequence[str], label: str, *, fold: str, part: str,
                  tests: Sequence[int]) -> FitEncodings:
    """The encodings of a fit for each value of ``part`` in ``tests``, from the same two passes."""
    sums = category_sums(df, columns, label, F.col(fold), part=F.col(part), tests=tests)
    apart, _ = fold_encodings(sums)
    learned = apart.groupBy("feature", "category", "fold").agg(F.array(*[
        F.max(F.when(F.col("fit") == test, F.col("encoding"))) for test in tests]).alias("encoding"))
    held, priors = full_encodings(sums)
    return FitEncodings(
        tuple(columns), materialize(learned, "fold-encodings", partition_by=["feature"]),
        materialize(held.withColumnRenamed("fit", "fold"), "encodings", partition_by=["feature"]), priors)
