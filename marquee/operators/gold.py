"""Silver tables to the wide Gold table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee import config
from marquee.functions import money_musd, return_on_investment

_DIRECTOR_COLUMNS = {"director_id", "director_name"}
_LEAD_COLUMNS = {"lead_cast_id", "lead_cast_name"}


def first_person(order: Sequence[Column], person_id: Column, name: Column,
                 where: Column | None = None) -> Column:
    """Aggregate: the first person by ``order``, then id and name, of the rows ``where`` holds."""
    person = F.struct(F.struct(*order).alias("order"), person_id.alias("person_id"), name.alias("name"))
    return F.min(person if where is None else F.when(where, person))


def first_director(crew: DataFrame, *, job: str = config.DIRECTOR_JOB) -> DataFrame:
    """Per movie the crew member with ``job`` that the document names first."""
    return (
        crew.where(F.col("job") == job)
        .groupBy("movie_id")
        .agg(first_person([F.col("pos")], F.col("person_id"), F.col("name")).alias("who"))
        .select("movie_id", F.col("who.person_id").alias("director_id"),
                F.col("who.name").alias("director_name"))
    )


def lead_cast(cast: DataFrame) -> DataFrame:
    """Per movie the cast member with the lowest billing order."""
    return (
        cast.groupBy("movie_id")
        .agg(first_person([F.col("order"), F.col("pos")], F.col("person_id"), F.col("name")).alias("who"))
        .select("movie_id", F.col("who.person_id").alias("lead_cast_id"),
                F.col("who.name").alias("lead_cast_name"))
    )


def gold_scope(movies: DataFrame, *, min_budget: float = config.MIN_BUDGET) -> DataFrame:
    """Rows with a budget at or above the floor and some revenue."""
    return movies.where((F.col("budget") >= min_budget) & (F.col("revenue") > 0))


def build_gold(movies: DataFrame, cast: DataFrame | Callable[[], DataFrame],
               crew: DataFrame | Callable[[], DataFrame], *,
               min_budget: float = config.MIN_BUDGET, director_job: str = config.DIRECTOR_JOB,
               columns: Sequence[str] = config.GOLD_COLUMNS) -> DataFrame:
    """One row per movie in scope, with money columns, director and lead.

    The scope filter runs before the joins, people are reduced to one row per movie
    before they are joined, and all three inputs meet on ``movie_id``, so each is
    shuffled once. Asking for fewer ``columns`` leaves out the joins they do not need;
    ``cast`` and ``crew`` may be functions, which are then not even called. Movies that carry
    their director, lead or lead company already need no join for them either.
    """
    wanted = set(columns) - set(movies.columns)
    gold = gold_scope(movies, min_budget=min_budget).withColumnRenamed("id", "movie_id")
    if wanted & _DIRECTOR_COLUMNS:
        people = crew() if callable(crew) else crew
        gold = gold.join(first_director(people, job=director_job), "movie_id", "left")
    if wanted & _LEAD_COLUMNS:
        people = cast() if callable(cast) else cast
        gold = gold.join(lead_cast(people), "movie_id", "left")
    computed = {
        "budget_musd": money_musd(F.col("budget")),
        "revenue_musd": money_musd(F.col("revenue")),
        "roi": return_on_investment(F.col("budget"), F.col("revenue")),
        "lead_production_company": F.get("production_companies", F.lit(0)),
    }
    return gold.withColumns({name: value for name, value in computed.items()
                             if name not in movies.columns}).select(*columns)


def build_counts(movies: DataFrame, *, min_budget: float = config.MIN_BUDGET) -> DataFrame:
    """Input, kept and dropped rows of the Gold build, without running its joins.

    The joins are one-to-one on the movie side, so the scope filter alone decides.
    """
    kept = F.coalesce(
        F.count_if((F.col("budget") >= min_budget) & (F.col("revenue") > 0)), F.lit(0))
    everything = F.count(F.lit(1))
    return movies.agg(everything.alias("silver_movies"), kept.alias("gold_movies"),
                      (everything - kept).alias("dropped"))
