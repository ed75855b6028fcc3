"""Batch intake: which entities to fetch, which are already there, what a run did."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from marquee import config
from marquee.functions import json_with_mark, marked_document

MOST_IDS_TO_BROADCAST = 500_000   # eight bytes each, before hashing


def discover_scope(candidates: DataFrame, *, start_year: int = config.START_YEAR,
                   as_of: dt.date | None = None, min_votes: int = config.MIN_VOTES,
                   language: str = config.LANGUAGE) -> DataFrame:
    """Candidates worth fetching, most popular first."""
    last_day = F.current_date() if as_of is None else F.lit(as_of)
    return (
        candidates
        .where((F.col("original_language") == language) & ~F.col("adult"))
        .where(F.col("release_date").between(F.lit(dt.date(start_year, 1, 1)), last_day))
        .where(F.col("vote_count") >= min_votes)
        .orderBy(F.desc("popularity"), "id")
    )


def page_entries(pages: DataFrame, *, max_pages: int | None = None) -> DataFrame:
    """(id, page, pos) of every usable entry of the landed discover pages.

    ``max_pages`` leaves out later pages, such as those past the last one a catalogue serves.
    """
    served = pages if max_pages is None else pages.where(F.col("page") <= max_pages)
    return (
        served.select("page", F.posexplode("results").alias("pos", "entry"))
        .select(F.col("entry.id").alias("id"), "page", "pos")
        .where(F.col("id").isNotNull())
    )


def first_appearances(entries: DataFrame) -> DataFrame:
    """One row per id with the place where it was first listed.

    The minimum is combined before the shuffle, so an id listed millions of times
    costs one row per task.
    """
    return (
        entries.groupBy("id")
        .agg(F.min(F.struct("page", "pos")).alias("place"))
        .select("id", "place.page", "place.pos")
    )


def candidate_cap(entries: DataFrame, *, cap: int = config.SAMPLE_CAP) -> DataFrame:
    """The first ``cap`` distinct ids in listing order."""
    return first_appearances(entries).orderBy("page", "pos", "id").limit(cap)


def _known(candidates: DataFrame, landed: DataFrame, at_most: int | None) -> DataFrame:
    """Distinct landed ids, narrowed to the candidates where these are known to be few.

    A short candidate list is broadcast, so the landed table is scanned but not
    shuffled. Otherwise landed ids are made distinct before they meet the candidates:
    it uses the same partitioning as the join, so it adds no shuffle, and copies of an
    id collapse before they travel.
    """
    ids = landed.select("id")
    if at_most is not None and at_most <= MOST_IDS_TO_BROADCAST:
        ids = ids.join(F.broadcast(candidates.select("id")), "id", "left_semi")
    return ids.distinct()


def new_ids(candidates: DataFrame, landed: DataFrame, *, at_most: int | None = None) -> DataFrame:
    """Candidates that have not landed yet. ``at_most`` bounds the number of candidates,
    for instance the cap they were taken with."""
    return candidates.join(_known(candidates, landed, at_most), "id", "left_anti")


def known_ids(candidates: DataFrame, landed: DataFrame, *, at_most: int | None = None) -> DataFrame:
    """Candidates that have landed already."""
    return candidates.join(_known(candidates, landed, at_most), "id", "left_semi")


def outcomes(candidates: DataFrame, landed_before: DataFrame, results: DataFrame, *,
             at_most: int | None = None) -> DataFrame:
    """What happened to each candidate: skipped, fetched or failed.

    ``results`` holds (id, error) for the attempted ones; a NULL error is a success. A
    candidate that was neither there before nor attempted counts as failed.
    """
    before = _known(candidates, landed_before, at_most).withColumn("was_there", F.lit(True))
    attempted = results.groupBy("id").agg(
        F.min("error").alias("error"),
        F.max(F.col("error").isNull()).alias("succeeded"),
    )
    outcome = (
        F.when(F.col("was_there"), "skipped")
        .when(F.col("succeeded"), "fetched")
        .otherwise("failed")
    )
    message = F.concat(F.lit("id="), F.col("id").cast("string"), F.lit(": "),
                       F.coalesce("error", F.lit("no document arrived")))
    return (
        candidates.join(before, "id", "left").join(attempted, "id", "left")
        .withColumn("outcome", outcome)
        .withColumn("message", F.when(F.col("outcome") == "failed", message))
        .drop("was_there", "succeeded", "error")
    )


def outcome_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def discovered(done: DataFrame) -> DataFrame:
    """All ids of a run with the place where each was first listed, a table of any length."""
    return done.select("id", "page", "pos")


def run_manifest(done: DataFrame, *, run_timestamp: str, filters: dict[str, str],
                 target: int = config.SAMPLE_CAP, save_pages: bool = False,
                 max_errors: int = config.MAX_ERRORS) -> DataFrame:
    """One row describing a run.

    ``done`` comes from :func:`outcomes`. The id list is whole or, beyond ``target``
    candidates, NULL; :func:`discovered` has all ids as a table. The errors are cut to the
    first ``max_errors`` by a top-k sort before they are put into a list.
    """
    entry = F.struct("page", "pos", "id")
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda item: item["id"])

    def how_many(outcome: str):
        return F.coalesce(F.count_if(F.col("outcome") == outcome), F.lit(0)).alias(outcome)

    listed = done.select("page", "pos", "id").limit(target + 1)
    totals = done.agg(*[how_many(name) for name in ("fetched", "skipped", "failed")])
    whole = listed.agg(F.when(F.count(F.lit(1)) <= target, ids).alias("discovered_ids"))
    first_errors = (
        done.where(F.col("message").isNotNull()).orderBy("page", "pos", "id").limit(max_errors)
        .agg(F.transform(
            F.array_sort(F.collect_list(F.struct("page", "pos", "id", "message"))),
            lambda item: item["message"]).alias("errors"))
    )
    # Three one-row results laid over each other.
    parts = (
        totals.unionByName(whole, allowMissingColumns=True)
        .unionByName(first_errors, allowMissingColumns=True)
    )
    row = parts.agg(*[F.max(name).alias(name) for name in parts.columns])
    return row.select(
        F.lit(run_timestamp).alias("run_timestamp_utc"),
        F.create_map(*[F.lit(part) for pair in filters.items() for part in pair]).alias("filters")
        if filters else F.lit(None).cast("map<string,string>").alias("filters"),
        F.lit(target).alias("sample_counts_target"),
        "discovered_ids", "fetched", "skipped", "failed", "errors",
        F.lit(save_pages).alias("save_discover_pages"),
    )


def judged(raw: DataFrame, body: str = "body") -> DataFrame:
    """Add ``id`` and, for a document that cannot be used, the ``reason``.

    The generator binds the parsed document, so each body is parsed exactly once.
    """
    marked = raw.select(*raw.columns, F.explode_outer(F.array(json_with_mark(F.col(body)))).alias("_marked"))
    bound = marked.withColumn("_doc", marked_document(F.col("_marked"), F.col(body))).drop("_marked")
    kind = F.schema_of_variant(F.try_variant_get("_doc", "$.id", "variant"))
    reason = (
        F.when(F.col("_doc").isNull(), "not valid JSON")
        .when(kind.isNull() | (kind == "VOID"), "no id")
        .when(kind != "BIGINT", "id is not a whole number")
    )
    number = F.when(kind == "BIGINT", F.try_variant_get("_doc", "$.id", "bigint"))
    return bound.withColumns({"id": number, "reason": reason}).drop("_doc")


def split_readable(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Usable documents with their id, and the rest with the reason they are set aside."""
    rows = judged(raw, body)
    return (rows.where(F.col("reason").isNull()).drop("reason"),
            rows.where(F.col("reason").isNotNull()).drop("id"))
