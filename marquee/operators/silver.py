"""Documents to typed Silver tables.

Documents are parsed into a VARIANT and cast to one declared shape. That cast is
tolerant leaf by leaf: a value of the wrong kind is a missing value, an entry of the
wrong kind is a missing entry, and one odd field never costs the whole document. Only a
document without a whole-number ``id`` is rejected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marquee import config
from marquee.functions import bound, iso_date, json_with_mark, marked_document, variant_text, variant_truth

# Fields whose kind matters stay VARIANT and are judged one by one. What the scope asks for comes
# first, so that the rest is taken only from documents that stay.
SCOPE_SHAPE = "struct<id: variant, release_date: variant, original_language: string, adult: variant>"
DOCUMENT_SHAPE = (
    "struct<title: string, original_title: string, "
    "budget: bigint, revenue: bigint, runtime: int, vote_average: double, vote_count: bigint, "
    "popularity: double, "
    "genres: array<struct<name: string>>, production_companies: array<struct<name: string>>, "
    "credits: struct<"
    "`cast`: array<struct<`order`: int, id: bigint, name: string, `character`: string>>, "
    "crew: array<struct<job: string, id: bigint, name: string>>>>"
)


def parse_documents(raw: DataFrame, body: str = "body", *, parsed: str | None = None) -> DataFrame:
    """Typed rows for every document whose ``id`` is a whole number.

    A body is exactly one JSON value; see ``sources.documents.framed`` for texts that aren't, and
    for the ``parsed`` column that spares parsing the body here.

    ``cast`` and ``crew`` stay nested in document order; an entry that is not an object is
    NULL there and skipped when the lists are unpacked.
    """
    if parsed is None:
        marked = raw.select(F.col(body).alias("_body"), bound(json_with_mark(F.col(body))).alias("_marked"))
        values = marked.select(bound(marked_document(F.col("_marked"), F.col("_body"))).alias("_json"))
    else:
        values = raw.select(F.col(parsed).alias("_json"))
    heads = values.select("_json", bound(F.try_variant_get("_json", "$", SCOPE_SHAPE)).alias("_head"))
    heads = heads.where(F.schema_of_variant("_head.id") == "BIGINT")
    texts = heads.select("_json", "_head", bound(variant_text(F.col("_head.release_date"))).alias("_text"))
    dated = texts.select("_json", "_head", bound(iso_date(F.col("_text"))).alias("_released"))
    docs = dated.select("_head", "_released", bound(F.try_variant_get("_json", "$", DOCUMENT_SHAPE)).alias("_doc"))

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"_doc.{name}"), F.lit(0)).alias(name)

    released = F.col("_released")
    return docs.select(
        F.try_variant_get("_head.id", "$", "bigint").alias("id"),
        "_doc.title",
        "_doc.original_title",
        released.alias("release_date"),
        F.year(released).alias("release_year"),
        F.month(released).alias("release_month"),
        number("budget"),
        number("revenue"),
        "_doc.runtime",
        number("vote_average"),
        number("vote_count"),
        number("popularity"),
        "_head.original_language",
        variant_truth(F.col("_head.adult")).alias("adult"),
        _names("genres"),
        _names("production_companies"),
        "_doc.credits.cast",
        "_doc.credits.crew",
    )


def _names(field: str) -> Column:
    """The non-empty names of a list of objects; an absent list is an empty one."""
    named = F.filter(F.col(f"_doc.{field}.name"), lambda name: name != "")
    return F.coalesce(named, F.array()).alias(field)


def silver_scope(docs: DataFrame, *, start_year: int = config.START_YEAR,
                 as_of: dt.date | None = None, language: str = config.LANGUAGE) -> DataFrame:
    """Keep rows in the wanted language, not adult, released in [start_year, as_of].

    ``as_of`` defaults to the current date; pass it for repeatable results.
    """
    last_day = F.current_date() if as_of is None else F.lit(as_of)
    return docs.where(
        (F.col("original_language") == language)
        & ~F.col("adult")
        & F.col("release_date").between(F.lit(dt.date(start_year, 1, 1)), last_day)
    )


def silver_movies(docs: DataFrame) -> DataFrame:
    return docs.select(*config.MOVIE_COLUMNS)


def silver_cast(docs: DataFrame, *, top_n: int = config.CAST_TOP_N) -> DataFrame:
    """The ``top_n`` cast entries per document by billing order.

    Entries without an order come after all billed ones; ties keep document order. The
    choice is made inside each document's array, so nothing is shuffled. ``pos`` is the
    place in the document, so "first" is a value and not a matter of row order.
    """
    ranked = F.transform("cast", lambda entry, pos: F.when(entry.isNotNull(), F.struct(
        F.coalesce(entry["order"], F.lit(config.MISSING_ORDER)).alias("rank"),
        pos.alias("pos"),
        entry.alias("entry"),
    )))
    # NULL entries sort last and are not unpacked.
    chosen = F.slice(F.array_sort(ranked), 1, top_n)
    return (
        docs.select(F.col("id").alias("movie_id"), F.explode(chosen).alias("item"))
        .where(F.col("item").isNotNull())
        .select("movie_id", "item.pos", "item.entry.order",
                F.col("item.entry.id").alias("person_id"), "item.entry.name",
                "item.entry.character")
    )


def silver_crew(docs: DataFrame, *, jobs: Sequence[str] = config.CREW_JOBS) -> DataFrame:
    """Crew entries holding one of ``jobs``, with their place in the document."""
    return (
        docs.select(F.col("id").alias("movie_id"), F.posexplode("crew").alias("pos", "entry"))
        .where(F.col("entry.job").isin(list(jobs)))
        .select("movie_id", "pos", "entry.job", F.col("entry.id").alias("person_id"),
                "entry.name")
    )


def silver_tables(docs: DataFrame, *, top_n: int = config.CAST_TOP_N,
                  jobs: Sequence[str] = config.CREW_JOBS) -> dict[str, DataFrame]:
    """The three Silver tables of already scoped documents."""
    return {
        "movies": silver_movies(docs),
        "cast": silver_cast(docs, top_n=top_n),
        "crew": silver_crew(docs, jobs=jobs),
    }
