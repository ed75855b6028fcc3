"""The layers end to end: documents to Silver, Silver to Gold, all on one layout."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from marquee import config
from marquee.operators import gold, silver
from marquee.session import materialized
from marquee.sources.documents import framed, read_layer
from marquee.sources.layout import SILVER_TABLES, Layout
from marquee.sources.sinks import overwrite_table
from marquee.sources.tables import read_silver, row_count


def build_silver(spark: SparkSession, layout: Layout, *, raw: DataFrame | None = None,
                 start_year: int = config.START_YEAR, as_of: dt.date | None = None,
                 language: str = config.LANGUAGE, top_n: int = config.CAST_TOP_N,
                 jobs: Sequence[str] = config.CREW_JOBS) -> dict[str, int]:
    """Rebuild the three Silver tables and return their row counts.

    Documents in scope are parsed once into a staged table which feeds all three
    outputs, so an executor lost between them costs no second parse. ``raw`` may be
    any frame with a ``body`` column, such as the landed table of a stream; by
    default the document folder of the layout is read, in either of its layouts.
    """
    documents = read_layer(spark, layout.documents, parsed="_json") if raw is None else framed(raw, parsed="_json")
    scoped = silver.silver_scope(silver.parse_documents(documents, parsed="_json"), start_year=start_year,
                                 as_of=as_of, language=language)
    with materialized(scoped, "documents") as staged:
        for name, table in silver.silver_tables(staged, top_n=top_n, jobs=jobs).items():
            overwrite_table(table, layout.silver(name))
    return {name: row_count(spark, layout.silver(name)) or 0 for name in SILVER_TABLES}


def build_gold(spark: SparkSession, layout: Layout, *,
               min_budget: float = config.MIN_BUDGET) -> dict[str, int]:
    """Rebuild Gold from Silver and return input, output and dropped row counts."""
    movies, cast, crew = [
        read_silver(spark, layout.silver(name), name, required=True) for name in SILVER_TABLES]
    overwrite_table(gold.build_gold(movies, cast, crew, min_budget=min_budget), layout.gold)
    before, after = row_count(spark, layout.silver("movies")) or 0, row_count(spark, layout.gold) or 0
    return {"silver_movies": before, "gold_movies": after, "dropped": before - after}
