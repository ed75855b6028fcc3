"""Why is a row here, or not here: rules, layer traces, inventory, freshness."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee import config
from marquee.functions import contains_folded, size_mb
from marquee.sources.documents import read_layer
from marquee.sources import listing
from marquee.sources.layout import SILVER_TABLES, Layout
from marquee.sources.tables import row_count


# --- drop reasons --------------------------------------------------------------

def _said(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("missing"))


def silver_rules(*, start_year: int = config.START_YEAR, as_of: dt.date | None = None,
                 language: str = config.LANGUAGE) -> list[tuple[Column, Column]]:
    """(violated?, message) per Silver rule."""
    released = F.col("release_date")
    first_day = F.lit(dt.date(start_year, 1, 1))
    last_day = F.current_date() if as_of is None else F.lit(as_of)
    spoken = F.col("original_language")
    return [
        (~spoken.eqNullSafe(F.lit(language)),
         F.concat(F.lit("language is "), _said(spoken), F.lit(f", not {language}"))),
        (F.coalesce("adult", F.lit(True)),
         F.when(F.col("adult").isNull(), "adult flag missing").otherwise("adult content")),
        (released.isNull(), F.lit("release date missing or unreadable")),
        (released < first_day, F.concat(F.lit("released "), _said(released), F.lit(", before "),
                                        _said(first_day))),
        (released > last_day, F.concat(F.lit("released "), _said(released), F.lit(", after "),
                                       _said(last_day))),
    ]


def gold_rules(*, min_budget: float = config.MIN_BUDGET) -> list[tuple[Column, Column]]:
    """(violated?, message) per Gold rule; a missing amount fails, as in the Gold build."""
    return [
        (~F.coalesce(F.col("budget") >= min_budget, F.lit(False)), F.lit(f"budget below {min_budget}")),
        (~F.coalesce(F.col("revenue") > 0, F.lit(False)), F.lit("no revenue")),
    ]


def broken_rules(rules: list[tuple[Column, Column]]) -> Column:
    """Messages of all violated rules of a row, in rule order; empty if it passes."""
    return F.array_compact(F.array(*[F.when(violated, message) for violated, message in rules]))


def drop_reasons(movies: DataFrame, *, start_year: int = config.START_YEAR,
                 as_of: dt.date | None = None, language: str = config.LANGUAGE,
                 min_budget: float = config.MIN_BUDGET) -> DataFrame:
    """Add the lists ``silver_reasons`` and ``gold_reasons`` to unfiltered movie rows."""
    return movies.withColumns({
        "silver_reasons": broken_rules(
            silver_rules(start_year=start_year, as_of=as_of, language=language)),
        "gold_reasons": broken_rules(gold_rules(min_budget=min_budget)),
    })


#: What each rule of :func:`silver_rules` and :func:`gold_rules` is called, in their order.
RULE_CODES = {"silver": ("language", "adult", "no date", "too early", "too late"), "gold": ("budget", "revenue")}


def rule_mask(rules: list[tuple[Column, Column]]) -> Column:
    """A bit per rule, set where the row breaks it."""
    return sum((F.when(violated, 1 << bit).otherwise(0) for bit, (violated, _) in enumerate(rules)), F.lit(0))


def rule_counts(movies: DataFrame, *, start_year: int = config.START_YEAR, as_of: dt.date | None = None,
                language: str = config.LANGUAGE, min_budget: float = config.MIN_BUDGET) -> DataFrame:
    """(layer, rule, n, alone): rows that break each rule, and those that break no other of its layer.

    One aggregate over a bit mask per layer: as many rows as rules at any size, zeros included,
    and nothing but those sums is shuffled.
    """
    rules = {"silver": silver_rules(start_year=start_year, as_of=as_of, language=language),
             "gold": gold_rules(min_budget=min_budget)}
    masks = movies.select(*(rule_mask(own).alias(layer) for layer, own in rules.items()))
    sums = masks.agg(*(
        column for layer, names in RULE_CODES.items() for bit in range(len(names)) for column in (
            F.count_if(F.col(layer).bitwiseAND(1 << bit) != 0).alias(f"{layer}-{bit}-n"),
            F.count_if(F.col(layer) == 1 << bit).alias(f"{layer}-{bit}-alone"))))
    return sums.select(F.inline(F.array(*(
        F.struct(F.lit(layer).alias("layer"), F.lit(name).alias("rule"),
                 F.col(f"{layer}-{bit}-n").alias("n"), F.col(f"{layer}-{bit}-alone").alias("alone"))
        for layer, names in RULE_CODES.items() for bit, name in enumerate(names)))))


def reason_histogram(reasoned: DataFrame) -> DataFrame:
    """How many rows each rule rejects, per layer."""
    tagged = [
        reasoned.select(F.lit(layer).alias("layer"), F.explode(column).alias("reason"))
        for layer, column in (("silver", "silver_reasons"), ("gold", "gold_reasons"))
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("layer", "reason").agg(F.count(F.lit(1)).alias("n"))
        .orderBy("layer", F.desc("n"), "reason")
    )


# --- tracing ids through the layers ---------------------------------------------

def trace_layers(bronze: DataFrame, silver: DataFrame, gold: DataFrame, *,
                 start_year: int = config.START_YEAR, as_of: dt.date | None = None,
                 language: str = config.LANGUAGE,
                 min_budget: float = config.MIN_BUDGET) -> DataFrame:
    """Per id: how often each layer holds it, whether it should, and what does not fit.

    ``bronze`` are parsed documents, ``silver`` the movies table, ``gold`` the Gold
    table. The three are stacked and grouped once, instead of two full outer joins on
    the same key: one shuffle, combined map-side, and repeated ids collapse early. The
    amounts come from Silver where it has the row, from the document otherwise.
    """
    judged = drop_reasons(bronze, start_year=start_year, as_of=as_of, language=language,
                          min_budget=min_budget)
    from_bronze = judged.select(
        "id", F.lit("bronze").alias("layer"), "budget", "revenue",
        F.array_join("silver_reasons", "; ").alias("why_not_silver"))
    from_silver = silver.select("id", F.lit("silver").alias("layer"), "budget", "revenue")
    from_gold = gold.select(F.col("movie_id").alias("id"), F.lit("gold").alias("layer"))
    stacked = (
        from_bronze.unionByName(from_silver, allowMissingColumns=True)
        .unionByName(from_gold, allowMissingColumns=True)
    )

    def held_by(layer: str) -> Column:
        return F.count_if(F.col("layer") == layer)

    def amount(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("layer") == "silver", F.col(name))),
                          F.max(F.when(F.col("layer") == "bronze", F.col(name))))

    per_id = stacked.groupBy("id").agg(
        held_by("bronze").alias("in_bronze"),
        held_by("silver").alias("in_silver"),
        held_by("gold").alias("in_gold"),
        amount("budget").alias("budget"),
        amount("revenue").alias("revenue"),
        F.max("why_not_silver").alias("why_not_silver"),
    )
    keeps_silver = (F.when(F.col("in_bronze") == 0, "unknown")
                    .when(F.col("why_not_silver") == "", "keep").otherwise("drop"))
    unseen = (F.col("in_bronze") == 0) & (F.col("in_silver") == 0)
    why_not_gold = F.when(unseen, "").otherwise(
        F.array_join(broken_rules(gold_rules(min_budget=min_budget)), "; "))
    keeps_gold = (F.when(unseen, "unknown")
                  .when(why_not_gold == "", "keep").otherwise("drop"))
    note = (
        F.when((F.col("in_bronze") > 1) | (F.col("in_silver") > 1) | (F.col("in_gold") > 1),
               "held more than once")
        .when((F.col("in_gold") > 0) & (F.col("in_silver") == 0), "in Gold but not in Silver")
        .when((F.col("in_silver") > 0) & (F.col("in_gold") == 0) & (why_not_gold == ""),
              "missing from Gold without a reason")
        .when((F.col("in_silver") == 0) & (keeps_silver == "keep"),
              "missing from Silver without a reason")
        .when((F.col("in_silver") > 0) & (keeps_silver == "drop"), "in Silver against the rules")
        .when((F.col("in_gold") > 0) & (keeps_gold == "drop"), "in Gold against the rules")
        .when(F.col("in_bronze") == 0, "missing from Bronze")
        .otherwise("consistent")
    )
    return per_id.select(
        "id", "in_bronze", "in_silver", "in_gold",
        keeps_silver.alias("silver_expected"),
        F.coalesce("why_not_silver", F.lit("")).alias("why_not_silver"),
        keeps_gold.alias("gold_expected"), why_not_gold.alias("why_not_gold"),
        note.alias("note"),
    )


def point_lookup(df: DataFrame, key: str, value: int) -> DataFrame:
    """Rows with one id; the comparison reaches the Parquet row-group statistics."""
    return df.where(F.col(key) == value)


def title_search(docs: DataFrame, needle: str, *, limit: int | None = None) -> DataFrame:
    """Rows whose title or original title contains ``needle``, by full case folding, by id."""
    found = docs.where(contains_folded(F.col("title"), needle)
                       | contains_folded(F.col("original_title"), needle)).orderBy("id")
    return found if limit is None else found.limit(limit)


def resolve_title(docs: DataFrame, needle: str) -> int:
    """The only id matching a title; none or several are errors that name the matches."""
    ids = [row.id for row in title_search(docs, needle, limit=config.MAX_ERRORS).select("id").collect()]
    if not ids:
        raise LookupError(f"no title contains {needle!r}")
    if len(ids) > 1:
        raise LookupError(f"{needle!r} matches several ids, at least {ids}")
    return ids[0]


# --- inventory and freshness ------------------------------------------------------

def layer_inventory(spark: SparkSession, layout: Layout) -> DataFrame:
    """Six rows, one per layer: path, files, size, rows and last change.

    Bronze rows are documents, however many a file holds; discover pages have no row count. Folders written by
    Spark also hold marker files, so only data files are counted.
    """
    places = [(config.LAYERS[0], layout.discover, "*.json.gz"),
              (config.LAYERS[1], layout.documents, "*.gz")]
    places += [(label, layout.silver(table), "*.parquet")
               for label, table in zip(config.LAYERS[2:5], SILVER_TABLES)]
    places.append((config.LAYERS[5], layout.gold, "*.parquet"))

    parts = []
    for position, (label, uri, pattern) in enumerate(places):
        stats = listing.file_stats(listing.list_files(spark, uri, pattern))
        if label == config.LAYERS[0]:
            rows = F.lit(None).cast("bigint")
        elif label == config.LAYERS[1]:
            rows = F.lit(read_layer(spark, uri).count()).cast("bigint")
        else:
            rows = F.lit(row_count(spark, uri)).cast("bigint")
        parts.append(stats.select(
            F.lit(position).alias("position"), F.lit(label).alias("layer"),
            F.lit(uri).alias("path"), "files", size_mb(F.col("bytes")).alias("size_mb"),
            rows.alias("rows"), "last_updated"))
    return reduce(DataFrame.unionByName, parts).orderBy("position").drop("position")


def table_snapshot(spark: SparkSession, uri: str, taken_at: dt.datetime) -> DataFrame:
    """One row (taken_at, path, stamp, rows) to append to a table of snapshots."""
    stamp = listing.fingerprint(listing.list_files(spark, uri))
    return stamp.select(F.lit(taken_at).alias("taken_at"), F.lit(uri).alias("path"), "stamp",
                        F.lit(row_count(spark, uri)).cast("bigint").alias("rows"))


def snapshot_changes(before: DataFrame, after: DataFrame, *, key: str = "path") -> DataFrame:
    """Compare two snapshots path by path: changed if the stamp or the row count differs."""
    sides = (
        before.select(key, F.lit(0).alias("_side"), "stamp", "rows")
        .unionByName(after.select(key, F.lit(1).alias("_side"), "stamp", "rows"))
    )

    def of(side: int, name: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(name)))

    both = sides.groupBy(key).agg(
        of(0, "stamp").alias("stamp_before"), of(1, "stamp").alias("stamp_after"),
        of(0, "rows").alias("rows_before"), of(1, "rows").alias("rows_after"),
    )
    changed = (~F.col("stamp_before").eqNullSafe(F.col("stamp_after"))
               | ~F.col("rows_before").eqNullSafe(F.col("rows_after")))
    return both.select(key, "rows_before", "rows_after", changed.alias("changed"))


def scope_constraints(spark: SparkSession, *, start_year: int = config.START_YEAR,
                      min_budget: int = config.MIN_BUDGET, min_votes: int = config.MIN_VOTES,
                      sample_cap: int = config.SAMPLE_CAP,
                      language: str = config.LANGUAGE) -> DataFrame:
    """The rules a row had to pass, as (rule, value)."""
    return spark.createDataFrame([
        ("Media type", "films only"),
        ("Language", f"original_language = {language}"),
        ("Adult content", "excluded"),
        ("Release window", f"{start_year} to the run date"),
        ("Release granularity", "month"),
        ("Gold budget floor", f"budget >= {min_budget:,}"),
        ("Gold revenue floor", "revenue > 0"),
        ("Candidate votes", f"vote_count >= {min_votes}"),
        ("Sample cap", f"{sample_cap:,}"),
    ], "rule string, value string")
