"""Column expressions. All of them compile to JVM built-ins; there is no Python UDF."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, functions as F

from marquee import config

__all__ = [
    "bound", "iso_date", "json_with_mark", "marked_document", "variant_text", "variant_truth", "money_musd", "return_on_investment", "roi_bucket",
    "id_prefix", "month_label", "known_or_unknown", "month_angle", "multi_hot",
    "contains_text", "case_folded", "contains_folded", "overlaps_any", "size_mb", "clipped_log_weight", "hash_fraction",
    "hash_bucket", "implied_roi", "post_processed",
]


def bound(value: Column) -> Column:
    """``value`` from a one-element generator, which computes it once per row.

    A plain projection would be computed again in every filter that the optimizer moves below it,
    and in every column that uses it.
    """
    return F.explode_outer(F.array(value))


# --- loosely typed JSON ------------------------------------------------------

def json_with_mark(body: Column) -> Column:
    """The text parsed as the first of two entries of a list, the second being its own checksum.

    The parser stops at the end of a value and says nothing of what follows. Here the list
    only closes behind the checksum, which a text can't hold itself, so any further text
    breaks the list or moves the checksum. NULL if the list is broken.
    """
    text = F.concat(F.lit("["), body, F.lit(',"'), F.md5(body.cast("binary")), F.lit('"]'))
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def marked_document(marked: Column, body: Column) -> Column:
    """The document of :func:`json_with_mark`, NULL unless the text is exactly one JSON value."""
    mark = F.try_variant_get(F.get(marked, F.lit(1)), "$", "string")
    whole = (F.size(marked) == 2) & (mark == F.md5(body.cast("binary")))
    return F.when(whole, F.get(marked, F.lit(0)))


def variant_text(value: Column) -> Column:
    """A VARIANT that is a string; any other kind counts as missing."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def variant_truth(value: Column) -> Column:
    """Truthiness: absent, null, 0, "" and false are False; everything else is True."""
    kind = F.schema_of_variant(value)
    return F.coalesce(
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "VOID", F.lit(False))
        .when(kind.isNotNull(), F.coalesce(F.try_variant_get(value, "$", "double") != 0,
                                           F.lit(True))),
        F.lit(False),
    )


# --- dates -------------------------------------------------------------------

def iso_date(text: Column) -> Column:
    """ISO calendar dates (2005-06-15, 20050615) and week dates (2005-W24-3); else NULL."""
    calendar = F.when(text.rlike(r"^(\d{8}|\d{4}-\d{2}-\d{2})$"),
                      F.try_to_date(F.replace(text, F.lit("-"), F.lit("")), "yyyyMMdd"))
    # Year, week and an optional day; separators are used everywhere or nowhere.
    digits = F.when(text.rlike(r"^\d{4}(-W\d{2}(-[1-7])?|W\d{2}[1-7]?)$"),
                    F.rpad(F.translate(text, "-W", ""), 7, "1"))
    year, week = F.substring(digits, 1, 4).cast("int"), F.substring(digits, 5, 2).cast("int")
    day = F.substring(digits, 7, 1).cast("int")
    last_week = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    first_monday = F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week")
    from_week = F.when(week.between(1, last_week), F.date_add(first_monday, week * 7 + day - 8))
    return F.coalesce(calendar, from_week)


def month_label(month: Column) -> Column:
    """Jan..Dec for 1..12, NULL for anything else."""
    return F.get(F.array(*[F.lit(label) for label in config.MONTHS]), month - 1)


# --- money and buckets ---------------------------------------------------------

def money_musd(amount: Column) -> Column:
    return amount / F.lit(1_000_000)


def return_on_investment(budget: Column, revenue: Column) -> Column:
    """(revenue - budget) / budget; NULL for a zero budget."""
    return F.try_divide(revenue - budget, budget)


def roi_bucket(roi: Column, hit: float = config.HIT_ROI, flop: float = config.FLOP_ROI) -> Column:
    """Flop at or below ``flop``, Hit at or above ``hit``, Average otherwise (also for NULL)."""
    return F.when(roi <= flop, "Flop").when(roi >= hit, "Hit").otherwise("Average")


def implied_roi(predicted: Column, budget: Column) -> Column:
    return F.when(budget > 0, (predicted - budget) / budget).otherwise(F.lit(0.0))


def id_prefix(entity_id: Column, width: int = config.ID_BUCKET_WIDTH) -> Column:
    """Folder key of an id: its integer quotient, zero-padded to at least three digits."""
    number = entity_id.cast("bigint")
    # Whole-number division: a double would lose ids above 2^53.
    whole = F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))
    return F.format_string("%03d", whole)


def size_mb(size_in_bytes: Column) -> Column:
    return F.round(size_in_bytes / F.lit(1_000_000), 3)


# --- text and list predicates -----------------------------------------------

def contains_text(column: Column, needle: str) -> Column:
    """Case-insensitive literal substring; NULL text behaves as empty."""
    return F.lower(F.coalesce(column, F.lit(""))).contains(needle.lower())


@cache
def _further_folds() -> dict[str, str]:
    """Lower-case letters that case folding changes further, such as ß to ss; by rule, about 190."""
    letters = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000)))
    return {c: c.casefold() for c in letters if c.lower() == c and c.casefold() != c}


def case_folded(text: Column) -> Column:
    """Text for comparison without case: lower-cased, and what Unicode folds further folded too.

    Texts with none of those letters, nearly all, are lower-cased only.
    """
    folds = _further_folds()
    lower = F.lower(text)
    table = F.create_map(*(F.lit(x) for pair in folds.items() for x in pair))
    letters = F.transform(F.split(lower, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(lower.rlike(f"[{''.join(folds)}]"), F.array_join(letters, "")).otherwise(lower)


def contains_folded(column: Column, needle: str) -> Column:
    """Literal substring by full case folding; NULL text behaves as empty."""
    return case_folded(F.coalesce(column, F.lit(""))).contains(needle.casefold())


def overlaps_any(values: Column, wanted: list[str] | tuple[str, ...]) -> Column:
    """True when the list shares an element with ``wanted``. No selection means no filter."""
    if not wanted:
        return F.lit(True)
    return F.coalesce(F.exists(values, lambda value: value.isin(list(wanted))), F.lit(False))


# --- features ------------------------------------------------------------------

def known_or_unknown(column: Column) -> Column:
    return F.when(column.isNull() | (column == ""), config.UNKNOWN).otherwise(column)


def month_angle(month: Column) -> Column:
    """Angle of a month on the year circle; January (and a missing month) is 0."""
    position = F.coalesce(month.cast("double"), F.lit(1.0)) - 1
    return position * 2 * F.pi() / 12


def multi_hot(values: Column, element: str) -> Column:
    return F.coalesce(F.array_contains(values, element), F.lit(False)).cast("int")


def clipped_log_weight(votes: Column) -> Column:
    return F.log1p(F.greatest(votes.cast("double"), F.lit(0.0)))


def post_processed(raw: Column, target: str, transform: str) -> Column:
    """Model output back on the scale users see, kept inside the target's range."""
    if transform == "log1p":
        return F.greatest(F.expm1(raw), F.lit(0.0))
    if target == "vote_average":
        return F.least(F.greatest(raw, F.lit(0.0)), F.lit(10.0))
    return raw


# --- reproducible assignment ---------------------------------------------------

def _hash32(key: Column, salt: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key: Column, buckets: int, salt: str) -> Column:
    """Bucket in [0, buckets) that depends on the key alone, not on partitioning."""
    return _hash32(key, salt) % F.lit(buckets)


def hash_fraction(key: Column, salt: str) -> Column:
    """Uniform number in [0, 1) that depends on the key alone."""
    return _hash32(key, salt) / F.lit(4294967296.0)
