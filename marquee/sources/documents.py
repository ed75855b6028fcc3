"""Raw JSON documents: gzip text in, gzip text out."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from marquee.functions import bound, id_prefix, json_with_mark, marked_document
from marquee.session import few_listing_tasks

_BLANK = re.compile(r"[ \t\n\r]*")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
RAW_SCHEMA = "source string, body string"
#: Compressed bytes above which a ``.json.gz`` file is read by lines instead of as one text.
LARGE_FILE = 1 << 20


def read_documents(spark: SparkSession, uri: str, *, pattern: str = "*.json.gz",
                   one_per_file: bool = True, size: str | None = None) -> DataFrame:
    """All documents below ``uri`` as (source, body), with the bytes of the file if ``size`` names a column.

    Unreadable files are skipped; a missing folder is an empty frame. Compacted folders
    (many one-line documents per file) are read with ``one_per_file=False``: prefer them
    at scale, since one file per entity makes the listing dominate the job.
    """
    try:
        with few_listing_tasks(spark):
            lines = (
                spark.read
                .option("recursiveFileLookup", "true")
                .option("pathGlobFilter", pattern)
                .option("ignoreCorruptFiles", "true")
                .text(uri, wholetext=one_per_file)
            )
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], RAW_SCHEMA + (f", {size} bigint" if size else ""))
        raise
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"),
                        *([F.col("_metadata.file_size").alias(size)] if size else []))


def split_values(text: str) -> list[str]:
    """The JSON values that a text consists of, each written anew; the text itself if it isn't JSON.

    Of repeated keys the last one counts. NaN and infinities, which JSON has no word for,
    become strings, and a number read from those is what they name.
    """
    def number(digits: str) -> float | str:
        value = float(digits)
        return value if math.isfinite(value) else str(value)

    decoder = json.JSONDecoder(parse_constant=str, parse_float=number)
    values, at = [], _BLANK.match(text).end()
    try:
        while at < len(text):
            value, at = decoder.raw_decode(text, at)
            values.append(json.dumps(value))
            at = _BLANK.match(text, at).end()
    except (ValueError, RecursionError):
        return [text]
    return values or [text]


def framed(raw: DataFrame, body: str = "body", *, parsed: str | None = None) -> DataFrame:
    """One row per JSON value, for bodies that may hold several, in lines or not.

    A body that is exactly one value, as nearly all are, is passed on untouched by the JVM;
    only others go through :func:`split_values`. What isn't JSON stays as it is, and is
    rejected with a reason where documents are judged. Works on streams, too. ``parsed`` names a
    column for the value as VARIANT, NULL if the text isn't JSON, so that nobody parses it again.
    """
    def split(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else split_values(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    column = F.col(body)
    marked = raw.select(*raw.columns, bound(json_with_mark(column)).alias("_marked"))
    whole = marked.select(*raw.columns, bound(marked_document(F.col("_marked"), column)).alias("_whole"))
    odd = F.col("_whole").isNull()
    several = whole.withColumn("_values", F.arrow_udf(split, "array<string>")(F.when(odd, column)))
    others = [F.col(name) for name in raw.columns if name != body]
    values = several.select(*others, "_whole", F.explode(F.coalesce("_values", F.array(column))).alias(body))
    if parsed is None:
        return values.select(*raw.columns)
    again = values.select("*", bound(F.when(odd, json_with_mark(column))).alias("_again"))
    return again.select(*raw.columns, F.coalesce("_whole", marked_document(F.col("_again"), column)).alias(parsed))


def whole_texts(lines: Iterable[str]) -> Iterator[str]:
    """The lines of a file, put together until all brackets are closed.

    No JSON value spans two of the texts, and blank lines between values are left out. A fault
    that no further line can mend ends a text: a quote left open, or a value that begins where
    the former line has neither a comma, a colon nor an open bracket for it. So a broken value
    costs itself, and no more of the file is held than one value.
    """
    held, depth, end = [], 0, ""
    for line in lines:
        bare = _STRING.sub("0", line)
        start = bare.strip()
        if not start and not held:
            continue
        if held and start and start[0] not in ",:]}" and end not in ",:[{":
            yield "\n".join(held)
            held, depth = [], 0
        held.append(line)
        end = start[-1:] or end
        depth += bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]")
        if depth <= 0 or '"' in bare:
            yield "\n".join(held)
            held, depth = [], 0
    if held:
        yield "\n".join(held)


def joined_lines(lines: DataFrame) -> DataFrame:
    """(source, body) of :func:`whole_texts`, from the lines of files that are each read by one task."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((source, line) for batch in batches
                for source, line in zip(batch["source"].to_pylist(), batch["body"].to_pylist()))
        texts = ((source, text) for source, own in groupby(rows, itemgetter(0))
                 for text in whole_texts(line for _, line in own))
        while some := list(islice(texts, 1_000)):
            yield pa.RecordBatch.from_arrays([pa.array(column, pa.string()) for column in zip(*some)], ["source", "body"])

    return lines.select("source", "body").mapInArrow(join, RAW_SCHEMA)


def read_layer(spark: SparkSession, uri: str, *, parsed: str | None = None) -> DataFrame:
    """All documents of a folder that may hold both layouts: ``.json.gz`` files of one or
    several documents, and the line files (``.txt.gz``) that :func:`write_documents` makes.

    A ``.json.gz`` file of up to ``LARGE_FILE`` bytes is one text, which is unusable as a whole
    if it holds a fault. Larger ones never stand in memory whole: they are read as streams of
    lines, and a fault costs the value it is in, as in line files. ``parsed`` is passed on to
    :func:`framed`.

    The folder is listed once for all files read by lines, and again only if it holds
    ``.json.gz`` files, the small ones of which are read whole.
    """
    lines = read_documents(spark, uri, pattern="*.{json,txt}.gz", one_per_file=False, size="_size")
    is_json, large = F.col("source").endswith(".json.gz"), F.col("_size") > LARGE_FILE
    texts = lines.where(~is_json).drop("_size")
    # Files are chosen by name before any is opened: no partition means no such file.
    if lines.where(is_json).rdd.getNumPartitions():
        texts = (
            read_documents(spark, uri, size="_size").where(~large).drop("_size")
            .unionByName(joined_lines(lines.where(is_json & large))).unionByName(texts))
    return framed(texts, parsed=parsed)


def write_documents(docs: DataFrame, uri: str, *, id_column: str = "id",
                    body_column: str = "body", mode: str = "overwrite") -> None:
    """Write one JSON line per document into ``id_prefix=NNN`` folders, gzip-compressed.

    REBALANCE gathers each prefix into few files but lets AQE split a prefix that
    is much larger than the others, so no single task owns it.
    """
    (
        docs.select(id_prefix(F.col(id_column)).alias("id_prefix"),
                    F.col(body_column).alias("value"))
        .hint("rebalance", "id_prefix")
        .write.mode(mode).partitionBy("id_prefix")
        .option("compression", "gzip").format("text")
        .save(uri)
    )


def compact_documents(spark: SparkSession, source_uri: str, target_uri: str) -> None:
    """Turn a one-file-per-document folder into few large line-delimited files."""
    parsed = F.try_parse_json("body")
    docs = framed(read_documents(spark, source_uri)).select(
        F.try_variant_get(parsed, "$.id", "bigint").alias("id"),
        F.to_json(parsed).alias("body"),
    )
    write_documents(docs.where(F.col("id").isNotNull()), target_uri)
