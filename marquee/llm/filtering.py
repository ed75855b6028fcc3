"""Dropping rows of a table of documents by a decision per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import materialize

#: Keys of two numbers that are broadcast at most; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000


def if_small(narrow: DataFrame) -> DataFrame:
    """Marked for broadcast if a count shows few rows; else as it is."""
    return F.broadcast(narrow) if narrow.count() <= MOST_BROADCAST else narrow


def text_print() -> Column:
    """A fingerprint of ``text`` that, with doc_id, names a row."""
    return F.xxhash64(F.col("text").cast("string"))


def keep_chosen(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (doc_id, print) is in ``rows`` with ``keep`` false.

    ``rows`` has a row for each row of ``docs`` that a decision was taken on; others stay.
    Where some of several rows alike in (doc_id, print) are to be kept, one is. All columns
    are kept; the texts are shuffled only if very many rows go.
    """
    fates = rows.groupBy("doc_id", "print").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    fates = materialize(fates.where("not keep or n > 1"), "fates").withColumnRenamed("doc_id", "fate_id")
    name = "__print"
    while name in docs.columns:
        name += "_"
    named = docs.withColumn(name, text_print())

    def same(keys):
        return (F.col(name) == keys["print"]) & F.col("doc_id").cast("bigint").eqNullSafe(keys["fate_id"])

    keys = if_small(fates.select("fate_id", "print"))
    kept = named.join(keys, same(keys), "left_anti").select(*docs.columns)
    again = fates.where("keep").select("fate_id", "print")
    if again.isEmpty():
        return kept
    again = if_small(again)
    ones = (named.join(again, same(again), "left_semi").groupBy("doc_id", name)
            .agg(F.first(F.struct(*docs.columns)).alias("row")).select("row.*"))
    return kept.unionByName(ones)
