"""Reproducible shuffling into shards with a Feistel permutation of row numbers.

All of it is SQL expressions. A row's place is computable from its global row number
alone: permute, then shard = place mod shards and slot = place div shards. So shard
sizes differ by one row at most, and slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.texts import documents
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
ROUNDS = 8
#: Steps that cycle walking may take; see feistel_place.
MOST_STEPS = 64


def feistel_place(row_number: str, rows: int, seed: int = 0) -> str:
    """SQL for the place in [0, rows) of a row number in [0, rows): a bijection.

    The network works on (left, right) with left below ``high`` and right below ``low``,
    high * low being the smallest such grid of at least ``rows`` cells; each round adds a
    hash of one half to the other, modulo the other's size. A value that lands outside
    [0, rows) walks on along its cycle. At most high * low - rows < high cells lie outside,
    so a walk ends after one step more than that; beyond ``MOST_STEPS`` (only possible
    from 4,096 rows on, with a chance under 64 ** -64 per row) an error is raised.
    """
    high = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    low = max(1, -(-rows // high))
    steps = min(high * low - rows + 1, MOST_STEPS)
    halves = (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', v div {low}L, 'r', v % {low}L), "
              f"(h, i) -> named_struct("
              f"'l', if(i % 2 = 1, (h.l + pmod(xxhash64(h.r, i, {seed}), {high}L)) % {high}L, h.l), "
              f"'r', if(i % 2 = 0, (h.r + pmod(xxhash64(h.l, i, {seed}), {low}L)) % {low}L, h.r)), "
              f"h -> h.l * {low}L + h.r)")
    walk = (f"aggregate(sequence(1, {steps}), {rows}L + cast({row_number} as bigint), (w, s) -> "
            f"if(w < {rows}L, w, aggregate(array(if(s = 1, w - {rows}L, w)), 0L, (z, v) -> {halves})))")
    return (f"transform(array({walk}), p -> if(p < {rows}L, p, "
            f"cast(raise_error('cycle walking did not end') as bigint)))[0]")


def shards(docs: DataFrame, *, count: int = 24, seed: int = 0) -> DataFrame:
    """Deal all rows into ``count`` shards, in an order that depends on the rows alone.

    The row number orders rows by a hash of (doc_id, text checksum, size), then by these
    values, so it doesn't depend on files or partitions; rows alike in all three are
    interchangeable. Returns doc_id, size (UTF-8 bytes of the text plus 8; null: 8),
    text_crc32, row_number, shard, slot. Null ids are ordered like a value of their own;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                         (F.octet_length(text) + F.lit(8)).cast("bigint").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
    narrow = materialize(narrow.withColumn("bucket", F.expr(
        "shiftrightunsigned(xxhash64(doc_id, text_crc32, size), 52)")), "shard-rows")
    # 4,096 hash ranges: their counts give the first row number of each.
    counts = narrow.groupBy("bucket").count()
    before = counts.select("bucket", (F.sum("count").over(
        Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    rows = narrow.count()
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = (narrow.withColumn("within", within).join(F.broadcast(before), "bucket")
                .select("doc_id", "size", "text_crc32", (F.col("before") + F.col("within")).alias("row_number")))
    place = F.expr(feistel_place("row_number", rows, seed))
    return (numbered.withColumn("place", place)
            .select("doc_id", "size", "text_crc32", "row_number",
                    (F.col("place") % count).cast("int").alias("shard"),
                    F.expr(f"place div {count}").alias("slot")))


@REGISTRY.add()
def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: the counts of the shards are at most one apart."""
    return shards(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
