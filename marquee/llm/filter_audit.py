"""How filters interact: survivors of every subset of up to five filters, per part and label.

A document's failures are five bits; its truth table is a 32-bit word whose bit S is set
if the document survives the filters of subset S. Words are counted by carry-save adders:
three planes of words become a sum and a carry plane until two are left per weight, and
only those few are counted bit by bit. What any order of filters keeps, removes or leaves
to a later one is a difference of two of the 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.texts import documents
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
SUBSETS = 32
#: A group of equal texts above this share of all rows is marked by a broadcast; fewer than 1,000 can be.
HOT_SHARE = 1_000
CLASSES = ("rows", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by filter letter."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def survival_words() -> np.ndarray:
    """Per failure mask the word whose bit S says that no filter of subset S fails."""
    subsets = np.arange(SUBSETS, dtype=np.uint64)
    lives = (subsets[None, :] & subsets[:, None]) == 0
    return (lives.astype(np.uint64) << subsets[None, :]).sum(1).astype(np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save adders."""
    counts = np.zeros(SUBSETS, np.int64)
    bits = np.arange(SUBSETS, dtype=np.uint32)
    weight = 1
    while len(words):
        carries = []
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = words[:third], words[third:2 * third], words[2 * third:3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third:]])
        counts += weight * ((words[:, None] >> bits) & np.uint32(1)).sum(0, dtype=np.int64)
        words = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return counts


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, mask (bit k: the k-th filter fails), good and toxic.

    Null text counts as empty, null lang as the empty string. E fails where a smaller doc_id
    has the identical text: a null doc_id is neither smaller nor larger than any, and rows that
    repeat the smallest doc_id pass. A document is good or toxic if any label row of its doc_id
    says so. Texts are compared by their SHA-256; the texts themselves aren't shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = text_failures(text)
    mask = sum((F.when(fails[k], 1 << i).otherwise(0) for i, k in enumerate("ABCD")), F.lit(0))
    rows = materialize(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), mask.alias("mask")), "audit-rows")
    groups = rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    groups = materialize(groups.where("n > 1"), "audit-copies").withColumnRenamed("sha", "same")
    most = max(rows.count() // HOT_SHARE, 1)
    hot, rest = groups.where(F.col("n") > most), groups.where(F.col("n") <= most)
    marked = rows.join(F.broadcast(hot), F.col("sha") == F.col("same"), "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    done = marked.where("same is not null").select("doc_id", "part", "mask", later.alias("later"))
    cold = marked.where("same is null").select("doc_id", "part", "mask", "sha").join(
        rest, F.col("sha") == F.col("same"), "left").select("doc_id", "part", "mask", later.alias("later"))
    both = done.unionByName(cold).withColumn("mask", F.col("mask") + F.when(F.col("later"), 16).otherwise(0)).drop("later")
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(
        F.col("doc_id").cast("bigint").alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without a doc_id are spread by a number of their own and meet no label.
    keyed = both.select("part", "mask", F.col("doc_id").isNotNull().alias("known"),
                        F.coalesce("doc_id", F.monotonically_increasing_id()).alias("key"))
    return keyed.join(marks.withColumn("known", F.lit(True)), ["key", "known"], "left").select(
        "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = survival_words()
    for batch in batches:
        words = table[batch.column("mask").to_numpy()]
        parts = batch.column("part").dictionary_encode()
        which = parts.indices.to_numpy()
        flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in CLASSES[1:]]
        names, kinds, counts = [], [], []
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(parts.dictionary) + 1))
        for name, a, b in zip(parts.dictionary.to_pylist(), bounds, bounds[1:]):
            own = order[a:b]
            for kind, chosen in zip(CLASSES, (own, *(own[f[own]] for f in flags))):
                names.append(name)
                kinds.append(kind)
                counts.append(positional_counts(words[chosen]))
        if names:
            yield pa.record_batch([pa.array(names), pa.array(kinds), *map(pa.array, np.array(counts).T.copy())],
                                  ["part", "kind", *(f"s{k}" for k in range(SUBSETS))])


def survivors(masks: DataFrame) -> DataFrame:
    """Per part three arrays of 32: how many rows, good and toxic rows survive each subset."""
    columns = [f"s{k}" for k in range(SUBSETS)]
    kind = "part string, kind string, " + ", ".join(f"{c} bigint" for c in columns)
    sums = masks.mapInArrow(_counted, kind).groupBy("part", "kind").agg(*(F.sum(c).alias(c) for c in columns))
    lists = sums.select("part", "kind", F.array(*columns).alias("n"))
    return lists.groupBy("part").agg(*(F.max(F.when(F.col("kind") == c, F.col("n"))).alias(c) for c in CLASSES))


def interactions(counts: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Every order of the filters, step by step, from the survivors of the subsets."""
    bit = {letter: 1 << k for k, letter in enumerate(letters)}
    every, many = sum(bit.values()), len(letters)
    steps = []
    for order in permutations(letters):
        before = 0
        for k, letter in enumerate(order, 1):
            steps.append(f"{''.join(order)} {k} {before} {bit[letter]}")
            before += bit[letter]

    def at(name, subset):
        return F.get(F.col(name), subset)

    def shapley(own):
        """A filter's removals over all orders: each set before it, by the number of orders that begin so."""
        return " + ".join(
            f"{factorial(s.bit_count()) * factorial(many - 1 - s.bit_count())} * (rows[{s}] - rows[{s | own}])"
            for s in range(every + 1) if not s & own)

    worth = F.expr("map(" + ", ".join(f"{own}, {shapley(own)}" for own in bit.values()) + ")")
    # One literal holds all steps: as many column objects would take seconds to build.
    step = F.explode(F.split(F.lit(",".join(steps)), ","))
    table = counts.withColumn("worth", worth).select("*", step.alias("at")).withColumn("at", F.split("at", " ")).select(
        "part", *CLASSES, "worth", F.get("at", F.lit(0)).alias("filter_order"),
        *(F.get("at", F.lit(k)).cast("int").alias(c) for k, c in enumerate(("step", "before", "own"), 1)))
    b, own = F.col("before"), F.col("own")
    after, others = b.bitwiseOR(own), F.lit(every).bitwiseXOR(own)
    failing = at("rows", F.lit(0)) - at("rows", own)
    removed = at("rows", b) - at("rows", after)
    return table.select(
        "part", "filter_order", "step", at("rows", after).alias("kept"), removed.alias("removed"),
        (failing - removed).alias("redundant"), (at("rows", others) - at("rows", F.lit(every))).alias("unique_fails"),
        (at("good", b) - at("good", after)).alias("good_lost"),
        (at("toxic", b) - at("toxic", after)).alias("toxic_lost"), F.element_at("worth", own).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (removals by the step's filter, summed over all orders).

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are
    ignored. 600 rows per part; an empty table has no part and gives no rows. Repeated rows
    count each; empty and null texts fail A alone (and E where repeated).
    """
    return interactions(materialize(survivors(failure_masks(docs, labels)), "audit-survivors"))


@REGISTRY.add(sql="""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    f AS (
        SELECT doc_id, part, CAST(len(w) < 100 AS INTEGER) AS a,
               CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) AS b,
               CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER) AS c,
               CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) AS d,
               CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS e FROM d),
    m AS (
        SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n,
               count(*) FILTER (WHERE quality) AS good, count(*) FILTER (WHERE toxic) AS bad
        FROM f LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS quality, bool_or(toxic = 1) AS toxic
                          FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY ALL),
    x(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o AS (
        SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order,
               [p.own, q.own, r.own, s.own, t.own] AS own
        FROM x p, x q, x r, x s, x t WHERE p.own | q.own | r.own | s.own | t.own = 31),
    g AS (
        SELECT filter_order, CAST(i AS INTEGER) AS step, own[i] AS own,
               coalesce(list_sum(own[1:i - 1]), 0) AS before FROM o, range(1, 6) AS k(i)),
    s AS (
        SELECT part, filter_order, step, own,
               coalesce(sum(n) FILTER (WHERE mask & (before | own) = 0), 0) AS kept,
               coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS removed,
               coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0), 0) AS redundant,
               coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
               coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS good_lost,
               coalesce(sum(bad) FILTER (WHERE mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
        FROM m, (SELECT filter_order, step, own, CAST(before AS INTEGER) AS before FROM g) GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM s""")
def op11_survival_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
