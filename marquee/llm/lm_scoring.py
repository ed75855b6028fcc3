"""Stupid-backoff scores of all documents against the rest of the corpus.

Every slice of documents counts its n-grams of each length and asks for the corpus counts
of those it has: one entry per n-gram and slice, however many documents hold it. Entries
meet in partitions by a hash of the n-gram, where they are added up, and the totals go back
to the slices, which score their own texts. So a frequent word or pair costs a partition no
more entries than there are slices.

A document's own counts are taken off before it is scored, so a text is not judged by
itself. Words are runs of non-blank bytes, A-Z lower-cased; a document begins after and
ends with a mark. Words and n-grams are named by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.texts import NOT_BLANK, buffer_of, documents, mix, span_hashes, spans, text_slices
from marquee.plans.registry import Registry

REGISTRY = Registry()
#: Factor of each backoff; count given to a word that no other document has.
BACKOFF, UNSEEN = 0.4, 0.5
#: Logarithms are rounded to so many parts of one, so that sums don't depend on order.
PARTS = 1_000_000
#: Entries per partition aimed at; rows per slice at most.
PARTITION_ENTRIES, SLICE_ROWS = 2_000_000, 60_000
MARK = np.uint64(0)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        for begun in range(0, len(batch), SLICE_ROWS):
            yield batch.slice(begun, SLICE_ROWS)


def _events(text: pa.Array):
    """(words per text, owner, place in it, event before) of all words and ends, and their hashes.

    The event before the first of a text is its end, as both marks are one.
    """
    data, offsets = buffer_of(text)
    starts, ends, row = spans(data, offsets, NOT_BLANK)
    n_words = np.bincount(row, minlength=len(text))
    has = np.flatnonzero(n_words)
    size = n_words[has] + 1
    last = np.cumsum(size) - 1
    hashes = np.full(len(starts) + len(has), MARK)
    hashes[np.delete(np.arange(len(hashes)), last)] = span_hashes(data, starts, ends) >> np.uint64(1) | np.uint64(1)
    before = np.arange(len(hashes)) - 1
    before[last - size + 1] = last
    place = np.arange(len(hashes)) - np.repeat(last - size + 1, size)
    return n_words, np.repeat(has, size), place, before, hashes


def _grams(place, before, hashes, order: int):
    """(events, keys): for each length from 1 the n-grams that end at each event, where there are any."""
    events, keys = [], []
    gram = hashes
    for k in range(1, order + 1):
        if k > 1:
            gram = mix(gram[before]) * _FACTOR + hashes
        here = np.flatnonzero(place >= k - 2)
        events.append(here)
        keys.append(mix(gram[here] + np.uint64(k << 32)))
    return events, np.concatenate(keys)


def _thin(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, so that their upper bytes, mostly zeros, compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _thick(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _asked(bits: int, order: int):
    """Each slice's distinct n-grams with their counts in it, one row per partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            _, _, place, before, hashes = _events(batch.column("text"))
            if not len(hashes):
                continue
            keys, counts = np.unique(_grams(place, before, hashes, order)[1], return_counts=True)
            bucket = keys >> np.uint64(64 - bits)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(keys)]
            # the slice's name: its first row's, which is the same when a task is repeated
            name = batch.column("name")[0].as_py()
            yield pa.record_batch(
                [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array([name] * (len(cuts) - 1)),
                 pa.array([_thin(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                 pa.array([_thin(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())],
                ["bucket", "slice", "keys", "counts"])
    return run


def _answered(table: pa.Table) -> pa.Table:
    """Corpus counts of what each slice asked for, in its order."""
    parts = table.column("keys").to_pylist()
    keys = np.concatenate([np.cumsum(_thick(part), dtype=np.uint64) for part in parts])
    counts = np.concatenate([_thick(part) for part in table.column("counts").to_pylist()])
    distinct, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)[at]
    cuts = np.cumsum([0] + [len(part) // 8 for part in parts]).tolist()
    return pa.table({"bucket": table.column("bucket"), "slice": table.column("slice"),
                     "totals": pa.array([_thin(totals[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        data, offsets = buffer_of(batch.column("text"))
        yield pa.record_batch([pa.array([len(spans(data, offsets, NOT_BLANK)[0])], pa.int64())], ["n"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, place in it, doc_id, text) of every row; slices as in _asked."""
    for batch in _slices(batches):
        name = batch.column("name")[0].as_py()
        yield pa.record_batch([pa.array([name] * len(batch)), pa.array(np.arange(len(batch))),
                               batch.column("doc_id"), batch.column("text")], ["slice", "place", "doc_id", "text"])


def _scored(order: int, total: int):
    """Scores of a slice's texts from the corpus counts of their n-grams."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("place").combine_chunks()
        n_words, owner, place, before, hashes = _events(left.column("text").chunk(0))
        micro = np.zeros(len(n_words), np.int64)
        if len(hashes):
            events, keys = _grams(place, before, hashes, order)
            totals = np.concatenate([_thick(part) for part in right.sort_by("bucket").column("totals").to_pylist()]).astype(np.int64)
            _, at = np.unique(keys, return_inverse=True)
            own_key = at * len(n_words) + owner[np.concatenate(events)]
            _, own_at, own = np.unique(own_key, return_inverse=True, return_counts=True)
            others = np.split(totals[at] - own[own_at], np.cumsum([len(x) for x in events])[:-1])
            elsewhere = np.zeros((order, len(hashes)), np.int64)
            for k, here in enumerate(events):
                elsewhere[k, here] = others[k]
            longest = np.minimum(order, place + 2)
            n, size = elsewhere[0], max(total - 1, 1)
            chance = np.power(BACKOFF, longest - 1) * np.where(n > 0, n, UNSEEN) / size
            for k in range(2, order + 1):
                seen = np.flatnonzero(elsewhere[k - 1] > 0)
                ratio = elsewhere[k - 1, seen] / elsewhere[k - 2, before[seen]]
                chance[seen] = np.power(BACKOFF, longest[seen] - k) * ratio
            micro = np.bincount(owner, np.rint(np.log(chance) * PARTS), minlength=len(n_words)).astype(np.int64)
        return pa.table({"doc_id": left.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                         "micro": pa.array(micro, pa.int64())})
    return run


def score(docs: DataFrame, *, order: int = 2) -> DataFrame:
    """doc_id, n_words, micro_log (sum of rounded logs, in millionths), score (mean log per event).

    An event is a word or the end of the text; it is looked up with as many words (or the
    mark) before it as ``order`` less one, then with one fewer at a time. A null or empty text
    has no events: n_words 0, micro_log 0, score null. One row per input row; null doc_ids
    stay null; repeated rows are repeated, and count as other documents to each other; other
    columns are ignored.
    """
    if order < 2:
        raise ValueError(f"order must be at least 2, not {order}")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("name"))
    total = narrow.mapInArrow(_counted, "n long").agg(F.sum("n")).first()[0] or 0
    bits = min(24, max(3, (total * order // PARTITION_ENTRIES).bit_length()))
    # the same columns for all passes, so that batches and slices are the same
    answered = (narrow.mapInArrow(_asked(bits, order), "bucket int, slice string, keys binary, counts binary")
                .groupBy("bucket").applyInArrow(_answered, "bucket int, slice string, totals binary"))
    placed = narrow.mapInArrow(_placed, "slice string, place long, doc_id long, text string")
    added = (placed.groupBy("slice").cogroup(answered.groupBy("slice"))
             .applyInArrow(_scored(order, total), "doc_id long, n_words long, micro long"))
    events = F.when(F.col("n_words") > 0, F.col("n_words") + 1)
    return added.select("doc_id", "n_words", F.col("micro").alias("micro_log"),
                        (F.col("micro") / (F.lit(PARTS) * events)).alias("score"))


@REGISTRY.add(sql=r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS ws FROM documents),
    e AS (SELECT r, unnest(list_concat([''], ws)) AS v, unnest(list_concat(ws, [''])) AS w FROM d WHERE len(ws) > 0),
    own AS (SELECT r, v, w, count(*) AS n FROM e GROUP BY ALL),
    big AS (SELECT v, w, sum(n) AS n FROM own GROUP BY ALL),
    ctx AS (SELECT v, sum(n) AS n FROM own GROUP BY ALL),
    own_ctx AS (SELECT r, v, sum(n) AS n FROM own GROUP BY ALL),
    uni AS (SELECT w, sum(n) AS n FROM own GROUP BY ALL),
    own_uni AS (SELECT r, w, sum(n) AS n FROM own GROUP BY ALL),
    t AS (SELECT greatest(sum(len(ws)) - 1, 1) AS n FROM d),
    s AS (SELECT own.r, own.n AS times, big.n - own.n AS c2, ctx.n - own_ctx.n AS c1, uni.n - own_uni.n AS c0, t.n AS t
          FROM own JOIN big USING (v, w) JOIN ctx USING (v) JOIN own_ctx USING (r, v) JOIN uni USING (w)
          JOIN own_uni USING (r, w), t),
    m AS (SELECT r, sum(times * CAST(round(1000000 * CASE WHEN c2 > 0 THEN ln(c2 / c1)
            ELSE ln(0.4::DOUBLE * CASE WHEN c0 > 0 THEN c0::DOUBLE ELSE 0.5::DOUBLE END / t) END) AS BIGINT)) AS micro FROM s GROUP BY r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(micro, 0) AS BIGINT) AS micro_log,
           CASE WHEN len(ws) > 0 THEN coalesce(micro, 0) / (1000000 * (len(ws) + 1))::DOUBLE END AS score
    FROM d LEFT JOIN m USING (r)""")
def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))


@REGISTRY.add()
def op6_trigram_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two words of context; the twin above states bigrams."""
    return score(documents(spark, sf_dir), order=3)
