"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens score by their log-odds between toxic and clean texts under an informative
Dirichlet prior, less two standard errors and a drift that makes ordinary text sink. One
linear scan finds all maximal segments; extreme-value statistics turn a document's
segments into a p-value; a logistic curve turns that into a score between 0 and 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.texts import LETTERS, buffer_of, documents, shingle_sets, span_hashes, spans, text_slices, verdicts
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: Bounds of the labelled sample that the classifier is fitted on.
TOXIC_ROWS, CLEAN_ROWS = 15_000, 45_000
PRIOR_SHARE, DRIFT, LEAST_Z, ERRORS = 0.08, 0.1, 2.3, 1.0
THRESHOLD = 0.7


@dataclass(frozen=True)
class ToxicityModel:
    hashes: np.ndarray       # sorted token hashes
    scores: np.ndarray       # their scores, drift taken off
    drift: float
    decay: float             # lambda of the extreme-value law
    scale: float             # its K
    intercept: float
    slope: float


def tokens_of(column: pa.Array):
    """(hashes, starts, ends, row) of the letter runs of each text, lower-cased."""
    data, offsets = buffer_of(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    starts, ends, row = spans(data, offsets, LETTERS)
    return span_hashes(data, starts, ends), starts, ends, row


def maximal_segments(lows: list[float], highs: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, given the running total before and after each positive item.

    Returns (score, first item, last item). A stack of disjoint segments is kept; a new one
    joins back to the last segment that begins lower, if it ends higher than that one.
    """
    kept: list[tuple[float, float, int, int]] = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        first = i
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j -= 1
            if j < 0 or kept[j][1] >= high:
                kept.append((low, high, first, i))
                break
            low, first = kept[j][0], kept[j][2]
            del kept[j:]
    return [(high - low, first, last) for low, high, first, last in kept]


def evidence(segments: list[float], tokens: int, decay: float, scale: float) -> float:
    """-log p of the best segments taken together, for the best number of them.

    For r segments of normalised scores summing to x, p is about
    exp(-x) * x ** (r - 1) / (r! (r - 1)!), less a factor for trying several r.
    """
    best, total = 0.0, 0.0
    for r, score in enumerate(sorted(segments, reverse=True), 1):
        total += decay * score - math.log(scale * tokens)
        if total <= r:
            continue
        log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
        best = max(best, -log_p - math.log(r * (r + 1)))
    return best


def token_scores(model: ToxicityModel, hashes: np.ndarray) -> np.ndarray:
    scores = np.full(len(hashes), -model.drift)
    if len(model.hashes):
        maybe = np.zeros(1 << 20, bool)
        maybe[model.hashes >> np.uint64(44)] = True
        rows = np.flatnonzero(maybe[hashes >> np.uint64(44)])
        at = np.minimum(np.searchsorted(model.hashes, hashes[rows]), len(model.hashes) - 1)
        same = model.hashes[at] == hashes[rows]
        scores[rows[same]] = model.scores[at[same]]
    return scores


def scored_segments(model: ToxicityModel, column: pa.Array):
    """Per row: (number of tokens, [(score, first byte, last byte of the lower-cased text)])."""
    hashes, starts, ends, row = tokens_of(column)
    scores = token_scores(model, hashes)
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    counts = np.bincount(row, minlength=len(column))
    found: list[list] = [[] for _ in range(len(column))]
    positive = np.flatnonzero(scores > 0)
    owners, first = np.unique(row[positive], return_index=True)
    _, offsets = buffer_of(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    for owner, a, b in zip(owners.tolist(), first.tolist(), [*first[1:].tolist(), len(positive)]):
        items = positive[a:b]
        found[owner] = [(score, int(starts[items[i]] - offsets[owner]), int(ends[items[j]] - offsets[owner]))
                        for score, i, j in maximal_segments(sums[items].tolist(), sums[items + 1].tolist())]
    return counts, found


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each text's smallest shingle hash, which most near copies share."""
    for batch in text_slices(batches):
        sets = shingle_sets(batch.column("text"))
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        yield pa.record_batch([batch.column("text"), batch.column("toxic"), pa.array(least.view(np.int64))],
                              ["text", "toxic", "print"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each token occurs."""
    for batch in text_slices(batches):
        hashes, _, _, row = tokens_of(batch.column("text"))
        distinct, inverse = np.unique(hashes, return_inverse=True)
        pairs = np.unique(inverse.astype(np.int64) * len(batch) + row)
        inverse = pairs // len(batch)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[pairs % len(batch)] == 1
        bad = np.bincount(inverse[toxic], minlength=len(distinct))
        every = np.bincount(inverse, minlength=len(distinct))
        yield pa.record_batch([pa.array(distinct.view(np.int64)), pa.array(bad), pa.array(every - bad)],
                              ["token", "bad", "good"])


def _raw(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, found = scored_segments(model, batch.column("text"))
            yield pa.record_batch([batch.column("toxic").cast(pa.int32()), pa.array(counts, pa.int64()),
                                   pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.float64()))],
                                  ["toxic", "tokens", "segments"])
    return run


def _decay(shares: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(share * exp(root * score)) = 1."""
    if not (scores > 0).any() or (shares * scores).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    total = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum())
    while total(high) < 1:
        high *= 2
    while total(low) > 1:
        low /= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) by Newton steps with a small ridge; the slope is not negative."""
    if len(set(y.tolist())) < 2:
        return (4.0 if len(y) and y[0] else -4.0), 1.0
    weights = np.zeros(2)
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - 1e-2 * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), max(0.0, float(weights[1]))


def draw(labels: DataFrame, *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(doc_id, toxic) of a hash-drawn sample, in expectation at most so many rows per class.

    Rows without id or label and the held-out third are left out; of several labels of a
    document the larger holds.
    """
    rows = (labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out())
            .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")))
    n = dict(rows.groupBy("toxic").count().collect())
    rate = F.when(F.col("toxic") == 1, toxic_rows / max(n.get(1, 0), 1)).otherwise(clean_rows / max(n.get(0, 0), 1))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / F.lit(1 << 30)
    return rows.where(chance < rate)


def fit(docs: DataFrame, labels: DataFrame, **bounds: int) -> ToxicityModel:
    """Fit on the texts of the documents that :func:`draw` picks from the labels.

    Copies of a text count once, and a token once per text. Three quarters of the sample give the token scores,
    the rest the extreme-value law and the curve. Without labels every score is low.
    """
    picked = F.broadcast(draw(labels, **bounds))  # bounded by the size of the sample
    sample = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
              .join(picked, "doc_id")
              .select("text", "toxic").mapInArrow(_prints, "text string, toxic int, print bigint")
              .groupBy("toxic", "print").agg(F.min("text").alias("text")))
    sample = materialize(sample.withColumn("part", F.pmod(F.xxhash64("print"), F.lit(4))), "toxicity-sample")
    counts = materialize(sample.where("part > 0").select("text", "toxic")
                         .mapInArrow(_counted, "token bigint, bad bigint, good bigint")
                         .groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")),
                         "toxicity-counts")
    bad, good = (x or 0 for x in counts.agg(F.sum("bad"), F.sum("good")).first())
    alpha = PRIOR_SHARE * (bad + good)
    prior = F.lit(PRIOR_SHARE) * (F.col("bad") + F.col("good"))
    odds = (F.log((F.col("bad") + prior) / F.lit(bad + alpha))
            - F.log((F.col("good") + prior) / F.lit(good + alpha)))
    error = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    share = (F.col("good") + prior) / F.lit(good + alpha)
    lexicon = (counts.where("bad + good > 0").select("token", share.alias("share"), odds.alias("odds"), error.alias("error"))
               .where(F.abs(F.col("odds") / F.col("error")) >= LEAST_Z)
               .collect())  # bounded by the tokens of the sample
    lexicon = sorted((np.uint64(r.token & (1 << 64) - 1), r.share,
                      math.copysign(max(0.0, abs(r.odds) - ERRORS * r.error), r.odds) - DRIFT) for r in lexicon)
    hashes = np.array([r[0] for r in lexicon], np.uint64)
    shares, scores = np.array([r[1] for r in lexicon]), np.array([r[2] for r in lexicon])
    decay = _decay(np.append(shares, max(0.0, 1 - shares.sum())), np.append(scores, -DRIFT))
    model = ToxicityModel(hashes, scores, DRIFT, decay, 1.0, 0.0, 1.0)
    held = (sample.where("part = 0").select("text", "toxic")
            .mapInArrow(_raw(model), "toxic int, tokens bigint, segments array<double>").collect())
    clean = [r for r in held if r.toxic == 0 and r.tokens]
    spread = sum(r.tokens * math.exp(-decay * max(r.segments, default=0.0)) for r in clean)
    scale = max(len(clean) / spread, 1e-9) if spread else 1.0
    x = np.array([evidence(r.segments, max(r.tokens, 1), decay, scale) for r in held])
    intercept, slope = _logistic(x, np.array([float(r.toxic) for r in held]))
    return ToxicityModel(hashes, scores, DRIFT, decay, scale, intercept, slope)


_PASSAGES = "array<struct<first:int,last:int,score:double,expected:double>>"


def _scored(model: ToxicityModel, most_expected: float):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()),
                               ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, found = scored_segments(model, batch.column("text"))
            scores, passages = [], []
            for n, segments in zip(counts.tolist(), found):
                x = evidence([s for s, _, _ in segments], max(n, 1), model.decay, model.scale)
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, model.intercept + model.slope * x)))))
                expected = [(a, b, s, model.scale * n * math.exp(-model.decay * s)) for s, a, b in segments]
                passages.append([dict(zip(("first", "last", "score", "expected"), e))
                                 for e in expected if e[3] <= most_expected])
            yield pa.record_batch(
                [*(batch.column(c) for c in batch.schema.names if c != "text"),
                 pa.array(scores, pa.float64()), pa.array(passages, kind)],
                [*(c for c in batch.schema.names if c != "text"), "score", "passages"])
    return run


def score(docs: DataFrame, model: ToxicityModel, *, most_expected: float = 0.01) -> DataFrame:
    """doc_id, score, passages (byte span in the lower-cased text, score, expected number
    of such passages in clean text of that length, at most ``most_expected``).

    One row per input row, no shuffle. A null or empty text has the score of no evidence and
    no passages; null doc_ids stay null; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_scored(model, most_expected), f"doc_id bigint, score double, passages {_PASSAGES}")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def without_toxic(docs: DataFrame, model: ToxicityModel, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; all columns stay."""
    def clean(column: pa.Array) -> np.ndarray:
        counts, found = scored_segments(model, column)
        x = np.array([evidence([s for s, _, _ in f], max(n, 1), model.decay, model.scale)
                      for n, f in zip(counts.tolist(), found)])
        scores = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -700, 700)))
        return scores < threshold
    return docs.where(verdicts(clean, 1 << 20)(F.coalesce(F.col("text").cast("string"), F.lit(""))))


@REGISTRY.add()
def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                         F.size("passages").alias("n_passages"))
