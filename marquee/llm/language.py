"""Language of whole texts: script ranges, then Viterbi over the words.

The script of a word's first letter leaves the languages written in it. Each word gets a
score per remaining language from byte trigrams within the word; a Viterbi pass with a
penalty for changing language labels every word, so runs of equal labels are the spans of
a mixed text. All documents of a slice take the pass in step, one word each at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.texts import LETTERS, buffer_of, documents, mix, spans, text_slices, verdicts
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: Documents per language that the model is fitted on, in expectation at most.
ROWS_PER_LANGUAGE = 4_000
BITS, SWITCH, SMOOTHING, LEAST_SHARE = 16, 8.0, 0.5, 0.001
UNKNOWN = "und"
#: How far below a language's usual mean score of a trigram a text may lie, in deviations of clean
#: texts; these are taken as at least LEAST_SPREAD.
DEVIATIONS, LEAST_SPREAD = 16.0, 0.1
#: The share of the rows that a model with bounds is fitted on; the rest tells the bounds.
LEARNED = 0.75

# First code points of script ranges; each range ends where the next begins.
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"),
    (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
)
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    scores: np.ndarray       # [1 << BITS, languages], log share of each trigram
    allowed: np.ndarray      # [scripts, languages]
    likeliest: int           # the most frequent language
    #: Of clean texts of each language: the usual mean score of a trigram, how far texts lie from
    #: it, and how far a text's single trigrams do; None where :func:`with_bounds` wasn't asked.
    bounds: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def words_of(column: pa.Array):
    """(trigram buckets, starts, ends, row, script, row offsets) of the letter runs, lower-cased.

    A word of n bytes has the n trigrams that begin on the byte before it or within it,
    short of its last; the bytes around a word count as blanks.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    empty, blank = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    closed = pc.binary_join_element_wise(empty, pc.utf8_lower(column), empty, blank)
    data, offsets = buffer_of(closed)
    starts, ends, row = spans(data, offsets, LETTERS)
    plain = np.where(LETTERS[data], data, 0x20).astype(np.uint64)
    grams = np.zeros(len(data), np.uint64)
    grams[:-2] = (plain[:-2] << np.uint64(16)) | (plain[1:-1] << np.uint64(8)) | plain[2:]
    buckets = (mix(grams) >> np.uint64(64 - BITS)).astype(np.int32)
    first = data[starts].astype(np.int32)
    ahead = [data[np.minimum(starts + k, max(len(data) - 1, 0))].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    points = np.where(first < 0x80, first,
                      np.where(first < 0xE0, ((first & 0x1F) << 6) | ahead[0],
                               np.where(first < 0xF0, ((first & 0x0F) << 12) | (ahead[0] << 6) | ahead[1], 0x10000)))
    scripts = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, points, "right") - 1]
    return buckets, starts, ends, row, scripts, offsets


def viterbi(scores: np.ndarray, row: np.ndarray, rows: int, switch: float) -> np.ndarray:
    """The best language of each word, given [words, languages] scores and each word's row.

    Best path per row where a change of language costs ``switch``. Rows are ordered by
    length, so at step t those still going are the first ones.
    """
    counts = np.bincount(row, minlength=rows)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    going = np.searchsorted(-counts, -np.arange(counts[0] if rows else 0), "left")
    best_before = np.zeros(len(row), np.int16)
    changed = np.zeros(scores.shape, bool)
    held = np.zeros((rows, scores.shape[1]), np.float32)
    for t, n in enumerate(going.tolist()):
        at = begins[:n] + t
        if t == 0:
            held[:n] = scores[at]
            continue
        before = held[:n]
        winner = before.argmax(1)
        top = before[np.arange(n), winner] - switch
        move = top[:, None] > before
        best_before[at], changed[at] = winner, move
        held[:n] = np.where(move, top[:, None], before) + scores[at]
    labels = np.zeros(len(row), np.int16)
    state = held.argmax(1).astype(np.int16) if rows else np.zeros(0, np.int16)
    for t in range(len(going) - 1, -1, -1):
        n = int(going[t])
        at = begins[:n] + t
        labels[at] = state[:n]
        state[:n] = np.where(changed[at, state[:n]], best_before[at], state[:n])
    return labels


def label_words(model: LanguageModel, column: pa.Array):
    """(labels, starts, ends, row, known, row offsets, score under the label) of all words.

    A word of n bytes is scored by n trigrams; unknown scripts say nothing and score 0.
    """
    buckets, starts, ends, row, scripts, offsets = words_of(column)
    if not len(starts):
        return np.zeros(0, np.int16), starts, ends, row, np.zeros(0, bool), offsets, np.zeros(0, np.float32)
    allowed = model.allowed[scripts]
    known = allowed.any(1)
    edges = np.column_stack([starts - 1, ends - 1]).ravel()
    scores = np.add.reduceat(model.scores[buckets], edges, axis=0)[::2]
    scores = np.where(allowed, scores, np.float32(-1e6))
    scores[~known] = 0
    labels = viterbi(scores, row, len(column), SWITCH)
    return labels, starts, ends, row, known, offsets, scores[np.arange(len(labels)), labels]


def _counted(languages: list[str]):
    place = {language: i for i, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            own = np.array([place[x] for x in batch.column("lang").to_pylist()])
            buckets, starts, ends, row, scripts, _ = words_of(batch.column("text"))
            inside = np.zeros(len(buckets) + 1, np.int64)
            np.add.at(inside, starts - 1, 1)
            np.add.at(inside, ends - 1, -1)
            used = np.flatnonzero(np.cumsum(inside)[:-1])
            per_byte = own[row][np.searchsorted(starts - 1, used, "right") - 1]
            grams = np.bincount(per_byte * (1 << BITS) + buckets[used], minlength=len(languages) << BITS)
            letters = np.bincount(own[row] * len(SCRIPT_NAMES) + scripts, ends - starts,
                                  minlength=len(languages) * len(SCRIPT_NAMES)).astype(np.int64)
            keys = np.flatnonzero(grams)
            script_keys = np.flatnonzero(letters)
            yield pa.record_batch([pa.array(np.concatenate([keys, -1 - script_keys])),
                                   pa.array(np.concatenate([grams[keys], letters[script_keys]]))], ["key", "n"])
    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where("lang is not null and lang <> '' and text is not null").where(~held_out())


def _labelled(docs: DataFrame, languages: list[str], rows_per_language: int, n: dict[str, int] | None = None):
    """(rows to learn from, the share of its language's that is drawn, a number from 0 to 1 per row)."""
    rows = _learnable(docs)
    n = n or {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    rows = rows.where(F.col("lang").isin(languages))
    rate = F.create_map(*(x for k in languages if k in n for x in (F.lit(k), F.lit(rows_per_language / n[k]))))[F.col("lang")]
    return rows, rate, F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(1 << 30)


def fit(docs: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE, share: float = 1.0) -> LanguageModel:
    """Fit on a hash-drawn sample of rows with a language, the held-out quarter left out;
    ``share`` of the rows is drawn from at most.

    What is collected is bounded by the number of trigram buckets times languages. Without
    any such row the model knows no language.
    """
    n = {r.lang: r["count"] for r in _learnable(docs).groupBy("lang").count().collect()}
    languages = sorted(n)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool), -1)
    rows, rate, chance = _labelled(docs, languages, rows_per_language, n)
    counted = (rows.where(chance < F.least(rate, F.lit(share))).select(F.col("text").cast("string").alias("text"), "lang")
               .mapInArrow(_counted(languages), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    table = counted.toArrow()
    keys, sums = table.column("key").to_numpy(), table.column("n").to_numpy()
    grams = np.zeros(len(languages) << BITS)
    grams[keys[keys >= 0]] = sums[keys >= 0]
    grams = grams.reshape(len(languages), -1) + SMOOTHING
    letters = np.zeros(len(languages) * len(SCRIPT_NAMES))
    letters[-1 - keys[keys < 0]] = sums[keys < 0]
    letters = letters.reshape(len(languages), -1)
    allowed = letters >= LEAST_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    allowed &= letters > 0
    scores = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
    return LanguageModel(languages, np.ascontiguousarray(scores), allowed.T, max(range(len(languages)),
                                                                                 key=lambda i: n[languages[i]]))


def _predicted(model: LanguageModel, with_spans: bool):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(model.languages)
        for batch in text_slices(batches, 2 << 20):
            rows = len(batch)
            labels, starts, ends, row, known, base, _ = label_words(model, batch.column("text"))
            sizes = np.where(known, ends - starts, 0)
            letters = np.bincount(row * many + labels, sizes, minlength=rows * many).reshape(rows, many)
            total = letters.sum(1)
            best = np.where(total > 0, letters.argmax(1), model.likeliest)
            share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False)
            langs = [model.languages[b] if ok and b >= 0 else UNKNOWN for b, ok in zip(best.tolist(), lettered)]
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()),
                       pa.array(np.where(lettered, share, 0.0), pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                found: list[list] = [[] for _ in range(rows)]
                begins = np.searchsorted(row, np.arange(rows + 1))
                for i in range(rows):
                    own = labels[begins[i]:begins[i + 1]]
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else [0]
                    for a, b in zip(cuts, cuts[1:]):
                        found[i].append({"lang": model.languages[own[a]],
                                         "first": int(starts[begins[i] + a] - base[i] - 1),
                                         "last": int(ends[begins[i] + b - 1] - base[i] - 1)})
                columns.append(pa.array(found, kind))
                names.append("spans")
            yield pa.record_batch(columns, names)
    return run


def predict(docs: DataFrame, model: LanguageModel, *, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with ``spans`` also the labelled byte spans of the lower-cased text.

    lang_pred is the language of most letters, score its share of the letters in scripts the
    model knows. A text that is null or has no letter is ``und`` with score 0; one in unknown
    scripts alone gets the most frequent language with score 0. One row per input row, null
    doc_ids stay null, other columns are ignored.
    """
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                         F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    if not model.languages:
        return narrow.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = "doc_id bigint, lang_pred string, score double"
    if spans:
        kind += ", spans array<struct<lang:string,first:int,last:int>>"
    return narrow.mapInArrow(_predicted(model, spans), kind)


def _gram_scores(model: LanguageModel):
    """Per text its language, trigrams, and the sum and sum of squares of their scores in it."""
    place = {language: i for i, language in enumerate(model.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            own = np.array([place[x] for x in batch.column("lang").to_pylist()])
            buckets, starts, ends, row, scripts, _ = words_of(batch.column("text"))
            fits = model.allowed[scripts, own[row]]
            starts, ends, row = starts[fits], ends[fits], row[fits]
            sizes = ends - starts
            used = np.repeat(starts - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            per = np.repeat(row, sizes)
            scores = model.scores[buckets[used], own[per]].astype(np.float64)
            n, total, squares = (np.bincount(per, w, len(batch)) for w in (None, scores, scores * scores))
            yield pa.record_batch([batch.column("lang"), pa.array(n.astype(np.int64)), pa.array(total), pa.array(squares)],
                                  ["lang", "n", "total", "squares"])
    return run


def with_bounds(model: LanguageModel, docs: DataFrame, *, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """The model with what clean texts of each language usually score, from another sample of rows.

    Medians and median distances are taken, so junk among the labelled rows moves them little.
    The sample is bounded like that of :func:`fit` and drawn from rows beyond the share LEARNED,
    which a model fitted with ``share=LEARNED`` hasn't seen; one row per language is collected.
    """
    if not model.languages:
        return model
    rows, rate, chance = _labelled(docs, model.languages, rows_per_language)
    held = (rows.where(chance >= LEARNED).where(chance < LEARNED + rate)
            .select(F.col("text").cast("string").alias("text"), "lang")
            .mapInArrow(_gram_scores(model), "lang string, n bigint, total double, squares double")
            .where("n >= 50").withColumn("mean", F.col("total") / F.col("n")))
    held = materialize(held, "language-clean")
    middle = held.groupBy("lang").agg(F.percentile_approx("mean", 0.5, 1000).alias("middle"))
    found = {r.lang: r for r in held.join(F.broadcast(middle), "lang").groupBy("lang").agg(
        F.first("middle").alias("middle"),
        F.percentile_approx(F.abs(F.col("mean") - F.col("middle")), 0.5, 1000).alias("apart"),
        F.avg(F.col("squares") / F.col("n") - F.col("mean") * F.col("mean")).alias("grain")).collect()}
    none = (-np.inf, 0.0, 0.0)  # nothing is known of such a language's texts, so all pass
    table = np.array([(found[k].middle, 1.4826 * found[k].apart, max(found[k].grain, 0.0) ** 0.5) if k in found else none
                      for k in model.languages]).reshape(-1, 3)
    return replace(model, bounds=(table[:, 0], np.maximum(table[:, 1], LEAST_SPREAD), table[:, 2]))


def accepted(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Per text whether it reads like the languages its words are labelled with.

    At least half of its letters are in scripts the model knows, and over its labelled spans
    the mean score of a trigram is at most DEVIATIONS below what clean texts reach, given how
    texts and single trigrams vary. Texts without letters aren't accepted.
    """
    labels, starts, ends, row, known, _, scores = label_words(model, column)
    n = len(column)
    sizes = ends - starts
    letters, seen = np.bincount(row, sizes, n), np.bincount(row[known], sizes[known], n)
    good = (seen > 0) & (2 * seen >= letters)
    if model.bounds is None:
        return good
    middle, spread, grain = (b[labels[known]] for b in model.bounds)
    sizes, row = sizes[known], row[known]

    def mean(values):
        with np.errstate(invalid="ignore"):
            return np.bincount(row, values * sizes, n) / np.maximum(seen, 1)

    reached = np.bincount(row, scores[known], n) / np.maximum(seen, 1)
    apart = np.sqrt(mean(spread) ** 2 + mean(grain ** 2) / np.maximum(seen, 1))
    return good & (reached >= mean(middle) - DEVIATIONS * apart)


def without_unknown(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` without the rows that aren't :func:`accepted`; a model of no language rejects none."""
    if not model.languages:
        return docs
    return docs.where(verdicts(lambda column: accepted(model, column), 1 << 20)(
        F.coalesce(F.col("text").cast("string"), F.lit(""))))


@REGISTRY.add()
def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
