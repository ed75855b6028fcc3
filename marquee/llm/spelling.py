"""Spelling variants: words one edit apart, found through grams of varying length.

A gram of a word begins at each of its places and grows for as long as it is frequent in
the vocabulary; the dictionary of frequent grams is pruned by a threshold that follows the
vocabulary, so its size is bounded. A gram depends on its own letters alone, hence an edit
at a letter changes only the grams that cover it: the most that cover any one letter is the
word's bound of affected grams. Of a word's grams, one more than the bound must include one
that a near word shares at the same place (or one further, behind an inserted letter), so
only those lists are merged, the rarest grams first. What meets is verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.texts import buffer_of, byte_class, documents, mix, spans, span_hashes, text_slices
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
LEAST_LETTERS, LEAST_COUNT = 5, 3
#: Shortest gram, and longest in words of at least as many letters.
LEAST_GRAM, MOST_GRAM = 2, 8
#: Frequent grams of each length that are kept at most; bounds what is collected and broadcast.
DICTIONARY = 100_000
_ASCII = byte_class((0x41, 0x5A), (0x61, 0x7A))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Longest run, in bytes, whose checksums are worked out in step with the others.
MOST_STEPS = 64
_GRAM_BITS = np.int64(7)
#: Places of a word whose grams are used: more than an edit can affect, so the first ones suffice.
WINDOW = 24


# --- words and how often they occur ------------------------------------------------

def _crc_table() -> np.ndarray:
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


_CRC_STEP = _crc_table()


def _runs(column: pa.Array):
    """(bytes with A-Z lower-cased, starts, ends, row) of the runs of A-Z, a-z and U+00C0 to U+00FF."""
    data, offsets = buffer_of(column)
    data = _LOWER[data]
    lead = data == 0xC3  # with the byte behind it a character from U+00C0 to U+00FF
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    # Runs are found on flags, as a byte alone doesn't tell whether it is inside.
    starts, ends, row = spans(inside.astype(np.uint8), offsets, np.array([False, True] + [False] * 254))
    return data, starts, ends, row


def _checksums(data, starts, ends, row, names: list[bytes]) -> np.ndarray:
    """The CRC-32 of ``<name>:<run>`` of every run, each row having a name.

    A checksum behind a prefix is the run's own, combined with the prefix's moved along by
    as many zero bytes as the run has. Both are worked out for all rows or runs in step.
    """
    sizes = ends - starts
    heads = np.array([zlib.crc32(n + b":") for n in names], np.uint32)
    most = int(min(sizes.max(initial=0), MOST_STEPS))
    moved = np.empty((most + 1, len(heads)), np.uint32)
    if len(heads):
        moved[0] = heads
    for step in range(most):
        moved[step + 1] = _CRC_STEP[moved[step] & 0xFF] ^ (moved[step] >> np.uint32(8))
    order = np.argsort(-sizes, kind="stable")
    going = np.searchsorted(-sizes[order], -np.arange(most), "left")
    state = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    begins = starts[order]
    for step, n in enumerate(going.tolist()):
        state[:n] = _CRC_STEP[(state[:n] ^ data[begins[:n] + step]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    own = np.empty(len(sizes), np.uint32)
    own[order] = ~state
    out = own ^ moved[np.minimum(sizes, most), row] if len(sizes) else own
    for k in np.flatnonzero(sizes > MOST_STEPS):
        out[k] = zlib.crc32(names[row[k]] + b":" + data[starts[k]:ends[k]].tobytes())
    return out


def _counted(least_letters: int):
    """(word, n) of each slice: its long enough runs, where 97 divides the checksum with a letter deleted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            if (counts := _slice_counts(batch, least_letters)) is not None:
                yield counts
    return run


def _slice_counts(batch: pa.RecordBatch, least_letters: int) -> pa.RecordBatch | None:
    data, starts, ends, row = _runs(batch.column("text"))
    if not len(starts):
        return None
    names = [b"" if d is None else b"%d" % d for d in batch.column("doc_id").to_pylist()]
    sums = _checksums(data, starts, ends, row, names)
    struck = np.flatnonzero(sums % np.uint32(97) == 0)
    altered = []
    for k in struck.tolist():
        run = data[starts[k]:ends[k]].tobytes().decode()
        at = int(sums[k]) % len(run)
        if len(run) > least_letters:
            altered.append(run[:at] + run[at + 1:])
    doubled = np.concatenate([[0], np.cumsum(data == 0xC3)])
    whole = ends - starts - (doubled[ends] - doubled[starts]) >= least_letters
    whole[struck] = False
    starts, ends = starts[whole], ends[whole]
    _, first, counts = np.unique(span_hashes(data, starts, ends, fold_case=False), return_index=True,
                                 return_counts=True)
    # The bytes of the distinct runs, one behind another.
    begins, sizes = starts[first], (ends - starts)[first]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    flat = data[np.repeat(begins - offsets[:-1], sizes) + np.arange(offsets[-1])]
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))
    return pa.record_batch([
        pa.concat_arrays([words, pa.array(altered, pa.string())]),
        pa.array(np.concatenate([counts, np.ones(len(altered), np.int64)]))], ["word", "n"])


def word_counts(docs: DataFrame, *, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the distinct words of enough letters that occur often enough.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased; one
    whose CRC-32 of ``<doc_id>:<run>`` is a multiple of 97 loses the letter at that number
    modulo its length. A null doc_id counts as the empty string, a null text as empty.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return (narrow.mapInArrow(_counted(least_letters), "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


# --- grams -------------------------------------------------------------------------

class Grams:
    """The letters of a batch of words, one behind another, each word between two end marks.

    A letter is a number below 128: a-z, then U+00C0 to U+00FF, then the marks, so that a
    gram of up to eight letters is exactly one 64-bit number.
    """

    FRONT, BACK = 91, 92

    def __init__(self, words: pa.Array) -> None:
        self.words = words
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        letters = np.where(points < 0x80, points - 0x60, points - 0xC0 + 27)
        self.sizes = np.array([len(w) for w in words.to_pylist()], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes + 2)])
        self.flat = np.zeros(self.begins[-1], np.int64)
        inner = np.ones(len(self.flat), bool)
        inner[self.begins[:-1]] = inner[self.begins[1:] - 1] = False
        self.flat[inner] = letters
        self.flat[self.begins[:-1]], self.flat[self.begins[1:] - 1] = self.FRONT, self.BACK
        #: Word of each place, and how many letters or marks stand from it to the word's end.
        self.word = np.repeat(np.arange(len(words)), self.sizes + 2)
        self.left = self.begins[1:][self.word] - np.arange(len(self.flat))

    def codes(self, length: int) -> np.ndarray:
        """The number of the gram of ``length`` at each place (nonsense where the word ends before)."""
        code = np.zeros(len(self.flat), np.int64)
        for k in range(length):
            code <<= _GRAM_BITS
            code[:len(code) - k] |= self.flat[k:]
        return code

    def grown(self, frequent: list[np.ndarray], most: np.ndarray):
        """(code, length) of the gram at each place, as long as it is frequent and ``most`` of its word allows."""
        most = most[self.word]
        length = np.where(self.left >= LEAST_GRAM, LEAST_GRAM, 0)
        code = np.where(length > 0, self.codes(LEAST_GRAM), 0)
        going = length > 0
        for size, known in enumerate(frequent, LEAST_GRAM):
            going = going & (self.left > size) & (most > size)
            if not len(known) or not going.any():
                break
            at = np.flatnonzero(going)
            place = np.minimum(np.searchsorted(known, code[at]), len(known) - 1)
            going[at] = known[place] == code[at]
            at = np.flatnonzero(going)
            code[at] = (code[at] << _GRAM_BITS) | self.flat[at + size]
            length[at] = size + 1
        return code, length


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, WORD_BYTES):
        grams = Grams(batch.column("text"))
        for size in range(LEAST_GRAM, MOST_GRAM):
            code, n = np.unique(grams.codes(size)[grams.left >= size], return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(code), size, np.int32)), pa.array(code), pa.array(n)],
                                  ["size", "code", "n"])


def gram_dictionary(words: DataFrame, *, entries: int = DICTIONARY) -> list[np.ndarray]:
    """Per gram length from LEAST_GRAM on the sorted grams that are frequent.

    Frequent is what occurs at more than one in ``entries`` places of the vocabulary (and more
    than once), so no length has more than ``entries``: what is collected is bounded.
    """
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(places // entries, 1)
    counts = (words.select(F.col("word").alias("text")).mapInArrow(_gram_counts, "size int, code bigint, n bigint")
              .groupBy("size", "code").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("size", "code"))
    table = counts.toArrow()
    sizes, codes = table.column("size").to_numpy(), table.column("code").to_numpy()
    return [np.sort(codes[sizes == size]) for size in range(LEAST_GRAM, MOST_GRAM)]


def affected(grams: Grams, length: np.ndarray) -> np.ndarray:
    """Per word the most grams that cover any one of its letters."""
    cover = np.zeros(len(length) + 1, np.int64)
    starts = np.flatnonzero(length)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + length[starts], -1)
    cover = np.cumsum(cover)[:-1]
    cover[grams.begins[:-1]] = cover[grams.begins[1:] - 1] = 0
    return np.maximum.reduceat(cover, grams.begins[:-1])


def _signature(grams: Grams) -> np.ndarray:
    """Per word a bit per letter (modulo 64): whether it occurs an odd number of times."""
    bit = np.left_shift(np.uint64(1), (grams.flat & 63).astype(np.uint64))
    return np.bitwise_xor.reduceat(bit, grams.begins[:-1]).view(np.int64)


#: Bytes of words handled at a time.
WORD_BYTES = 256 << 10
#: A posting's role: two words of one length, the shorter of two, the longer of two.
SAME, SHORTER, LONGER = range(3)


def _postings(frequent: list[np.ndarray]):
    names = ["key", "role", "word", "n", "letters"]

    def keyed(code, length, place, size, kind):
        """One number for a gram, its place, the longer word's length and whether lengths differ."""
        key = mix(code.view(np.uint64) ^ mix((length << 32 | place << 1 | kind).astype(np.uint64)))
        return mix(key + size.astype(np.uint64)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, WORD_BYTES):
            grams = Grams(batch.column("text"))
            if not len(grams.sizes):
                continue
            signature = _signature(grams)
            for kind in (SAME, LONGER):
                # Two words of different lengths are cut by what the shorter allows.
                allowed = np.clip(grams.sizes - (kind == LONGER), LEAST_GRAM, MOST_GRAM)
                code, length = grams.grown(frequent, allowed)
                place = np.arange(len(length)) - grams.begins[grams.word]
                every = np.flatnonzero((length > 0) & (place < WINDOW + (kind == LONGER)))
                if kind == SAME:
                    probes = _rarest(grams, frequent, code, length, every)
                    shorter = probes
                for role, at, step in ((SAME, shorter, 0), (SHORTER, shorter, 0), (SHORTER, shorter, 1)) \
                        if kind == SAME else ((LONGER, every, 0),):
                    word = grams.word[at]
                    place = at - grams.begins[word] + step
                    size = grams.sizes[word] + (role == SHORTER)
                    key = keyed(code[at], length[at], place, size, int(role != SAME))
                    yield pa.record_batch([
                        pa.array(key), pa.array(np.full(len(at), role, np.int8)), batch.column("text").take(pa.array(word)),
                        batch.column("n").take(pa.array(word)), pa.array(signature[word])], names)
    return run


def _rarest(grams: Grams, frequent, code, length, every) -> np.ndarray:
    """Places of one more gram of each word than an edit can affect, rare ones first.

    The order of two grams at the same place is the same in all words.
    """
    common = np.zeros(len(every), bool)
    for size, known in enumerate(frequent, LEAST_GRAM):
        own = np.flatnonzero(length[every] == size)
        if len(known) and len(own):
            place = np.minimum(np.searchsorted(known, code[every[own]]), len(known) - 1)
            common[own] = known[place] == code[every[own]]
    common |= length[every] == MOST_GRAM
    word = grams.word[every]
    place = every - grams.begins[word]
    chance = mix(code[every].view(np.uint64) ^ mix(place.astype(np.uint64)))
    order = np.lexsort((chance, -length[every], common, word))
    begun = np.searchsorted(word[order], np.arange(len(grams.sizes)))
    rank = np.arange(len(order)) - begun[word[order]]
    return np.sort(every[order[rank <= affected(grams, length)[word[order]]]])


# --- pairs and forms ---------------------------------------------------------------

def near_pairs(words: DataFrame, *, entries: int = DICTIONARY) -> DataFrame:
    """(word, n, other, other_n) of all words of ``words`` (word, n) that are exactly one edit apart.

    Both directions are given, each possibly several times. Words have at least LEAST_LETTERS letters.
    """
    frequent = gram_dictionary(words, entries=entries)
    postings = words.select(F.col("word").alias("text"), "n").mapInArrow(
        _postings(frequent), "key bigint, role byte, word string, n bigint, letters bigint")
    postings = materialize(postings, "spelling-grams")
    asked = postings.where(F.col("role") != LONGER)
    index = postings.where(F.col("role") != SHORTER).select(
        "key", F.col("role").alias("index_role"), F.col("word").alias("other"), F.col("n").alias("other_n"),
        F.col("letters").alias("other_letters"))
    # A key tells the kind of pair, so roles need no condition of their own.
    met = asked.join(index, "key").where(
        (F.bit_count(F.col("letters").bitwiseXOR(F.col("other_letters"))) <= 2)
        & ((F.col("role") == SHORTER) | (F.col("word") < F.col("other")))
        & (F.levenshtein("word", "other", 1) == 1))
    return met.select(F.explode(F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"),
                 F.col("n").alias("other_n")))).alias("pair")).select("pair.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words of ``forms`` (word, form): the last word reached by following forms.

    Every round doubles the steps taken; forms at least double n, so there are few.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved"))
        step = materialize(step, "spelling-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, *, entries: int = DICTIONARY, factor: int = 2) -> DataFrame:
    """Groups words under the spelling they are a variant of: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: smallest in code-point order) where that n is
    at least ``factor`` times the word's, else null; ``root`` the last of the forms followed from
    the word. One row per word of :func:`word_counts`; repeated documents count each, other
    columns are ignored, an empty table gives no rows.
    """
    words = materialize(word_counts(docs), "spelling-words")
    pairs = near_pairs(words, entries=entries)
    # Dealt by word once: the doubles of a pair and the pairs of a word meet in the same place.
    pairs = pairs.repartition("word").groupBy("word", "other").agg(F.max("n").alias("n"), F.max("other_n").alias("other_n"))
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("n").alias("own"),
        F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    enough = -F.col("best.rank") >= factor * F.col("own")
    near = materialize(best.select(
        "word", "n_near", F.when(enough, F.col("best.other")).alias("form"),
        F.when(enough, -F.col("best.rank")).alias("form_n")), "spelling-near")
    ends = roots(near.where("form is not null"))
    found = near.join(ends, "word", "left")
    return words.join(found, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


@REGISTRY.add()
def op13_variable_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))
