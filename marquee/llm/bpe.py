"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word's state is the row of its parts and, beside it, the merge rank of each adjacent
pair of parts. The smallest rank is found by scanning, its inner boundary is deleted,
and the two neighbouring ranks are looked up anew. Words are short, so a scan of a small
contiguous row beats any tree; and many words are rows of one array, merged in step. A bounded table
in each worker remembers the words seen so far.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm.texts import documents, text_slices
from marquee.plans.registry import Registry

REGISTRY = Registry()
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Words that a worker remembers before it starts anew.
MOST_WORDS = 300_000
#: Longer words keep their ranks in a heap, so that cost stays near linear.
SHORT_WORD = 200
_NONE = np.int32((1 << 31) - 1)


#: Characters outside blocks whose letters and cases have been settled for long.
UNSETTLED = regex.compile("[^\\x00-\u052f\u1e00-\u2070\u20a0-\u2bff\u3000-\u9fef\uac00-\ud7a3\U0001f000-\U0001faff]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(0x100 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


#: Fixed value: how byte-level vocabularies without a pattern of their own split text.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ascii_pattern(pattern: str) -> re.Pattern:
    """``pattern`` for ASCII texts, which the standard engine reads twice as fast."""
    for name, own in ((r"\p{L}", "A-Za-z"), (r"\p{N}", "0-9")):
        pattern = pattern.replace(f"[{name}]", f"[{own}]").replace(f" ?{name}", f" ?[{own}]").replace(name, own)
    return re.compile(pattern, re.ASCII)


class WordBpe:
    """Encoder for a byte-level vocabulary file, and decoder for one with word-end marks.

    Where the file asks for it, normalisation is NFC, then lower case character by
    character; ``split`` finds words; added tokens are matched in the raw text first.
    ``decode`` joins tokens by a blank, as a vocabulary without decoder does.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {number: token for token, number in (ids | self.added).items()}
        self.folds = spec["normalizer"] is not None
        steps = spec["pre_tokenizer"].get("pretokenizers")
        pattern = steps[0]["pattern"]["Regex"] if steps else BYTE_LEVEL_SPLIT
        self.split, self.split_ascii = regex.compile(pattern), ascii_pattern(pattern)
        self.find_added = regex.compile("|".join(map(regex.escape, self.added)) or r"(?!)")
        letters = byte_letters()
        self.path, self.byte_of = path, {c: b for b, c in enumerate(letters)}
        #: The id of each byte within a word, and as its last byte.
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        keys = np.array([(ids[a] << 20) + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.words: dict[str, bytes] = {}
        self.marks = {f"\0 {number}": struct.pack("<I", number) for number in self.added.values()}
        self.texts = _WordTexts(self)

    @cached_property
    def _rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.key_ranks.tolist()))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, _NONE where they don't merge."""
        keys = (left.astype(np.int64) << 20) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word. Words of like length share one array, a row each."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        order = np.argsort(sizes, kind="stable")
        begun = 0
        while begun < len(order):
            width = int(sizes[order[begun]])
            widest = max(8, width + width // 4)
            until = min(int(np.searchsorted(sizes[order], widest, "right")), begun + max(1, 400_000 // widest))
            chosen = order[begun:until]
            if width > SHORT_WORD:
                for k in chosen:
                    out[k] = self._long_word(words[k])
            else:
                self._short_words(words, chosen, sizes[chosen], out)
            begun = until
        return out

    def _short_words(self, words, chosen, sizes, out) -> None:
        """Boundaries and ranks of many words at once; every pass merges one pair per word."""
        width = int(sizes[-1])
        letters = np.frombuffer(b"".join(words[k].ljust(width, b"\0") for k in chosen), np.uint8)
        parts = self.inner[letters].reshape(-1, width)
        columns = np.arange(width)
        rows = np.arange(len(chosen))
        parts[rows, sizes - 1] = self.last[letters.reshape(-1, width)[rows, sizes - 1]]
        parts[columns >= sizes[:, None]] = -1
        left = sizes.copy()
        ranks = np.full((len(chosen), width + 1), _NONE, np.int32)
        ranks[:, :width - 1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        done: list = [None] * len(chosen)
        while len(rows):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            if (ended := least == _NONE).any():
                for k, n, ids in zip(rows[ended].tolist(), left[ended].tolist(), parts[ended]):
                    done[k] = ids[:n].tobytes()
                going = ~ended
                rows, parts, ranks, left, at, least = (x[going] for x in (rows, parts, ranks, left, at, least))
                if not len(rows):
                    break
            every = np.arange(len(rows))
            parts[every, at] = self.merged[least]
            # Delete the boundary behind part ``at``: later parts and ranks move up.
            moved = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, moved, 1)
            left = left - 1
            parts[every, left] = -1
            ranks[:, :width] = np.take_along_axis(ranks, columns + (columns >= at[:, None]), 1)
            after = np.where(at + 1 < left, parts[every, np.minimum(at + 1, width - 1)], -1)
            ranks[every, at] = self.pair_ranks(parts[every, at], after)
            before = np.maximum(at - 1, 0)
            fresh = self.pair_ranks(parts[every, before], parts[every, at])
            ranks[every, before] = np.where(at > 0, fresh, ranks[every, before])
        for k, ids in zip(chosen.tolist(), done):
            out[k] = ids

    def _long_word(self, word: bytes) -> bytes:
        """The same merges in the same order, with the ranks of one word in a heap."""
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank_of = self._rank_of
        heap = []

        def push(a):
            b = after[a]
            if b >= 0 and (rank := rank_of.get((ids[a] << 20) + ids[b])) is not None:
                heapq.heappush(heap, (rank, a, ids[a], ids[b]))

        for a in range(len(ids)):
            push(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if ids[a] != left or b < 0 or ids[b] != right:
                continue
            ids[a], ids[b] = int(self.merged[rank]), -1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        return np.array([i for i in ids if i >= 0], "<i4").tobytes()

    def split_words(self, text: str) -> list[str]:
        """The words of a text; an added token is NUL, blank and its id, which no word is."""
        if "<|" not in text:
            return self._plain_words(text)
        words, at = [], 0
        for found in self.find_added.finditer(text):
            words += self._plain_words(text[at:found.start()])
            words.append(f"\0 {self.added[found[0]]}")
            at = found.end()
        return words + self._plain_words(text[at:])

    @cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def _unsettled_words(self, text: str) -> list[str]:
        """Words by the library's own normaliser and splitter: its tables of letters and of
        their cases may be of another year than ours. Merging stays ours."""
        if self.folds:
            text = self.library.normalizer.normalize_str(text)
        byte_of = self.byte_of
        return [bytes([byte_of[c] for c in word]).decode() for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower() if self.folds else text)
        if UNSETTLED.search(text):
            return self._unsettled_words(text)
        if self.folds:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return self.split.findall("".join([c.lower() for c in text]))
            text = text.lower()
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[list[bytes]]:
        """Per text the packed ids of its words."""
        split = [self.split_words(t) for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words.clear()
            self.texts.clear()
        self.words.update(self.marks)
        new = list(set().union(*split).difference(self.words))
        self.words.update(zip(new, self.encode_words([w.encode() for w in new])))
        return [list(map(self.words.__getitem__, own)) for own in split]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.tokens[i] for i in ids])


class _WordTexts(dict):
    """Ids as little-endian 32-bit integers -> their decoded text in UTF-8."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe = bpe

    def __missing__(self, packed: bytes) -> bytes:
        self[packed] = text = self.bpe.decode(struct.unpack(f"<{len(packed) // 4}I", packed)).encode()
        return text


@lru_cache(maxsize=2)
def _bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in text_slices(batches):
            words = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            ids = [b"".join(own) for own in words]
            texts = [b" ".join(map(bpe.texts.__getitem__, own)) for own in words]
            yield pa.record_batch([
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One row per input row, without a shuffle. A null or empty text has no tokens; a null
    doc_id stays null; repeated rows are repeated; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_digests(path), "doc_id bigint, n_tokens bigint, ids_sha256 string, "
                                             "decoded_sha256 string")


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in text_slices(batches):
            words = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            ids = [np.frombuffer(b"".join(own), "<i4") for own in words]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return run


def encode(docs: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the ids of each whole text."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_encode(path), "doc_id bigint, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode(encoded: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text of each row's ``ids`` (null: empty)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id bigint, text string")


@REGISTRY.add()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
