"""SentencePiece encoding and decoding for vocabularies of the merge type.

A text's symbols are its characters. Every adjacent pair whose concatenation is a piece
stands on an agenda ordered by the piece's score, leftmost first among equals; the best
pair is taken off and merged, and the pairs it makes with its neighbours are put on, until
the agenda is empty. Short stretches keep their agendas side by side in one array and take
off their best pairs in step; long ones have a heap each. As no piece has a word mark behind another character, a text falls
into stretches that never merge with each other; a bounded table in each worker remembers
the stretches seen so far. What comes out is checked against the sentencepiece library,
a whole Arrow batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from marquee.llm.texts import documents, text_slices
from marquee.plans.registry import Registry

REGISTRY = Registry()
VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Stretches that a worker remembers before it starts anew.
MOST_STRETCHES = 400_000
#: Longer stretches have a heap of their own, so that cost stays near linear.
SHORT = 64
MARK = "▁"
_NONE = np.int64((1 << 31) - 1)
# The kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_PIECES, _PLACES = (1 << 20) - 1, (1 << 40) - 1


class PieceBpe:
    """Encoder and decoder for one model file of merge type with the identity normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if trainer.model_type != trainer.BPE or trainer.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only merge-type vocabularies with the word mark in front")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError(f"{path}: only the identity normaliser that keeps blanks")
        if kinds & {USER_DEFINED, UNUSED}:
            raise ValueError(f"{path}: user-defined and unused pieces aren't handled")
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.prefix, self.byte_fallback = normal.add_dummy_prefix, trainer.byte_fallback
        self.unknown, self.unknown_text = self.kinds.index(UNKNOWN), trainer.unk_surface
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        ranks = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Symbols are numbered: pieces by their id, other characters of pieces behind them.
        self.symbols = dict(ids)
        for piece in ids:
            for letter in piece:
                self.symbols.setdefault(letter, len(self.pieces) + len(self.symbols))
        #: left symbol, right symbol -> rank of the piece's score and the piece, as one number each.
        self.joins: dict[int, int] = {}
        for piece in ids:
            for cut in range(1, len(piece)):
                left, right = self.symbols.get(piece[:cut]), self.symbols.get(piece[cut:])
                if left is not None and right is not None:
                    self.joins[left << 20 | right] = ranks[scores[piece]] << 60 | ids[piece]
        keys = np.array(sorted(self.joins), np.int64)
        values = [self.joins[k] for k in keys.tolist()]
        self.keys, self.ranks = keys, np.array([v >> 60 for v in values], np.int64)
        self.made = np.array([v & _PIECES for v in values], np.int32)
        self.letters = np.full(0x110000, -1, np.int32)
        for symbol, number in self.symbols.items():
            if len(symbol) == 1:
                self.letters[ord(symbol)] = number
        self.surfaces = [p.replace(MARK, " ") if k == NORMAL else None for p, k in zip(self.pieces, self.kinds)]
        apart = not any(MARK in piece.lstrip(MARK) for piece in ids)
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else r"(?s:.+)")
        #: stretch -> (ids as decimals, decoded text, ids, whether the library agrees)
        self.known: dict[str, tuple[bytes, bytes, tuple[int, ...], bool]] = {}

    def merge_all(self, stretches: list[str]) -> list[tuple[int, ...]]:
        """The ids of each stretch; all agendas are one array of entries, rank over place."""
        out: list = [None] * len(stretches)
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
        own = self.letters[points]
        own = np.where(own < 0, -3 - points.astype(np.int32), own)  # characters of no piece, which never merge
        who = np.repeat(np.arange(len(stretches)), [len(s) for s in stretches])
        ranks = np.full(len(own), _NONE)
        made = np.zeros(len(own), np.int32)

        def put(at):
            """Enter the pairs that begin at these places."""
            at = at[at + 1 < len(own)]
            left, right = own[at], own[at + 1]
            keys = (left.astype(np.int64) << 20) | right
            found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            good = (self.keys[found] == keys) & (left >= 0) & (right >= 0) & (who[at] == who[at + 1])
            ranks[at] = np.where(good, self.ranks[found], _NONE)
            made[at] = self.made[found]

        put(np.arange(len(own)))
        while len(own):
            begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(own)), begins)
            ended = best >> 32 == _NONE
            if ended.any():
                bounds = np.append(begins, len(own))
                values, names = own.tolist(), who[begins]
                for k in np.flatnonzero(ended).tolist():
                    out[names[k]] = tuple(values[bounds[k]:bounds[k + 1]])
            at = best[~ended] & 0xFFFFFFFF
            own[at] = made[at]
            kept = np.repeat(~ended, np.diff(np.append(begins, len(own))))
            moved = np.cumsum(kept) - 1
            kept[at + 1] = False
            ranks[at] = _NONE
            at = moved[at] - np.arange(len(at))
            own, who, ranks, made = own[kept], who[kept], ranks[kept], made[kept]
            put(at)
            put(at[at > 0] - 1)
        most = len(self.pieces)
        for k, ids in enumerate(out):
            if max(ids) >= most or (min(ids) < 0 and not self.byte_fallback):
                out[k] = self.merge(stretches[k])
            elif min(ids) < 0:
                out[k] = tuple([i for n in ids for i in ((n,) if n >= 0 else self._as_bytes(chr(-3 - n)))])
        return out

    def _as_bytes(self, letter: str) -> list[int]:
        return [self.bytes[b] for b in letter.encode()]

    def merge(self, stretch: str) -> tuple[int, ...]:
        """The ids of a stretch, with a heap as agenda.

        An agenda entry is the pair's rank, its place and its piece, as one number. An entry
        whose pair has changed since no longer matches and is passed over.
        """
        symbols, join = self.symbols, self.joins.get
        own = [symbols.get(c, -1) for c in stretch]
        own.append(-1)  # stands behind the last symbol and before the first
        end = len(own) - 1
        agenda = []
        for at, left in enumerate(own[:-1]):
            found = join(left << 20 | own[at + 1])
            if found is not None:
                agenda.append(found + (at << 20))
        if agenda:
            heapify(agenda)
            after, before = list(range(1, end + 2)), list(range(-1, end))
            while agenda:
                best = heappop(agenda)
                at = best >> 20 & _PLACES
                behind = after[at]
                if join(own[at] << 20 | own[behind]) != best - (at << 20):
                    continue
                left = own[at] = best & _PIECES
                own[behind] = -2
                after[at] = further = after[behind]
                before[further] = at
                if (found := join(left << 20 | own[further])) is not None:
                    heappush(agenda, found + (at << 20))
                ahead = before[at]
                if (found := join(own[ahead] << 20 | left)) is not None:
                    heappush(agenda, found + (ahead << 20))
        most, out = len(self.pieces), []
        for at, symbol in enumerate(own[:-1]):
            if 0 <= symbol < most:
                out.append(symbol)
            elif symbol == -2:
                continue
            elif self.byte_fallback:
                out += self._as_bytes(stretch[at])
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return tuple(out)

    def normal_text(self, text: str) -> str:
        """Blanks as word marks, one put in front of a text that isn't empty."""
        marked = text.replace(" ", MARK)
        return MARK + marked if self.prefix and marked else marked

    def parts(self, texts: list[str], library: SentencePieceProcessor | None = None) -> list[list[tuple]]:
        """What is known of each stretch of each text, in order; new ones are compared with the library."""
        if len(self.known) > MOST_STRETCHES:
            self.known.clear()
        found = [self.stretches.findall(self.normal_text(text)) for text in texts]
        known = self.known
        new = list(set().union(*found).difference(known))
        new.sort(key=len)
        short = bisect_right(new, SHORT, key=len)
        own = self.merge_all(new[:short]) + [self.merge(s) for s in new[short:]]
        same = [True] * len(new)
        if library is not None:
            theirs = library.encode([s[self.prefix:].replace(MARK, " ") for s in new], num_threads=1)
            # A mark alone is what the library puts in front of nothing; it has the piece, but no text for it.
            theirs = [[library.piece_to_id(MARK)] if self.prefix and s == MARK else ids for s, ids in zip(new, theirs)]
            same = [ids == tuple(other) for ids, other in zip(own, theirs)]
        for stretch, ids, agrees in zip(new, own, same):
            known[stretch] = (",".join(map(str, ids)).encode(), self._surface(ids).encode(), ids, agrees)
        return [list(map(known.__getitem__, own)) for own in found]

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts([text])[0] for i in part[2]]

    def _surface(self, ids) -> str:
        """Pieces joined, marks as blanks; runs of byte pieces are UTF-8, each bad byte U+FFFD."""
        try:
            return "".join([self.surfaces[i] for i in ids])
        except TypeError:  # some are special
            pass
        out, held = [], bytearray()

        def flush():
            text = held
            while text:
                try:
                    out.append(text.decode())
                    break
                except UnicodeDecodeError as bad:
                    out.append(text[:bad.start].decode() + "�")
                    text = text[bad.start + 1:]
            held.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.pieces[i][3:5], 16))
                continue
            if held:
                flush()
            if kind == UNKNOWN:
                out.append(self.unknown_text)
            elif kind != CONTROL:
                out.append(self.pieces[i].replace(MARK, " "))
        if held:
            flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the blank that encoding puts in front is taken off again."""
        text = self._surface(ids)
        first = next((i for i in ids if self.kinds[i] != CONTROL), None)
        marked = first is not None and self.kinds[first] == NORMAL and self.pieces[first].startswith(MARK)
        return text[1:] if self.prefix and marked else text


@lru_cache(maxsize=2)
def _bpe(path: str) -> PieceBpe:
    return PieceBpe(path)


@lru_cache(maxsize=2)
def _library(path: str) -> SentencePieceProcessor:
    return SentencePieceProcessor(model_file=path)


def _digests(path: str, check: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "library_agrees"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, library = _bpe(path), _library(path) if check else None
        for batch in text_slices(batches):
            counts, shas, decoded, agrees = [], [], [], []
            for parts in bpe.parts([t or "" for t in batch.column("text").to_pylist()], library):
                decimals, texts, ids, same = zip(*parts) if parts else ((), (), (), ())
                counts.append(sum(map(len, ids)))
                shas.append(hashlib.sha256(b",".join(decimals)).hexdigest())
                surface = b"".join(texts)
                decoded.append(hashlib.sha256(surface[1:] if bpe.prefix else surface).hexdigest())
                agrees.append(all(same) if check else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                                   pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names)
    return run


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_digests(docs: DataFrame, *, path: str = VOCABULARY, check: bool = True) -> DataFrame:
    """Encode and decode each whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, library_agrees.

    The last says whether the sentencepiece library gives the same ids (null without ``check``):
    it encodes what the agenda met for the first time, a whole batch at once.
    One row per input row, without a shuffle. A null or empty text has no tokens; a null doc_id
    stays null; repeated rows are repeated; other columns are ignored.
    """
    return _narrow(docs).mapInArrow(_digests(path, check), "doc_id bigint, n_tokens bigint, ids_sha256 string, "
                                                           "decoded_sha256 string, library_agrees boolean")


def encode(docs: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the ids of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in text_slices(batches):
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    return _narrow(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, path: str = VOCABULARY) -> DataFrame:
    """doc_id and the text of each row's ``ids`` (null: empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


@REGISTRY.add()
def op12_pair_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
