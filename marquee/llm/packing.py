"""Best-two-fit packing of tokenised documents into sequences of fixed length.

Only lengths matter to the packing, and there are at most ``capacity`` of them. So the
documents are counted by length, and the packing is worked out on these counts: each
kind of bin is filled greedily, largest first; then its smallest document is replaced by
two unpacked ones that fit the widened gap more tightly. A kind of bin is repeated for
as long as its lengths last, so the plan has some thousand lines at any corpus size.
Documents find their place in it by their rank among those of equal length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.bpe import WordBpe
from marquee.llm.texts import documents, give_back, text_slices
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY, END_ID = 1024, 2
#: A length's ranks are dealt over this many parts, so that no length is one task.
PARTS = 128
_RARE = regex.compile("[^\\x00-\u052f\u1e00-\u2bff\u3000-\u9fef\uac00-\ud7a3\U0001f000-\U0001faff]")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


class TextIds:
    """Ids of texts: distinct words once, texts of rare characters by the library.

    The library's Unicode tables may be of another year than ours; in the blocks left to
    us, letters and digits have been settled for long.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.bpe = WordBpe(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        rare = [not t.isascii() and _RARE.search(t) is not None or _SEPARATORS.search(t) is not None for t in texts]
        ours = iter(self.bpe.encode([t for t, r in zip(texts, rare) if not r]))
        theirs = iter(self.library.encode_batch_fast([t for t, r in zip(texts, rare) if r], add_special_tokens=False))
        return [array("I", next(theirs).ids).tobytes() if r else b"".join(next(ours)) for r in rare]


@lru_cache(maxsize=2)
def _encoder(path: str) -> TextIds:
    return TextIds(path)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int, end_id: int, forget: bool):
    tail = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in text_slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                encoder.encode([t or "" for t in batch.column("text").to_pylist()])):
                ids += tail
                n = len(ids) // 4
                at, size, piece = 0, n % capacity or capacity, 0
                while at < n:
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            del encoder
            _encoder.cache_clear()
            give_back()
    return run


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, bins)]: pattern is [(length, how many)], repeated in so many bins.

    ``counts[l]`` documents have length l, 1 <= l <= capacity; all of them are packed.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan = []
    while left.any():
        used = np.zeros_like(left)
        room = capacity
        while room and len(fits := np.flatnonzero(left[:room + 1] > used[:room + 1])):
            size = int(fits[-1])
            take = min(room // size, int(left[size] - used[size]))
            used[size] += take
            room -= take * size
        if room:
            smallest = int(np.flatnonzero(used)[0])
            gap = room + smallest
            free = np.flatnonzero(left[:gap + 1] > used[:gap + 1])
            if len(free):
                twice = left[free] - used[free] >= 2
                # for each first document the longest second one that still fits
                at = np.searchsorted(free, gap - free, "right") - 1
                at = np.where((at >= 0) & (free[at] == free) & ~twice, at - 1, at)
                total = np.where(at >= 0, free + free[at], 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    used[smallest] -= 1
                    used[free[best]] += 1
                    used[free[at[best]]] += 1
        sizes = np.flatnonzero(used)
        bins = int((left[sizes] // used[sizes]).min())
        left[sizes] -= bins * used[sizes]
        plan.append(([(int(s), int(used[s])) for s in sizes[::-1]], bins))
    return plan


def _places(plan, capacity: int):
    """Arrays over (length, first rank): key, how many per bin, first bin, first offset."""
    next_rank = np.zeros(capacity + 1, np.int64)
    rows, first_bin = [], 0
    for pattern, bins in plan:
        offset = 0
        for size, many in pattern:
            rows.append((size, next_rank[size], many, first_bin, offset))
            next_rank[size] += many * bins
            offset += many * size
        first_bin += bins
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return (table[:, 0] << 48) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, many, bins, offsets = places
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            within = rank - ranks[row]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*columns, pa.array(bins[row] + within // many[row]),
                 pa.array(offsets[row] + within % many[row] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, *, path: str = VOCABULARY, capacity: int = CAPACITY,
         end_id: int = END_ID, forget: bool = False) -> DataFrame:
    """Pack whole documents, each followed by ``end_id``, into sequences of ``capacity`` tokens.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    document of more than ``capacity`` tokens is cut into full pieces, the first of which
    may be shorter; others are one piece. A null or empty text is the end mark alone; null
    doc_ids stay null; repeated rows are packed as often as they occur; other columns are
    ignored; an empty table gives no rows. With ``forget`` a worker drops its vocabulary and
    remembered words after each task: slower, but they don't stay beside what it does next.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = narrow.mapInArrow(_pieces(path, capacity, end_id, forget), _PIECES)
    pieces = materialize(pieces.withColumn("part", F.expr(
        f"cast(pmod(xxhash64(doc_id, start, ids_crc32), {PARTS}) as int)")), "pack-pieces")
    # At most capacity * PARTS rows: a proven bound for what is broadcast and collected.
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = counts.select("length", "part", (F.sum("n").over(
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("n")).alias("before"))
    histogram = np.zeros(capacity + 1, np.int64)
    for size, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[size] = n
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (pieces.withColumn("within", F.row_number().over(order) - 1)
              .join(F.broadcast(before), ["length", "part"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("before") + F.col("within")).alias("rank")))
    return ranked.mapInArrow(_placed(_places(plan_bins(histogram, capacity), capacity)),
                             _PIECES + ", sequence_id bigint, offset bigint")


@REGISTRY.add()
def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
