"""Near-equal lines by a segment-partition edit join.

A line of the shorter length is cut into threshold-plus-one segments; one of them occurs
unchanged, near its place, in any line within the threshold. So segments are indexed under
(length, segment number, bytes), and each line looks up its few substrings that may match,
for its own length and the lengths just below. Lines that meet are candidates; they are
verified by a banded bit-parallel edit distance. Distances count UTF-8 bytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.components import components, forest
from marquee.llm.families import links_within
from marquee.llm.filtering import if_small
from marquee.llm.texts import NEWLINE_FREE, buffer_of, documents, mix, span_hashes, spans, text_slices
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: Edit distance within which lines are near-equal; shorter lines are left alone.
THRESHOLD, LEAST_BYTES = 2, 20
BITS, PART_BYTES = 8, 16 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def segment(length, i: int):
    """(start, size) of segment i of a line (or of many lines): the first ones are a byte shorter."""
    many = THRESHOLD + 1
    size, longer = length // many, length % many
    short = many - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def window(length, d: int, i: int):
    """(first start, last start, size) of what a line looks up for segment i of lines d bytes shorter.

    Segment i (from 0) can have moved by at most i places to either side, and the rest behind
    it by at most the threshold less i.
    """
    at, size = segment(length - d, i)
    low = np.maximum(np.maximum(at - i, at + d - (THRESHOLD - i)), 0)
    return low, np.minimum(np.minimum(at + i, at + d + (THRESHOLD - i)), length - size), size


def lookups(length: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings a line looks up."""
    found = []
    for d in range(min(THRESHOLD, length - LEAST_BYTES) + 1):
        for i in range(THRESHOLD + 1):
            low, high, size = (int(x) for x in window(length, d, i))
            found += [(length - d, i, start, size) for start in range(low, high + 1)]
    return found


def within(a: bytes, b: bytes) -> bool:
    """Whether the edit distance of a and b is at most THRESHOLD.

    Equal ends are trimmed. Of the rest, bit i of ``near[e]`` says that the first i bytes of
    a are within e edits of the bytes of b so far; one byte of b updates all bits at once,
    and only the band of THRESHOLD diagonals to either side is held.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > THRESHOLD:
        return False
    n, first = len(a), 0
    while first < n and a[first] == b[first]:
        first += 1
    last = 0
    while last < n - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first:len(a) - last], b[first:len(b) - last]
    if not a:
        return len(b) <= THRESHOLD
    places: defaultdict[int, int] = defaultdict(int)
    for i, c in enumerate(a):
        places[c] |= 1 << i
    near = [(2 << e) - 1 for e in range(THRESHOLD + 1)]
    band = (1 << (2 * THRESHOLD + 1)) - 1
    for j, c in enumerate(b, 1):
        match = places.get(c, 0)
        held = band << (j - THRESHOLD) if j >= THRESHOLD else band >> (THRESHOLD - j)
        before = above = 0
        for e in range(THRESHOLD + 1):
            old = near[e]
            near[e] = (((old & match) << 1) | before | (before << 1) | (above << 1)) & held
            before, above = old, near[e]
        if not near[-1]:
            return False
    return bool(near[-1] >> len(a) & 1)


def link_lines(names: list[int], lines: list[bytes], labels: list[int]) -> list[tuple[int, int]]:
    """Edges that join all lines connected by near-equality; equal labels are joined already."""
    order = sorted(range(len(names)), key=lambda k: (len(lines[k]), lines[k]))
    index: defaultdict[tuple, list[int]] = defaultdict(list)
    label, edges = dict(enumerate(labels)), []
    members = defaultdict(list)
    for k, own in label.items():
        members[own].append(k)
    plans: dict[int, list] = {}
    for k in order:
        line = lines[k]
        plan = plans.setdefault(len(line), lookups(len(line)))
        tried = set()
        for length, i, start, size in plan:
            for other in index.get((length, i, line[start:start + size]), ()):
                if label[other] != label[k] and other not in tried:
                    tried.add(other)
                    if within(lines[other], line):
                        edges.append((names[other], names[k]))
                        gone, kept = sorted((label[other], label[k]), key=lambda x: len(members[x]))
                        for member in members[gone]:
                            label[member] = kept
                        members[kept] += members.pop(gone)
        for i in range(THRESHOLD + 1):
            at, size = map(int, segment(len(line), i))
            index[len(line), i, line[at:at + size]].append(k)
    return edges


def _lines(batch: pa.RecordBatch):
    """(bytes, starts, ends, row, name of each line) of the lines of all texts."""
    data, offsets = buffer_of(batch.column("text"))
    starts, ends, row = spans(data, offsets, NEWLINE_FREE)
    names = span_hashes(data, starts, ends, fold_case=False) & ~np.uint64(1)
    return data, starts, ends, row, names.view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        _, starts, ends, row, names = _lines(batch)
        first = np.searchsorted(row, np.arange(len(batch)))
        place = np.arange(len(row)) - first[row]
        # one row for each document, whatever it holds, and one for each line that is long enough
        long = np.flatnonzero(ends - starts >= LEAST_BYTES)
        counts = np.bincount(row, minlength=len(batch))
        docs = batch.column("doc_id")
        yield pa.record_batch(
            [pa.concat_arrays([batch.column("name"), batch.column("name").take(pa.array(row[long]))]),
             pa.concat_arrays([docs, docs.take(pa.array(row[long]))]),
             pa.array([*counts.tolist(), *[None] * len(long)], pa.int64()),
             pa.array([None] * len(batch) + place[long].tolist(), pa.int32()),
             pa.array([None] * len(batch) + names[long].tolist(), pa.int64())],
            ["name", "doc_id", "n_lines", "line", "node"])


def _entries(data, starts, ends, names):
    """(key, line, indexed) entries of the given lines, sorted; key is a hash."""
    powers = np.full(len(data), _BASE, np.uint64)
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    values = mix(data.astype(np.uint64) + np.uint64(1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)])
    powers[:] = _INVERSE
    powers[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    keys, owners, kinds = [], [], []
    lengths = ends - starts

    def add(rows, at, size, known, i, indexed):
        at = starts[rows] + at
        text = (sums[at + size] - sums[at]) * powers[at]
        keys.append(mix(mix(text) + (known * (THRESHOLD + 1) + i).astype(np.uint64)))
        owners.append(names[rows])
        kinds.append(np.full(len(rows), indexed))

    every = np.arange(len(starts))
    for i in range(THRESHOLD + 1):
        add(every, *segment(lengths, i), lengths, i, True)
        for d in range(THRESHOLD + 1):
            low, high, size = window(lengths, d, i)
            for step in range(2 * THRESHOLD + 1):
                rows = np.flatnonzero((low + step <= high) & (lengths - d >= LEAST_BYTES))
                if len(rows):
                    add(rows, low[rows] + step, size[rows], lengths[rows] - d, i, False)
    keys, owners, kinds = np.concatenate(keys), np.concatenate(owners), np.concatenate(kinds)
    order = np.lexsort((~kinds, owners, keys))
    keys, owners, kinds = keys[order], owners[order], kinds[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
    return keys[fresh], owners[fresh], kinds[fresh]  # a line's index entry comes before its lookup


def _star(keys: np.ndarray, owners: np.ndarray, indexed: np.ndarray):
    """(left, right, which entries to keep): under each key all lines join one indexed line."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(keys)))
    none = np.int64(np.iinfo(np.int64).max)
    centre = np.minimum.reduceat(np.where(indexed, owners, none), first) if len(first) else np.zeros(0, np.int64)
    centres = np.repeat(centre, length)
    joined = (centres != none) & (centres != owners)
    left, right = forest(owners[joined], centres[joined])
    return left, right, (centres == none) | (indexed & (centres == owners))


_SHIPPED = "bucket int, keys binary, lines binary, left long, right long"


def _shipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 2 << 20):
        data, starts, ends, _, names = _lines(batch)
        _, one = np.unique(names, return_index=True)
        one = one[(ends - starts)[one] >= LEAST_BYTES]
        if not len(one):
            continue
        keys, owners, indexed = _entries(data, starts[one], ends[one], names[one])
        left, right, kept = _star(keys, owners, indexed)
        keys, marked = keys[kept], owners[kept] | indexed[kept]
        bucket = (keys >> np.uint64(64 - BITS)).astype(np.int32)
        cuts = np.searchsorted(bucket, np.arange((1 << BITS) + 1))
        there = np.flatnonzero(np.diff(cuts))
        yield pa.record_batch(
            [pa.array(np.concatenate([there, left % (1 << BITS)]).astype(np.int32)),
             pa.array([keys[cuts[k]:cuts[k + 1]].tobytes() for k in there] + [None] * len(left), pa.binary()),
             pa.array([marked[cuts[k]:cuts[k + 1]].tobytes() for k in there] + [None] * len(left), pa.binary()),
             pa.array([None] * len(there) + left.tolist(), pa.int64()),
             pa.array([None] * len(there) + right.tolist(), pa.int64())],
            ["bucket", "keys", "lines", "left", "right"])


def _met(table: pa.Table) -> pa.Table:
    keys = np.frombuffer(b"".join(x for x in table.column("keys").to_pylist() if x), np.uint64)
    marked = np.frombuffer(b"".join(x for x in table.column("lines").to_pylist() if x), np.int64)
    order = np.argsort(keys, kind="stable")
    left, right, _ = _star(keys[order], marked[order] & ~1, (marked[order] & 1).astype(bool))
    there = table.filter(table.column("left").is_valid())
    return pa.table({"left": pa.chunked_array([*there.column("left").chunks, pa.array(left, pa.int64())], pa.int64()),
                     "right": pa.chunked_array([*there.column("right").chunks, pa.array(right, pa.int64())], pa.int64())})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each slice's distinct lines of at least LEAST_BYTES."""
    for batch in text_slices(batches):
        data, starts, ends, _, names = _lines(batch)
        _, one = np.unique(names, return_index=True)
        one = one[(ends - starts)[one] >= LEAST_BYTES]
        whole = data.tobytes()
        yield pa.record_batch([pa.array(names[one]), pa.array((ends - starts)[one], pa.int64()),
                               pa.array([whole[a:b] for a, b in zip(starts[one], ends[one])], pa.binary())],
                              ["node", "n", "members"])


def near_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped (line numbers from 0, ascending) of every row.

    Lines are the non-empty runs between line feeds. Those of at least 20 bytes whose edit
    distance is at most 2, directly or by way of others, are one class; its first line, by
    doc_id (nulls last) and place, stays, and the rest is dropped. Shorter lines stay. A null
    or empty text has no lines; repeated rows are repeated, one of them being the first;
    other columns are ignored; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                         F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id()).alias("name"))
    rows = materialize(narrow.mapInArrow(_occurrences, "name string, doc_id long, n_lines long, line int, node long"),
                       "line-rows")
    met = narrow.select("text").mapInArrow(_shipped, _SHIPPED).groupBy("bucket").applyInArrow(_met, "left long, right long")
    candidates = materialize(components(met.select(F.col("left").alias("u"), F.col("right").alias("v"))), "line-families")
    wanted = if_small(candidates.select("node").distinct())
    texts = narrow.select("text").mapInArrow(_texts, "node long, n long, members binary").join(wanted, "node", "left_semi")
    texts = materialize(texts.groupBy("node").agg(F.first("n").alias("n"), F.first("members").alias("members")), "line-texts")
    band = F.floor(F.col("n") / (THRESHOLD + 1)).cast("bigint")
    classes = components(links_within(texts, candidates, link_lines, band, PART_BYTES))
    lines = rows.where("node is not null").join(classes, "node", "left").withColumn("class", F.coalesce("label", "node"))
    lines = materialize(lines.select("class", "name", "doc_id", "line"), "line-classes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "line")
    first = lines.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = (lines.join(first, "class").where((F.col("name") != F.col("first.name")) | (F.col("line") != F.col("first.line")))
               .groupBy("name").agg(F.sort_array(F.collect_list("line")).alias("dropped")))
    return (rows.where("n_lines is not null").join(dropped, "name", "left")
            .select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
                    F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")))


@REGISTRY.add()
def op9_edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(documents(spark, sf_dir))
