"""Jaccard self-join of shingle sets with signature trees.

Linked sets (J >= t) share a shingle among the first (1 - t) n of each in a common order;
looking ``SPARE`` n further, they share that many more. So sets with too few shared
prefix shingles are ruled out exactly, which leaves near copies and texts made of common
passages. What is left is split into candidate components, sets joined by equal minima in
one of many bands (see ``BANDS``); within one, a signature tree over the sets, with OR-combined bitmaps and size
ranges in its nodes, is traversed against itself, pruning node pairs by their largest
possible overlap, and what survives is verified on the sets themselves.

Equal sets are one node from the start. Only links that connect something are sought:
pairs already connected are passed over, so a dense group costs no pairs. A component
too large for one task is cut into size bands and parts of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.components import components, forest
from marquee.llm.families import links_within
from marquee.llm.filtering import if_small, keep_chosen, text_print
from marquee.llm.texts import documents, mix, shingle_sets, text_slices
from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: The threshold in hundredths, the share of n by which prefixes are lengthened.
PERCENT, SPARE = 75, 0.08
#: Bands and minima per band. A linked pair shares no band with a chance of at most
#: (1 - 0.75 ** ROWS) ** BANDS = 1e-9, about that of two sets having one name in a large corpus.
BANDS, ROWS = 106, 6
#: Prefix entries per bucket aimed at; shingles in one task's component or part at most.
BUCKET_ENTRIES, PART_SHINGLES = 500_000, 2_000_000
LEAF, FANOUT = 16, 8


def spare(n: np.ndarray) -> np.ndarray:
    """Shared prefix shingles asked of a set of n; grows with n."""
    return 1 + np.floor(SPARE * np.asarray(n)).astype(np.int64)


def prefix_length(n: int) -> int:
    least = -(-PERCENT * n // 100)
    return min(n, n - least + int(spare(n)))


def set_name(own: np.ndarray) -> int:
    """63 bits that name a set; the lowest bit is left free."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) & ~1


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 2 << 20):
        sets = shingle_sets(batch.column("text"))
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("print"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([set_name(s) if len(s) else None for s in sets], pa.int64())],
            ["doc_id", "print", "n_shingles", "node"])


def _prefixes(sets: list[np.ndarray], names: np.ndarray):
    """(shingle, node) entries sorted by both, each once."""
    taken = [s[:prefix_length(len(s))] for s in sets]
    shingles = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
    owner = np.repeat(names, [len(t) for t in taken])
    order = np.lexsort((owner, shingles))
    shingles, owner = shingles[order], owner[order]
    if len(shingles):
        fresh = np.ones(len(shingles), bool)
        fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
        shingles, owner = shingles[fresh], owner[fresh]
    return shingles, owner


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draws = np.random.default_rng(20240503).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64)
    return (draws[0] | np.uint64(1)).astype(np.uint32), draws[1].astype(np.uint32)


_FACTORS, _SHIFTS = _multipliers()


def band_keys(own: np.ndarray) -> np.ndarray:
    """One key per band: a hash of the band's minima over the set."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for begun in range(0, len(short), 1024):
        least = np.minimum(least, (short[begun:begun + 1024, None] * _FACTORS + _SHIFTS).min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T.astype(np.uint64):
        keys = mix(keys + np.uint64(0x9E3779B97F4A7C15) + column)
    return keys


def _banded(sets: list[np.ndarray], names: np.ndarray):
    """(band key, node) entries sorted by both."""
    keys = np.concatenate([band_keys(s) for s in sets]) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(names, BANDS)
    order = np.lexsort((owner, keys))
    return keys[order], owner[order]


def _runs(shingles: np.ndarray):
    """(first entry of each run of equal shingles, run lengths)."""
    first = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(shingles)))


_SHIPPED = "bucket int, shingles binary, nodes binary, left long, right long"


def _shipped(bits: int, counting: bool, shingled):
    """Entries of a slice, by bucket; a shingle met by several nodes goes on as one entry.

    ``counting``: besides, (node, how many of its entries are shared here); else edges
    (node, smallest node with that shingle).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20) if "text" in shingled else batches:
            if shingled == "text":
                sets = shingle_sets(batch.column("text"))
                names = np.array([set_name(s) for s in sets], np.int64)
            else:
                sets = [np.frombuffer(b, np.uint64) for b in batch.column("members").to_pylist()]
                names = batch.column("node").to_numpy()
            sets, names = [s for s in sets if len(s)], names[[len(s) > 0 for s in sets]]
            shingles, owner = (_prefixes if counting else _banded)(sets, names)
            first, length = _runs(shingles)
            shared = np.repeat(length > 1, length)
            if counting:
                left, right = np.unique(owner[shared], return_counts=True)
            else:
                left, right = forest(owner[shared], np.repeat(owner[first], length)[shared])
            kept = owner[first] | (length > 1)
            kept_shingles = shingles[first]
            bucket = (kept_shingles >> np.uint64(64 - bits)).astype(np.int64)
            begins, many = _runs(bucket)
            low = kept_shingles.view(np.uint8).reshape(-1, 8)[:, :7]
            yield pa.record_batch(
                [pa.array(np.concatenate([bucket[begins], left % (1 << bits)]).astype(np.int32)),
                 pa.array([low[a:a + n].tobytes() for a, n in zip(begins, many)] + [None] * len(left), pa.binary()),
                 pa.array([kept[a:a + n].tobytes() for a, n in zip(begins, many)] + [None] * len(left), pa.binary()),
                 pa.array([None] * len(begins) + left.tolist(), pa.int64()),
                 pa.array([None] * len(begins) + right.tolist(), pa.int64())],
                ["bucket", "shingles", "nodes", "left", "right"])
    return run


def _met(counting: bool):
    def run(table: pa.Table) -> pa.Table:
        low = b"".join(x for x in table.column("shingles").to_pylist() if x)
        low = np.frombuffer(low, np.uint8).reshape(-1, 7)
        shingles = np.zeros((len(low), 8), np.uint8)
        shingles[:, :7] = low
        shingles = shingles.view(np.uint64).ravel()
        nodes = np.frombuffer(b"".join(x for x in table.column("nodes").to_pylist() if x), np.int64)
        order = np.lexsort((nodes, shingles))
        shingles, marked = shingles[order], (nodes[order] & 1).astype(bool)
        nodes = nodes[order] & ~1
        first, length = _runs(shingles)
        if len(first):
            several = (np.minimum.reduceat(nodes, first) != np.maximum.reduceat(nodes, first))
            if counting:
                several |= np.logical_or.reduceat(marked, first)
            several = np.repeat(several, length)
            if counting:
                left, right = np.unique(nodes[several & ~marked], return_counts=True)
            else:
                left, right = forest(nodes[several], np.repeat(nodes[first], length)[several])
        else:
            left = right = np.zeros(0, np.int64)
        there = table.filter(table.column("left").is_valid())
        return pa.table({"left": pa.chunked_array([*there.column("left").chunks, pa.array(left, pa.int64())], pa.int64()),
                         "right": pa.chunked_array([*there.column("right").chunks, pa.array(right, pa.int64())], pa.int64())})
    return run


def _meetings(rows: DataFrame, bits: int, counting: bool, shingled: str) -> DataFrame:
    return (rows.mapInArrow(_shipped(bits, counting, shingled), _SHIPPED)
            .groupBy("bucket").applyInArrow(_met(counting), "left long, right long"))


class SignatureTree:
    """Levels of nodes over sets ordered by size; level 0 are the sets themselves.

    A node has the OR of its sets' bitmaps, their size range and the most shingles that any
    of them hides behind a shared bit.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        sizes = np.array([len(s) for s in sets])
        bits = 512
        while bits < 4 * sizes.max() and bits * len(sets) < 8 * (48 << 20):
            bits *= 2
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for i, own in enumerate(sets):
            at = (own % np.uint64(bits)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        hidden = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            maps, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(low, at),
                                np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))
            width = FANOUT

    def possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether nodes i and j may hold a linked pair, by sizes and the largest overlap."""
        maps, low, high, hidden = self.levels[level]
        fits = (100 * high[j] >= PERCENT * low[i]) & (100 * high[i] >= PERCENT * low[j])
        at = np.flatnonzero(fits)
        for begun in range(0, len(at), 2048):
            rows = at[begun:begun + 2048]
            a, b = i[rows], j[rows]
            overlap = np.bitwise_count(maps[a] & maps[b]).sum(1).astype(np.int64) + np.minimum(hidden[a], hidden[b])
            fits[rows] = (100 + PERCENT) * overlap >= PERCENT * (low[a] + low[b])
        return fits

    def children(self, level: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs a <= b of the children of node pairs i <= j."""
        width = LEAF if level == 1 else FANOUT
        below = len(self.levels[level - 1][1])
        step = np.arange(width)
        a = (i[:, None] * width + step)[:, :, None] + np.zeros(width, np.int64)
        b = (j[:, None] * width + step)[:, None, :] + np.zeros((width, 1), np.int64)
        a, b = a.ravel(), b.ravel()
        good = (a <= b) & (a < below) & (b < below)
        return a[good], b[good]


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def link_sets(names: list[int], sets: list[np.ndarray], labels: list[int]) -> list[tuple[int, int]]:
    """Edges that join all sets connected by links; sets of equal label are joined already."""
    order = sorted(range(len(names)), key=lambda k: (len(sets[k]), int(sets[k][0]), names[k]))
    names, sets = [names[k] for k in order], [sets[k] for k in order]
    _, label = np.unique(np.array([labels[k] for k in order]), return_inverse=True)
    if len(names) < 2:
        return []
    tree = SignatureTree(sets)
    level = len(tree.levels) - 1
    i = j = np.zeros(1, np.int64)
    while level > 1:
        i, j = tree.children(level, i, j)
        level -= 1
        good = tree.possible(level, i, j)
        i, j = i[good], j[good]
    near = np.argsort(j - i, kind="stable")
    i, j = i[near], j[near]
    edges = []
    at = np.arange(0, len(names), LEAF)
    for begun in range(0, len(i), 64):
        a, b = i[begun:begun + 64], j[begun:begun + 64]
        low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
        apart = (low[a] != high[a]) | (low[b] != high[b]) | (low[a] != low[b])
        if not apart.any():
            continue
        a, b = tree.children(1, a[apart], b[apart])
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        good = tree.possible(0, a, b)
        for x, y in zip(a[good].tolist(), b[good].tolist()):
            if label[x] != label[y] and linked(sets[x], sets[y]):
                edges.append((names[x], names[y]))
                label[label == label[y]] = label[x]
    return edges


def _verified(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """True links, enough to join what is connected. The sizes of linked sets are in one
    band or two neighbouring ones."""
    band = F.floor(F.log("n") / F.lit(np.log(100 / PERCENT))).cast("bigint")
    return links_within(sets, candidates, _link_members, band, PART_SHINGLES)


def _link_members(names: list[int], members: list[bytes], labels: list[int]) -> list[tuple[int, int]]:
    return link_sets(names, [np.frombuffer(m, np.uint64) for m in members], labels)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows link when 100 * intersection >= 75 * union of their sets of 5-word shingles (a
    shorter text is one shingle; a null or empty text has none and links with nothing);
    component_id is the smallest doc_id that links reach, the own one included. Null doc_ids
    never name a component unless it has no other (then null); repeated rows are repeated;
    other columns are ignored; an empty table gives no rows.
    """
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest doc_id; rows without
    shingles all stay."""
    rows = materialize(_classes(docs).where("class is not null"), "jaccard-classes")
    best = rows.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print")).alias("best"))
    keep = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.print") == F.col("print"))
    return keep_chosen(docs, rows.join(best, "class").select("doc_id", "print", keep.alias("keep")))


def _classes(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                         text_print().alias("print"))
    rows = materialize(narrow.mapInArrow(_named, "doc_id long, print long, n_shingles long, node long"), "jaccard-rows")
    nodes = (rows.where("node is not null").groupBy("node")
             .agg(F.min("doc_id").alias("least"), F.min(F.struct("print", "doc_id")).alias("one"), F.first("n_shingles").alias("n")))
    entries = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(24, max(8, int(entries * (1 - PERCENT / 100 + SPARE) / BUCKET_ENTRIES).bit_length()))
    shared = _meetings(narrow.select("text"), bits, True, "text")
    asked = F.lit(1) + F.floor(F.lit(SPARE) * F.ceil(F.col("n") * PERCENT / 100))
    kept = (shared.groupBy("left").agg(F.sum("right").alias("met")).withColumnRenamed("left", "node")
            .join(nodes, "node").where(F.col("met") >= asked)
            .select("node", F.col("one.print").alias("print"), F.col("one.doc_id").alias("doc_id")))
    kept = materialize(kept, "jaccard-kept")
    wanted = if_small(kept.select("doc_id", "print"))
    chosen = narrow.alias("d").join(wanted.alias("w"), F.col("d.print").eqNullSafe(F.col("w.print"))
                                    & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi")
    sets = materialize(chosen.select("text").mapInArrow(_full, "node long, n long, members binary"), "jaccard-sets")
    candidates = components(_meetings(sets, bits, False, "sets").select(F.col("left").alias("u"), F.col("right").alias("v")))
    joined = components(_verified(sets, candidates))
    least = joined.join(nodes.select("node", "least"), "node")
    named = least.join(least.groupBy("label").agg(F.min("least").alias("component")), "label").select("node", "component", "label")
    return (rows.join(nodes.select("node", "least"), "node", "left").join(named, "node", "left")
            .select("doc_id", "print", "n_shingles", F.coalesce("label", "node").alias("class"),
                    F.when(F.col("node").isNull(), F.col("doc_id"))
                    .otherwise(F.coalesce("component", "least")).alias("component_id")))


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = [s for s in shingle_sets(batch.column("text")) if len(s)]
        yield pa.record_batch([pa.array([set_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                               pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "n", "members"])


@REGISTRY.add()
def op10_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
