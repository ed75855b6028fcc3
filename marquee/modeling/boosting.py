"""Rounds of boosted trees: histograms are summed in the tasks, splits are chosen on the driver.

The rows are binned once per fit and kept as packs of bytes: features with few bins share one code,
so a row takes a few bytes and few additions. A tree is grown by its levels: each one needs, per node
and bin, the number of rows and the sums of what is left to predict. Of two children only the smaller
one is counted, and the other one is what its parent has besides. Rows that a single task holds anyway
need no jobs between the rounds: that task grows a whole block of trees by the same steps. Otherwise a
level is a job.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, functions as F

#: Rows that candidate splits are taken from, about, as in Spark's own trees.
SAMPLE_ROWS = 65_536
#: Values that a code shared by features takes at most.
JOINT_CODES = 4_096
#: Rows that are packed together, and rows that are counted together, at most.
PACK_ROWS, BLOCK_ROWS = 65_536, 262_144


@dataclass
class Tree:
    """Nodes as arrays, children behind their parents; a leaf has the feature -1.

    ``cut`` is the last bin, ``threshold`` the largest value that goes left. The right child follows
    the left one. ``squares`` are known for the leaves first, and then for all.
    """

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    rows: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    squares: np.ndarray

    def add_up(self, squares: np.ndarray) -> None:
        """Take over the leaves' sums of squares and give every node those of its leaves."""
        self.squares = squares.copy()
        for node in reversed(np.flatnonzero(self.feature >= 0)):
            self.squares[node] = self.squares[self.left[node]] + self.squares[self.left[node] + 1]

    def node_rows(self) -> Iterator[tuple]:
        """The nodes as Spark ML stores them."""
        for n in range(len(self.feature)):
            inner = self.feature[n] >= 0
            weight, total, squares = float(self.weight[n]), float(self.total[n]), float(self.squares[n])
            impurity = max(squares / weight - (total / weight) ** 2, 0.0) if weight else 0.0
            split = (int(self.feature[n]), [float(self.threshold[n])], -1) if inner else (-1, [], -1)
            yield (n, float(self.value[n]), impurity, [weight, total, squares], int(self.rows[n]),
                   float(self.gain[n]) if inner else -1.0, int(self.left[n]) if inner else -1,
                   int(self.left[n]) + 1 if inner else -1, split)


def constant(value: float, rows: int, weight: float, squares: float) -> Tree:
    one = [np.array([x]) for x in (-1, -1, 0.0, -1, value, -1.0, rows, weight, value * weight, squares)]
    return Tree(*one)


# --- bins -------------------------------------------------------------------------------

def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` values halfway between neighbours, with about as many rows in each bin."""
    found, counts = np.unique(values, return_counts=True)
    between = (found[:-1] + found[1:]) / 2
    if len(between) < bins:
        return between
    before = np.cumsum(counts)
    stride, kept = len(values) / bins, []
    target = stride
    for place in range(1, len(found)):
        if abs(before[place - 1] - target) < abs(before[place] - target):
            kept.append(between[place - 1])
            target += stride
    return np.array(kept[:bins - 1])


def learn_cuts(rows: DataFrame, n: int, bins: int) -> list[np.ndarray]:
    """Candidate splits of every feature, from all of the ``n`` rows or a hashed sample of them."""
    picked = rows.select("features")
    if n > SAMPLE_ROWS:
        share = int(SAMPLE_ROWS / n * (1 << 30))
        picked = rows.where(F.pmod(F.xxhash64("features", "y_label"), F.lit(1 << 30)) < share).select("features")
    values = _matrix(picked.toArrow()["features"].combine_chunks())
    return [cut_points(column, bins) for column in values.T]


def _matrix(features: pa.Array) -> np.ndarray:
    """Lists of equal length as rows by features."""
    return features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), -1)


@dataclass(frozen=True)
class Coding:
    """The bins of a row as a few codes: features whose bins have few combinations share one."""

    cuts: Sequence[np.ndarray]
    joint: int = JOINT_CODES

    @cached_property
    def sizes(self) -> list[int]:
        return [len(points) + 1 for points in self.cuts]

    @cached_property
    def places(self) -> np.ndarray:
        """Where the bins of each feature begin, and where the last ones end."""
        return np.cumsum([0, *self.sizes])

    @cached_property
    def groups(self) -> list[list[int]]:
        """The features behind each code."""
        groups: list[list[int]] = []
        for feature in np.argsort(self.sizes, kind="stable").tolist():
            if not groups or prod(self.sizes[k] for k in [*groups[-1], feature]) > self.joint:
                groups.append([])
            groups[-1].append(feature)
        return groups

    @cached_property
    def shapes(self) -> list[list[int]]:
        return [[self.sizes[feature] for feature in group] for group in self.groups]

    @cached_property
    def widths(self) -> list[int]:
        return [prod(shape) for shape in self.shapes]

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the sums of each code begin, and where the last ones end."""
        return np.cumsum([0, *self.widths])

    @cached_property
    def kinds(self) -> list[np.dtype]:
        return [np.min_scalar_type(width - 1) for width in self.widths]

    @cached_property
    def bytes(self) -> int:
        """Bytes of a row."""
        return sum(kind.itemsize for kind in self.kinds)

    @cached_property
    def homes(self) -> dict[int, tuple[int, np.ndarray]]:
        """The code of each feature, and the feature's bin for all values of that code."""
        return {feature: (number, bins.astype(np.int32))
                for number, (group, shape) in enumerate(zip(self.groups, self.shapes))
                for feature, bins in zip(group, np.unravel_index(np.arange(prod(shape)), shape))}

    def codes(self, features: pa.Array) -> list[np.ndarray]:
        columns = _matrix(features).T
        return [np.ravel_multi_index(
            [np.searchsorted(self.cuts[feature], columns[feature]) for feature in group], shape).astype(kind)
            for group, shape, kind in zip(self.groups, self.shapes, self.kinds)]

    def unpacked(self, packed: bytes) -> list[np.ndarray]:
        rows, at, codes = len(packed) // self.bytes, 0, []
        for kind in self.kinds:
            codes.append(np.frombuffer(packed, kind, rows, at))
            at += rows * kind.itemsize
        return codes

    def by_feature(self, sums: np.ndarray) -> np.ndarray:
        """Sums per code as sums per bin of each feature."""
        found = np.empty((*sums.shape[:-1], self.places[-1]))
        for number, (group, shape) in enumerate(zip(self.groups, self.shapes)):
            own = sums[..., self.starts[number]:self.starts[number + 1]].reshape(*sums.shape[:-1], *shape)
            fixed = sums.ndim - 1
            for axis, feature in enumerate(group):
                others = tuple(fixed + k for k in range(len(group)) if k != axis)
                found[..., self.places[feature]:self.places[feature + 1]] = own.sum(axis=others) if others else own
        return found

    def right(self, tree: Tree, node: int, codes: Sequence[np.ndarray], own: np.ndarray | None) -> np.ndarray:
        """Which of a node's rows go right; ``own`` None stands for all rows."""
        number, bins = self.homes[tree.feature[node]]
        code, cut = codes[number], int(tree.cut[node])
        if own is not None:
            code = code.take(own)
        return code > cut if len(self.groups[number]) == 1 else (bins > cut).take(code)

    def deal(self, tree: Tree, codes: Sequence[np.ndarray], rows: dict[int, np.ndarray | None]) -> None:
        """Pass on the ``rows`` of nodes that have been split to their children. None stands for all rows."""
        waiting = list(rows)
        while waiting:
            node = waiting.pop()
            if tree.feature[node] < 0:
                continue
            own = rows.pop(node)
            right, first = self.right(tree, node, codes, own), int(tree.left[node])
            for child, side in ((first, np.flatnonzero(~right)), (first + 1, np.flatnonzero(right))):
                rows[child] = side if own is None else own.take(side)
                waiting.append(child)

    def leaves(self, tree: Tree, codes: Sequence[np.ndarray], rows: dict[int, np.ndarray | None]) -> np.ndarray:
        """The leaf of every row; ``rows`` are those of the nodes, as far as they were dealt."""
        found = np.zeros(len(codes[0]), np.min_scalar_type(len(tree.feature)))
        waiting = list(rows.items())
        while waiting:
            node, own = waiting.pop()
            place = slice(None) if own is None else own
            if tree.feature[node] < 0:
                found[place] = node
                continue
            right, first = self.right(tree, node, codes, own), int(tree.left[node])
            if tree.feature[first] < 0 and tree.feature[first + 1] < 0:
                found[place] = found.dtype.type(first) + right
                continue
            for child, side in ((first, np.flatnonzero(~right)), (first + 1, np.flatnonzero(right))):
                waiting.append((child, side if own is None else own.take(side)))
        return found


#: Rows of :class:`Block` s as they are stored: the columns of a block as bytes, or trees just grown.
STORED = ("grown binary, codes binary, left binary, weight binary, held_codes binary, held_left binary, "
          "held_weight binary")


@dataclass
class Block:
    """Some rows to learn from and some to judge by, with what is left to predict."""

    codes: list[np.ndarray]
    left: np.ndarray
    weight: np.ndarray | None
    held_codes: list[np.ndarray]
    held_left: np.ndarray
    held_weight: np.ndarray | None
    squares: np.ndarray | None = None     # of the last tree's leaves, before the tree was taken off
    #: The rows of the nodes of the tree that is being grown, as far as they were dealt.
    rows: dict[int, np.ndarray | None] = field(default_factory=lambda: {0: None})

    @cached_property
    def total(self) -> np.ndarray:
        return self.left if self.weight is None else self.left * self.weight

    def judged(self) -> tuple[float, float]:
        """Sum and weight of the held rows' squared errors."""
        power = self.held_left * self.held_left
        if self.held_weight is None:
            return power.sum(), len(power)
        return self.held_weight @ power, self.held_weight.sum()

    def after(self, tree: Tree, step: float, coding: Coding) -> Block:
        moves = step * tree.value
        leaves = coding.leaves(tree, self.codes, self.rows).astype(np.intp)
        held = coding.leaves(tree, self.held_codes, {0: None})
        squares = np.bincount(leaves, self.total * self.left, len(moves))
        left, held_left = self.left - moves.take(leaves), self.held_left - moves.take(held)
        return Block(self.codes, left, self.weight, self.held_codes, held_left, self.held_weight, squares)

    def stored(self) -> tuple:
        """A row of :data:`STORED`."""
        def packed(*parts: np.ndarray | None) -> bytes | None:
            return None if parts[0] is None else b"".join(part.tobytes() for part in parts)

        return (None, packed(*self.codes), packed(self.left), packed(self.weight),
                packed(*self.held_codes), packed(self.held_left), packed(self.held_weight))


def packs(rows: DataFrame, coding: Coding, margin: float, weighted: bool, size: int) -> DataFrame:
    """The rows, binned once, as :data:`STORED`; ``margin`` is what is predicted so far."""
    columns = [column.split()[0] for column in STORED.split(", ")]

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        codes, held = coding.codes(whole["features"].chunk(0)), whole["is_validation"].to_numpy()
        left, weight = whole["y_label"].to_numpy() - margin, whole["weight"].to_numpy()
        sides = [([code[own] for code in codes], left[own], weight[own] if weighted else None) for own in (~held, held)]
        values = Block(*sides[0], *sides[1]).stored()
        return pa.RecordBatch.from_arrays([pa.array([value], pa.binary()) for value in values], columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, len(batch), size):
                some.append(batch.slice(start, size))
                if sum(map(len, some)) >= size:
                    yield packed(some)
                    some = []
        if some:
            yield packed(some)

    return rows.select("features", "y_label", "weight", "is_validation").mapInArrow(pack, STORED)


def blocks(part: Iterator[Row], coding: Coding) -> Iterator[Block]:
    """Packs as :class:`Block` s of at most :data:`BLOCK_ROWS` rows, or of one pack."""
    def joined(some: list[Block]) -> Block:
        def whole(name: str):
            parts = [getattr(block, name) for block in some]
            if parts[0] is None:
                return None
            return [np.concatenate(own) for own in zip(*parts)] if name.endswith("codes") else np.concatenate(parts)

        return Block(*map(whole, ("codes", "left", "weight", "held_codes", "held_left", "held_weight")))

    some: list[Block] = []
    size = 0
    for row in part:
        if row["codes"] is None:
            continue
        codes, held = coding.unpacked(row["codes"]), coding.unpacked(row["held_codes"])
        numbers = [None if row[name] is None else np.frombuffer(row[name])
                   for name in ("left", "weight", "held_left", "held_weight")]
        block = Block(codes, *numbers[:2], held, *numbers[2:])
        rows = len(block.left) + len(block.held_left)
        if some and size + rows > BLOCK_ROWS:
            yield joined(some)
            some, size = [], 0
        some.append(block)
        size += rows
    if some:
        yield joined(some)


# --- one tree ---------------------------------------------------------------------------

def _counted(part: Iterator[Block], tree: Tree, wanted: Sequence[int], coding: Coding, weighted: bool,
             totals_only: bool) -> Iterator[tuple]:
    """Rows, sums and weights per wanted node and bin; the leaves' squares and the error of the held rows."""
    squares, judged = None, np.zeros(2)
    sums = np.zeros((1 if totals_only else 2 + weighted, len(wanted), coding.starts[-1]))
    for block in part:
        if len(tree.feature) == 1:
            judged += block.judged()
            if block.squares is not None:
                squares = block.squares if squares is None else squares + block.squares
        if not len(wanted):
            continue
        coding.deal(tree, block.codes, block.rows)
        owned = [block.rows[node] for node in wanted]
        own = None if owned[0] is None else np.concatenate(owned)
        slots = 0 if own is None else np.repeat(np.arange(len(wanted)), [len(part) for part in owned])
        total, weight = [values if own is None or values is None else values.take(own)
                         for values in (block.total, None if totals_only else block.weight)]
        before = {width: slots * width for width in coding.widths}
        for number, (code, width) in enumerate(zip(block.codes, coding.widths)):
            key, shape = (code if own is None else code.take(own)) + before[width], (len(wanted), width)
            to = slice(coding.starts[number], coding.starts[number + 1])
            sums[0, :, to] += np.bincount(key, total, prod(shape)).reshape(shape)
            if not totals_only:
                sums[1, :, to] += np.bincount(key, minlength=prod(shape)).reshape(shape)
            if weight is not None:
                sums[2, :, to] += np.bincount(key, weight, prod(shape)).reshape(shape)
    yield coding.by_feature(sums), squares, judged


def count(data: RDD | list[Block], tree: Tree, wanted: Sequence[int], coding: Coding, weighted: bool,
          known: np.ndarray | None = None) -> tuple:
    """One job: what the tasks have counted, added up in the order of the tasks. Within a task, its own blocks.

    Where rows and weights of the wanted nodes are ``known``, only sums are counted.
    """
    counted = partial(_counted, tree=tree, wanted=wanted, coding=coding, weighted=weighted, totals_only=known is not None)
    found = counted(iter(data)) if isinstance(data, list) else data.mapPartitions(counted).collect()
    sums = np.zeros((3, len(wanted), coding.places[-1]))
    squares, judged = None, np.zeros(2)
    for part, leaves, error in found:
        for channel, own in zip((1, 0, 2), part):
            sums[channel] += own
        if leaves is not None:
            squares = leaves if squares is None else squares + leaves
        judged += error
    if known is not None:
        sums[[0, 2]] = known
    elif not weighted:
        sums[2] = sums[0]
    return sums, squares, judged


def best_splits(sums: np.ndarray, coding: Coding, min_leaf: int) -> list[tuple | None]:
    """(gain, feature, bin, left sums) of the split of each node that lessens the squared error most.

    ``sums`` are those of :func:`count`. Of equal gains the first feature's and lowest bin's is taken.
    """
    most, sizes = max(coding.sizes), np.array(coding.sizes)
    bins = np.arange(most)
    # Bins that a feature doesn't have are taken from a column of zeros behind the others.
    index = np.where(bins < sizes[:, None], coding.places[:-1, None] + bins, coding.places[-1])
    own = np.concatenate([sums, np.zeros((*sums.shape[:2], 1))], axis=2)[:, :, index]
    whole = own.sum(axis=3)
    lower = np.cumsum(own, axis=3)
    upper = whole[..., None] - lower
    allowed = ((bins < sizes[:, None] - 1) & (lower[0] >= min_leaf) & (upper[0] >= min_leaf)
               & (lower[2] > 0) & (upper[2] > 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.where(allowed, lower[1] ** 2 / lower[2] + upper[1] ** 2 / upper[2], -np.inf)
        cuts = power.argmax(axis=2)
        power = np.take_along_axis(power, cuts[..., None], axis=2)[..., 0]
        gains = (power - whole[1] ** 2 / whole[2]) / whole[2]
        gains = np.where(allowed.any(axis=2) & (gains > 1e-12 * power / whole[2]), gains, -np.inf)
    found: list[tuple | None] = []
    for node, feature in enumerate(gains.argmax(axis=1)):
        gain, cut = gains[node, feature], int(cuts[node, feature])
        found.append((gain, int(feature), cut, lower[:, node, feature, cut]) if gain > -np.inf else None)
    return found


def grow(data: RDD | list[Block], coding: Coding, depth: int, min_leaf: int, weighted: bool,
         known: np.ndarray | None = None) -> tuple[Tree, np.ndarray | None, np.ndarray, np.ndarray]:
    """A tree of what is left; the squares of the tree before it and the held rows' error come along.

    Rows and weights per bin of all rows are the same for every tree: they are returned, too, and
    needn't be counted again where they are ``known``.
    """
    tree = constant(0.0, 0, 0.0, 0.0)
    names = list(tree.__dataclass_fields__)
    sums, squares, judged = count(data, tree, [0], coding, weighted, known)
    known = sums[[0, 2]]
    whole = sums[:, 0, :coding.sizes[0]].sum(axis=1)
    tree.rows[0], tree.total[0], tree.weight[0] = whole
    tree.value[0] = whole[1] / whole[2] if whole[2] else 0.0
    level = {0: sums[:, 0]}
    for left_over in reversed(range(depth)):
        splits = best_splits(np.stack(list(level.values()), axis=1), coding, min_leaf)
        found = [(node, split) for node, split in zip(level, splits) if split is not None]
        grown: list[tuple[int, int]] = []                     # parent, left child
        for name in names:
            fill = -1 if name in ("feature", "cut", "left") else 0
            setattr(tree, name, np.append(getattr(tree, name), [fill] * (2 * len(found))))
        for first, (node, (gain, feature, cut, lower)) in enumerate(found):
            first = 2 * first + len(tree.feature) - 2 * len(found)
            upper = np.array([tree.rows[node], tree.total[node], tree.weight[node]]) - lower
            tree.feature[node], tree.cut[node], tree.threshold[node] = feature, cut, coding.cuts[feature][cut]
            tree.left[node], tree.gain[node] = first, gain
            for child, (rows, total, weight) in ((first, lower), (first + 1, upper)):
                tree.rows[child], tree.total[child], tree.weight[child] = rows, total, weight
                tree.value[child] = total / weight
            grown.append((node, first))
        grown = [(node, first) for node, first in grown if max(tree.rows[first:first + 2]) >= 2 * min_leaf]
        if not left_over or not grown:
            break
        smaller = [first + int(tree.rows[first + 1] < tree.rows[first]) for _, first in grown]
        sums, _, _ = count(data, tree, smaller, coding, weighted)
        former, level = level, {}
        for slot, ((node, first), child) in enumerate(zip(grown, smaller)):
            level[child], level[2 * first + 1 - child] = sums[:, slot], former[node] - sums[:, slot]
        level = {node: own for node, own in sorted(level.items()) if tree.rows[node] >= 2 * min_leaf}
    return tree, squares, judged, known


def boost(data: RDD | list[Block], rounds: int, coding: Coding, depth: int, min_leaf: int, step: float,
          weighted: bool) -> tuple[list[Tree], list[np.ndarray], RDD | list[Block]]:
    """Trees of several rounds, (sum, weight) of the held rows' squared error before and after each, and
    the rows with what is left then."""
    trees: list[Tree] = []
    errors, former, known = [], None, None
    for _ in range(rounds):
        tree, squares, error, known = grow(data, coding, depth, min_leaf, weighted, known)
        errors.append(error)
        if trees:
            trees[-1].add_up(squares)
        trees.append(tree)
        if former is not None:
            former.unpersist()
        if isinstance(data, list):
            data = [block.after(tree, step, coding) for block in data]
        else:
            former, data = data, data.map(partial(Block.after, tree=tree, step=step, coding=coding)).persist(
                StorageLevel.MEMORY_AND_DISK)
    _, squares, error = count(data, constant(0.0, 0, 0.0, 0.0), [], coding, weighted)
    trees[-1].add_up(squares)
    if former is not None:
        former.unpersist()
    return trees, [*errors, error], data


def boost_alone(part: Iterator[Row], coding: Coding, **how) -> Iterator[tuple]:
    """The same inside a task that holds all rows: (trees, errors) and the rows, as :data:`STORED`."""
    if own := list(blocks(part, coding)):
        trees, errors, own = boost(own, coding=coding, **how)
        yield (pickle.dumps((trees, errors)), *[None] * 6)
        for block in own:
            yield block.stored()


# --- shuffled features ------------------------------------------------------------------

def _moved(tree: Tree, cuts: np.ndarray, own: np.ndarray, donor: np.ndarray) -> tuple[np.ndarray, Iterator[tuple]]:
    """What a tree predicts for every row, and (rows, features, predictions) of those variants that
    end in another leaf. ``own`` and ``donor`` are bins (features by rows).

    In a node that splits on a feature, only rows whose donor goes the other way leave their path,
    and only these are followed further.
    """
    n, nodes = own.shape[1], len(tree.feature)
    value, last = np.empty(n), np.iinfo(own.dtype).max
    here: list = [None] * nodes                 # rows on their path, and what bounds the features there
    away: list = [[] for _ in range(nodes)]     # rows that left it, and their shuffled features
    here[0] = (np.arange(n), {})
    found: list[tuple] = []
    for node in range(nodes):
        rows, bounds = here[node]
        left = [np.concatenate(part) for part in zip(*away[node])] if away[node] else None
        here[node] = away[node] = None
        split, cut, first = int(tree.feature[node]), int(cuts[node]), int(tree.left[node])
        if split < 0:
            value[rows] = tree.value[node]
            if left is not None:
                found.append((*left, tree.value[node]))
            continue
        low, high = bounds.get(split, (-1, last))
        right, other = own[split].take(rows) > cut, donor[split].take(rows)
        for child, stays, leaves, limits in (
                (first, ~right, (other > cut) & (other <= high), (low, cut)),
                (first + 1, right, (other <= cut) & (other > low), (cut, high))):
            here[child] = (rows.take(np.flatnonzero(stays)), {**bounds, split: limits})
            gone = rows.take(np.flatnonzero(stays & leaves))
            away[2 * first + 1 - child].append((gone, np.full(len(gone), split, own.dtype)))
        if left is not None:
            rows, shuffled = left
            right = np.where(shuffled == split, donor[split].take(rows), own[split].take(rows)) > cut
            for child, side in ((first, np.flatnonzero(~right)), (first + 1, np.flatnonzero(right))):
                away[child].append((rows.take(side), shuffled.take(side)))
    return value, iter(found)


def variant_errors(paired: DataFrame, grown: Sequence[tuple[Tree, float]], features: int) -> DataFrame:
    """(repeat, _index, total): the summed squared errors of the weighted trees when the feature
    ``_index`` of every row is taken from its ``donor``."""
    points = [np.unique([tree.threshold[node] for tree, _ in grown for node in np.flatnonzero(tree.feature == feature)])
              for feature in range(features)]
    cuts = [np.array([np.searchsorted(points[feature], threshold) if feature >= 0 else 0
                      for feature, threshold in zip(tree.feature, tree.threshold)]) for tree, _ in grown]
    kind = np.int16 if max(map(len, points)) < np.iinfo(np.int16).max else np.int32

    def bins(values: pa.Array) -> np.ndarray:
        return np.stack([np.searchsorted(own, column).astype(kind) for own, column in zip(points, _matrix(values).T)])

    def totals(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks()
        own, donor = bins(whole["features"].chunk(0)), bins(whole["donor"].chunk(0))
        error, repeats = whole["y_true"].to_numpy().copy(), whole["repeat"].to_numpy().astype(np.intp)
        n = len(error)
        change = np.zeros(features * n)
        for (tree, factor), places in zip(grown, cuts):
            value, moved = _moved(tree, places, own, donor)
            error -= factor * value
            for rows, shuffled, new in moved:
                change[shuffled.astype(np.intp) * n + rows] += factor * (new - value.take(rows))
        met = np.unique(repeats)
        sums = [np.bincount(repeats, (error - own) ** 2)[met] for own in change.reshape(features, n)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.tile(met, features), pa.int32()), pa.array(np.repeat(np.arange(features), len(met)), pa.int32()),
            pa.array(np.concatenate(sums))], ["repeat", "_index", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(map(len, some)) >= PACK_ROWS:
                yield totals(some)
                some = []
        if sum(map(len, some)):
            yield totals(some)

    sums = paired.select("repeat", "y_true", "features", "donor").mapInArrow(add, "repeat int, _index int, total double")
    return sums.groupBy("repeat", "_index").agg(F.sum("total").alias("total"))
