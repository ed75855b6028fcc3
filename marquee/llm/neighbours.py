"""Approximate nearest neighbours by stable random projections and kd-trees.

Vectors are projected to a few Gaussian dimensions, where squared distances are the true
ones times a chi-square variable. A coarse kd-tree over the projections deals the vectors
into cells; each cell has a kd-tree of its own. A query takes leaves in the order of
projected distance and verifies their vectors in double precision, until the chi-square
test says that a nearer vector would almost surely have been met. It starts in its own
cell; its k-th distance there decides which other cells it has to visit.

Largest inner product becomes nearest distance by one more dimension, sqrt(M^2 - |x|^2)
with M the largest norm, which is 0 for queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.plans.registry import Registry
from marquee.session import materialize

REGISTRY = Registry()
#: Projected dimensions, confidence of the stopping test, vectors per leaf.
DIMENSIONS, CONFIDENCE, LEAF = 8, 0.98, 128
#: Vectors per cell, bound on cells, sample that places the coarse cuts, queries per block.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, BLOCK = 16_000, 1024, 16_384, 2_048


def chi_square_quantile(p: float, dimensions: int) -> float:
    """The p-quantile of the chi-square law for an even number of dimensions."""
    def law(x):
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    low, high = 0.0, 1.0
    while law(high) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if law(middle) < p else (low, middle)
    return high


def projection(width: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, DIMENSIONS))


def project(vectors: np.ndarray, largest: float, matrix: np.ndarray, query: bool) -> np.ndarray:
    squares = (vectors * vectors).sum(1)
    last = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(largest ** 2 - squares, 0))
    return vectors @ matrix[:-1] + last[:, None] * matrix[-1]


def coarse_cuts(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """A complete kd-tree in heap order: (dimension, cut) per inner node; cells is a power of 2."""
    cuts: list[tuple[int, float]] = []
    level = [points]
    while len(level) < cells:
        below = []
        for own in level:
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            cuts.append((axis, cut))
            below += [own[own[:, axis] <= cut], own[own[:, axis] > cut]]
        level = below
    return cuts


def cell_of(points: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    axes, values = np.array([a for a, _ in cuts], np.int64), np.array([c for _, c in cuts])
    for _ in range((len(cuts) + 1).bit_length() - 1):
        right = points[np.arange(len(points)), axes[node]] > values[node]
        node = 2 * node + 1 + right
    return node - len(cuts)


def box_distances(points: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    total = np.zeros((len(points), len(lows)))
    for j in range(points.shape[1]):
        x = points[:, j:j + 1]
        total += np.maximum(np.maximum(lows[:, j] - x, x - highs[:, j]), 0) ** 2
    return total


def leaves_of(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """kd-tree leaves: row numbers, lower and upper corners."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        own = points[rows]
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        axis = int(np.argmax(own.max(0) - own.min(0)))
        order = np.argpartition(own[:, axis], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return (leaves, np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves]))


def search(vectors, shadows, queries, query_shadows, known, largest, k):
    """The best k + 1 rows of ``vectors`` per query, as (rows, scores); row -1: none.

    ``known`` is a score that k vectors are known to reach (or -inf).
    """
    leaves, lows, highs = leaves_of(shadows)
    far = box_distances(query_shadows, lows, highs)
    order = np.argsort(far, axis=1, kind="stable")
    far = np.take_along_axis(far, order, 1)
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    base = (queries * queries).sum(1) + largest ** 2
    scores = np.full((len(queries), k + 1), -np.inf)
    rows = np.full((len(queries), k + 1), -1, np.int64)
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        reach = np.maximum(scores[active, -1], known[active])
        gap = np.maximum(base[active] - 2 * reach, 0)
        active = active[~(far[active, turn] > limit * gap)]
        if not len(active):
            break
        at = order[active, turn]
        by_leaf = np.argsort(at, kind="stable")
        bounds = np.flatnonzero(np.diff(at[by_leaf])) + 1
        for group in np.split(active[by_leaf], bounds):
            leaf = leaves[order[group[0], turn]]
            own = np.concatenate([scores[group], queries[group] @ vectors[leaf].T], axis=1)
            names = np.concatenate([rows[group], np.broadcast_to(leaf, (len(group), len(leaf)))], axis=1)
            # Best first; rows come ordered by their smallest id, so ties go to smaller ids.
            best = np.lexsort((names, -own), axis=1)[:, :k + 1]
            scores[group] = np.take_along_axis(own, best, 1)
            rows[group] = np.take_along_axis(names, best, 1)
    return rows, scores


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


_FOUND = "query_id long, vec_id long, score double"


def _searched(largest: float, matrix: np.ndarray, k: int):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        points = points.assign(least=[min(i) for i in points["ids"]]).sort_values("least", kind="stable")
        vectors, asked = _matrix(points["vector"]), _matrix(queries["vector"])
        known = queries["known"].fillna(-np.inf).to_numpy(np.float64)
        rows, scores = search(vectors, project(vectors, largest, matrix, False), asked,
                              project(asked, largest, matrix, True), known, largest, k)
        ids = points["ids"].tolist()
        out = []
        for query, own, values in zip(queries["query_id"].tolist(), rows.tolist(), scores.tolist()):
            near = [(-s, i) for r, s in zip(own, values) if r >= 0 for i in ids[r] if i != query]
            out += [(query, i, -s) for s, i in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """The k vectors of largest inner product found for each query, other than its own row.

    ``vectors`` and ``queries`` have vec_id and embedding (other columns are ignored).
    Returns query_id, rank, vec_id, score (exact, in double precision), ties to smaller
    vec_id; k+1 ids stand for equal vectors, which is exact. Rows whose id or embedding is
    null, that are zero, that hold null or non-finite components, or that differ from the most
    frequent length take no part. A query without candidates has no rows.
    """
    spark = vectors.sparkSession

    def usable(df):
        e = F.col("embedding").cast("array<double>")
        return (df.select(F.col("vec_id").cast("bigint").alias("vec_id"), e.alias("vector"))
                .where("vec_id is not null and vector is not null and size(vector) > 0")
                .where("forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
                .where("exists(vector, x -> x <> 0)"))

    good = usable(vectors)
    widths = good.groupBy(F.size("vector").alias("w")).agg(
        F.count("*").alias("n"), F.max(F.expr("aggregate(vector, 0d, (s, x) -> s + x * x)")).alias("top")
    ).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, largest = widths[0].w, math.sqrt(widths[0].top)
    matrix = projection(width)
    good, asked = good.where(F.size("vector") == width), usable(queries).where(F.size("vector") == width)
    # Equal vectors are one point with its k + 1 smallest ids: more of them can't be in a result.
    first = Window.partitionBy("vector").orderBy("vec_id")
    distinct = (good.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
                .groupBy("vector").agg(F.collect_list("vec_id").alias("ids")))
    distinct = materialize(distinct, "neighbour-vectors")
    rows = distinct.count()
    cells = 1
    while cells < min(MOST_CELLS, rows / CELL_ROWS):
        cells *= 2
    chance = F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) / F.lit(1 << 30)
    sample = distinct.where(chance < SAMPLE_ROWS / max(rows, 1)).select("vector").toPandas()["vector"]
    cuts = coarse_cuts(project(_matrix(sample), largest, matrix, False) if len(sample)
                       else np.zeros((1, DIMENSIONS)), cells)

    def placed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shadows = project(_matrix(batch.column("vector").to_pandas()), largest, matrix, query)
                yield pa.record_batch(
                    [*batch.columns, pa.array(cell_of(shadows, cuts) if cuts else np.zeros(len(batch), np.int64)),
                     pa.array(shadows.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "cell", "shadow"])
        return run

    index = materialize(distinct.mapInArrow(placed(False), "vector array<double>, ids array<long>, cell long, "
                                                           "shadow array<double>"), "neighbour-index")
    corners = [f(F.col("shadow")[j]).alias(f"{f.__name__}{j}") for j in range(DIMENSIONS) for f in (F.min, F.max)]
    boxes = {r["cell"]: r for r in index.groupBy("cell").agg(F.count("*").alias("n"), *corners).collect()}
    names = sorted(boxes)
    lows = np.array([[boxes[c][f"min{j}"] for j in range(DIMENSIONS)] for c in names])
    highs = np.array([[boxes[c][f"max{j}"] for j in range(DIMENSIONS)] for c in names])
    parts = spark.createDataFrame([(c, -(-boxes[c]["n"] // CELL_ROWS)) for c in names], "cell long, parts long")
    index = (index.drop("shadow").join(F.broadcast(parts), "cell")
             .withColumn("part", F.pmod(F.xxhash64("vector"), F.col("parts"))).drop("parts"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(
        placed(True), "query_id long, vector array<double>, cell long, shadow array<double>")
    asked = materialize(asked, "neighbour-queries")

    def visited(visits: DataFrame) -> DataFrame:
        """Searches (cell, query) visits; a cell's queries go in blocks, its vectors to each block."""
        blocks = (visits.groupBy("cell").agg(F.count("*").alias("n"))
                  .select("cell", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("blocks")))
        left = (index.join(F.broadcast(blocks), "cell")  # at most MOST_CELLS rows
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).drop("blocks"))
        right = (visits.join(F.broadcast(blocks), "cell")
                 .withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
                 .join(F.broadcast(parts), "cell")
                 .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts"))
        key = ["cell", "part", "block"]
        return (left.groupBy(*key).cogroup(right.select(*key, "query_id", "vector", "known").groupBy(*key))
                .applyInPandas(_searched(largest, matrix, k), _FOUND))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # Queries whose own cell is empty go on with no known score.
    home = materialize(visited(asked.withColumn("known", F.lit(None).cast("double"))), "neighbour-home")
    reached = (home.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
               .select("query_id", F.col("score").alias("known")))
    limit = chi_square_quantile(CONFIDENCE, DIMENSIONS)

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries = _matrix(batch.column("vector").to_pandas())
            shadows = _matrix(batch.column("shadow").to_pandas())
            known = batch.column("known").to_numpy(zero_copy_only=False).astype(np.float64)
            known = np.where(np.isnan(known), -np.inf, known)
            gap = (queries * queries).sum(1) + largest ** 2 - 2 * known
            visit = box_distances(shadows, lows, highs) <= limit * np.maximum(gap, 0)[:, None]
            visit &= np.array(names)[None, :] != batch.column("cell").to_numpy()[:, None]
            at, to = np.nonzero(visit)
            taken = batch.take(pa.array(at))
            yield pa.record_batch([taken.column("query_id"), taken.column("vector"), taken.column("known"),
                                   pa.array(np.array(names, np.int64)[to])], ["query_id", "vector", "known", "cell"])

    others = (asked.join(reached, "query_id", "left").select("query_id", "vector", "cell", "shadow", "known")
              .mapInArrow(onward, "query_id long, vector array<double>, known double, cell long"))
    found = home if len(names) == 1 else home.unionByName(visited(materialize(others, "neighbour-visits")))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


@REGISTRY.add()
def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
