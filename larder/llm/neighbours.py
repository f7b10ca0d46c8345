"""Nearest neighbours by inner product, with stable projections and kd-trees.

Largest inner products become smallest distances when every vector gets one more component,
root(M^2 - length^2) with M the largest length, and queries get 0 there and length M. A few
Gaussian (2-stable) projections keep distances in this way: the squared projected distance
of two points is their squared distance times a chi-square variable. A search takes points
by increasing projected distance from a kd-tree, verifies them on the original vectors, and
stops when a point as near as the k-th best found would, by the chi-square distribution,
have been met already with probability ``SURE``.

Rows are dealt to shards by the upper splits of the tree, learned from a bounded sample; a
shard that is still too large (many equal vectors) is dealt on by id. Each shard indexes
its rows. A query first searches the shard it falls into and then those that its k-th best
distance does not rule out by the same test. Queries travel in blocks of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import hashed_sample, stage

DIMENSIONS = 8
SURE = 0.98
SHARD_ROWS = 8192
SAMPLE_ROWS = 20_000
QUERY_BLOCK = 4096
LEAF = 256


def chi_square_quantile(probability: float, freedom: int) -> float:
    """By bisection on the closed form for even degrees of freedom."""

    def cdf(x: float) -> float:
        terms = (math.exp(-x / 2 + i * math.log(max(x, 1e-300) / 2) - math.lgamma(i + 1)) for i in range(freedom // 2))
        return 1 - sum(terms)

    low, high = 0.0, 40.0 * freedom
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < probability else (low, middle)
    return high


REACH = chi_square_quantile(SURE, DIMENSIONS)


@dataclass(frozen=True)
class Projection:
    """Vectors with their added component, projected."""

    longest: float
    axes: np.ndarray

    @classmethod
    def of(cls, size: int, longest: float) -> Projection:
        return cls(longest, np.random.default_rng(11).normal(size=(size + 1, DIMENSIONS)))

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
        return vectors @ self.axes[:-1] + extra[:, None] * self.axes[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((vectors**2).sum(axis=1))
        return (vectors * (self.longest / lengths)[:, None]) @ self.axes[:-1]

    def distance(self, product: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The squared distances of queries of these lengths and inner products."""
        return np.maximum(2 * self.longest**2 - 2 * self.longest * product / length, 0)


def _halves(points: np.ndarray) -> tuple[int, float] | None:
    """The axis and value that split points about evenly; None if all are equal."""
    spread = points.max(axis=0) - points.min(axis=0)
    for axis in np.argsort(-spread):
        if spread[axis] <= 0:
            return None
        value = float(np.median(points[:, axis]))
        if value <= points[:, axis].min():
            value = float(points[points[:, axis] > value, axis].min())
        return int(axis), value
    return None


@dataclass(frozen=True)
class Shards:
    """The upper splits: an inner node is (axis, value, low child, high child), a leaf a shard."""

    nodes: list
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def learn(cls, sample: np.ndarray, count: int) -> Shards:
        nodes: list = [None]
        boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        far = np.full(DIMENSIONS, np.inf)
        work = [(0, sample, -far, far, count)]
        leaves = 0
        while work:
            me, points, low, high, share = work.pop()
            split = _halves(points) if share > 1 and len(points) > 1 else None
            if split is None:
                nodes[me] = leaves
                boxes[leaves] = (low, high)
                leaves += 1
                continue
            axis, value = split
            under = points[:, axis] < value
            nodes[me] = (axis, value, len(nodes), len(nodes) + 1)
            middle_high, middle_low = high.copy(), low.copy()
            middle_high[axis] = middle_low[axis] = value
            work.append((len(nodes), points[under], low, middle_high, share // 2))
            work.append((len(nodes) + 1, points[~under], middle_low, high, share - share // 2))
            nodes += [None, None]
        return cls(nodes, *(np.array([boxes[i][k] for i in range(leaves)]) for k in (0, 1)))

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        work = [(0, np.arange(len(points)))]
        while work:
            at, rows = work.pop()
            node = self.nodes[at]
            if not isinstance(node, tuple):
                out[rows] = node
                continue
            axis, value, low, high = node
            under = points[rows, axis] < value
            work += [(low, rows[under]), (high, rows[~under])]
        return out


def _box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - point, point - high), 0)
    return (gap**2).sum(axis=1)


class Tree:
    """A kd-tree over projected points: leaves with their boxes."""

    def __init__(self, points: np.ndarray) -> None:
        leaves, work = [], [np.arange(len(points))]
        while work:
            rows = work.pop()
            split = _halves(points[rows]) if len(rows) > LEAF else None
            if split is None:
                leaves += [rows[i : i + LEAF] for i in range(0, len(rows), LEAF)]
                continue
            under = points[rows, split[0]] < split[1]
            work += [rows[~under], rows[under]]
        self.points, self.leaves = points, leaves
        self.low = np.array([points[rows].min(axis=0) for rows in leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in leaves])

    def distances(self, points: np.ndarray) -> np.ndarray:
        """The least squared projected distance of each point to each leaf."""
        out = np.zeros((len(points), len(self.leaves)))
        for axis in range(points.shape[1]):
            at = points[:, axis][:, None]
            out += np.maximum(np.maximum(self.low[:, axis] - at, at - self.high[:, axis]), 0) ** 2
        return out


def search(
    tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int,
    projection: Projection, points: np.ndarray, bounds: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, inner product) of the k best found of each query.

    In each round every query that has not stopped verifies its next nearest leaf, all
    queries of a leaf by one product. ``bounds`` are k-th best squared distances known. Products only sort
    out what cannot be among the k best; the scores of the rest are summed alike for every
    row, so equal vectors tie.
    """
    lengths = np.sqrt((queries**2).sum(axis=1))
    near = tree.distances(points)
    order = np.argsort(near, axis=1, kind="stable")
    bounds = bounds.copy()
    least = (2 * projection.longest**2 - bounds) * lengths / (2 * projection.longest)
    slack = 1e-9 * projection.longest * lengths
    best = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    going = np.arange(len(queries))
    for turn in range(len(tree.leaves)):
        leaf = order[going, turn]
        keep = near[going, leaf] <= bounds[going] * REACH
        going, leaf = going[keep], leaf[keep]
        if not len(going):
            break
        found_q, found_r = [], []
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for group in np.split(by_leaf, cuts):
            asking, rows = going[group], tree.leaves[leaf[group[0]]]
            product = queries[asking] @ vectors[rows].T
            fits = product >= (least - slack)[asking][:, None]
            fits &= own[asking][:, None] != ids[rows][None, :]
            q, r = np.nonzero(fits)
            found_q.append(asking[q])
            found_r.append(rows[r])
        q, r = np.concatenate(found_q), np.concatenate(found_r)
        score = np.concatenate([
            np.einsum("ij,ij->i", vectors[r[i : i + 65536]], queries[q[i : i + 65536]]) for i in range(0, len(q), 65536)
        ] or [np.zeros(0)])
        q, found, score = (np.concatenate(pair) for pair in zip(best, (q, ids[r], score), strict=True))
        place = np.lexsort((found, -score, q))
        q, found, score = q[place], found[place], score[place]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        best = tuple(column[rank < k] for column in (q, found, score))
        kth = rank == k - 1
        least[q[kth]] = np.maximum(least[q[kth]], score[kth])
        bounds[q[kth]] = np.minimum(bounds[q[kth]], projection.distance(score[kth], lengths[q[kth]]))
    return best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    plain = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return vector.isNotNull() & plain & F.exists(vector, lambda x: x != 0)


def nearest(rows: DataFrame, modulus: int, k: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query, nearest first.

    Queries are the rows whose id is divisible by ``modulus``, candidates all rows of other
    ids. Score is the inner product of the original vectors in double precision; ties go to
    the smaller id. Vectors that are not ``usable``, that have no id, or whose length is not
    the most frequent one take no part. Of candidates with the same id each counts.
    """
    plain = rows.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    plain = plain.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    sizes = plain.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(length).alias("longest"))
    common = sizes.orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, total = common["size"], common["n"]
    plain = plain.where(F.size("v") == size)
    projection = Projection.of(size, math.sqrt(common["longest"]))
    sample = hashed_sample(plain.select("vec_id", "v"), F.col("vec_id"), SAMPLE_ROWS).select("v").toArrow()
    points = projection.rows(_matrix(sample.column(0)))
    points = points[np.lexsort(points.T)]
    shards = Shards.learn(points, max(1, ceil(total / SHARD_ROWS)))
    context = rows.sparkSession.sparkContext
    shipped = context.broadcast((projection, shards))

    def homes(batches):
        for batch in batches:
            projection, shards = shipped.value
            vectors = _matrix(batch.column(1)) if batch.num_rows else np.zeros((0, size))
            at = shards.home(projection.rows(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["vec_id", "v", "shard"])

    homed = stage(plain.mapInArrow(homes, "vec_id long, v array<double>, shard int"), "vectors")
    per_shard = {row["shard"]: row["count"] for row in homed.groupBy("shard").count().collect()}
    parts = np.array([max(1, ceil(per_shard.get(s, 0) / SHARD_ROWS)) for s in range(len(shards.low))])
    queries = homed.where(F.col("vec_id") % modulus == 0).select("vec_id", "v")
    blocks = max(1, ceil(queries.count() / QUERY_BLOCK))
    of = F.element_at(F.array(*(F.lit(int(p)) for p in parts)), F.col("shard") + 1)
    placed = homed.withColumn("part", F.pmod(F.xxhash64("vec_id"), of).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keys = ["shard", "part", "block"]
    visit_schema = "query_id long, q array<double>, bound double, shard int, part int, block int"

    def visits(first: bool):
        """The shards each query searches: its own, or the others within reach of its bound."""

        def run(batches):
            for batch in batches:
                projection, shards = shipped.value
                if not batch.num_rows:
                    continue
                ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
                bound = np.full(len(ids), np.inf) if first else batch.column(2).to_numpy()
                at = projection.queries(vectors)
                home = shards.home(at)
                row, shard = [], []
                for i in range(len(ids)):
                    if first:
                        go = np.array([home[i]])
                    else:
                        near = _box_distance(shards.low, shards.high, at[i]) <= bound[i] * REACH
                        near[home[i]] = False
                        go = np.flatnonzero(near)
                    for s in go:
                        row += [i] * int(parts[s])
                        shard += [(int(s), p) for p in range(int(parts[s]))]
                row = np.array(row, dtype=np.int64)
                s, p = np.array(shard, dtype=np.int32).reshape(-1, 2).T
                block = (ids[row] // modulus % blocks).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(bound[row]),
                     pa.array(np.ascontiguousarray(s)), pa.array(np.ascontiguousarray(p)), pa.array(block)],
                    names=["query_id", "q", "bound", *keys],
                )

        return run

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        projection, _ = shipped.value
        columns = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            vectors, ids = _matrix(right.column("v")), right.column("vec_id").to_numpy()
            tree = Tree(projection.rows(vectors))
            query, own = _matrix(left.column("q")), left.column("query_id").to_numpy()
            bound, at = left.column("bound").to_numpy(), projection.queries(query)
            asked, found, score = search(tree, vectors, ids, query, own, k, projection, at, bound)
            columns = (own[asked], found, score)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def run(visiting: DataFrame) -> DataFrame:
        pairs = visiting.groupBy(*keys).cogroup(placed.groupBy(*keys))
        return pairs.applyInArrow(find, "query_id long, vec_id long, score double")

    first = stage(run(queries.mapInArrow(visits(True), visit_schema)), "first")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k)
    product = ranked.select("query_id", F.col("score").alias("kth"))
    bounded = queries.join(product, F.col("vec_id") == F.col("query_id"), "left")
    longest = projection.longest
    length_of = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
    bound = F.greatest(2 * longest**2 - 2 * longest * F.col("kth") / length_of, F.lit(0.0))
    bounded = bounded.select("vec_id", "v", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    others = run(bounded.mapInArrow(visits(False), visit_schema))
    every = first.unionByName(others)
    final = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return final.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
