"""Approximate nearest neighbours: stable projections, kd-trees over them, and a chi-square stopping test.

Vectors get one more coordinate that gives all the same length; then the largest inner product is the
smallest distance. Gaussian projections to a few dimensions keep distances stable: the projected square
distance over the true one is chi-square distributed. A kd-tree over the projections of a bounded sample
deals all rows into cells, and each shard of a cell has a kd-tree of its own, whose leaves hand a query their
vectors. It verifies them by rising projected distance, vector by vector, and stops when one that is nearer
than its k-th best so far would, with the asked probability, have been projected nearer than all that is left.

Queries travel to shards, never to a copy of the data: each vector is shuffled once, and a query once for
each shard whose cell the same test cannot rule out from the bound that the sample gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """dims: projected dimensions (even); found: probability that the test keeps a true neighbour; leaf: vectors
    of a leaf; shard: vectors of a shard, about; sample: vectors that fit cells and first bounds; max_cells bounds
    the tree that is broadcast."""

    dims: int = 20
    found: float = 0.9
    leaf: int = 128
    shard: int = 16_384
    sample: int = 4_096
    max_cells: int = 1_024
    seed: int = 11


def chi_square_quantile(p: float, dims: int) -> float:
    """Of the chi-square distribution with an even number of degrees of freedom, by bisection of its closed form."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 100.0 + 10 * dims
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def split_leaves(points: np.ndarray, most: int, deepest: int = 40) -> list[np.ndarray]:
    """A kd-tree's leaves as row numbers: halves at the median of the widest dimension; equal points stay whole."""
    done, open_ = [], [(np.arange(len(points)), 0)]
    while open_:
        rows, depth = open_.pop()
        own = points[rows]
        spread = own.max(0) - own.min(0) if len(rows) else np.zeros(1)
        if len(rows) <= most or depth >= deepest or not spread.max() > 0:
            done.append(rows)
            continue
        d = int(np.argmax(spread))
        order = rows[np.argpartition(own[:, d], len(rows) // 2)]
        open_ += [(order[: len(rows) // 2], depth + 1), (order[len(rows) // 2 :], depth + 1)]
    return done


@dataclass
class Cells:
    """A complete kd-tree: split dimension and value of each inner node, and the box of each cell."""

    dim: np.ndarray
    value: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(int(np.log2(len(self.low)))):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.dim[node]] > self.value[node])
        return node - len(self.dim)

    def distance(self, points: np.ndarray) -> np.ndarray:
        """Square distance of each point to each cell's box."""
        return box_distance(points, self.low, self.high)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - x, x - high[None, :, d]), 0) ** 2
    return out


def fit_cells(points: np.ndarray, cells: int) -> Cells:
    """A tree with a power of two cells, split at the medians of a sample's points."""
    depth = max(0, ceil(np.log2(max(1, cells))))
    dims = points.shape[1]
    dim, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    parts, boxes = [points], [(np.full(dims, -np.inf), np.full(dims, np.inf))]
    at = 0
    for _ in range(depth):
        next_parts, next_boxes = [], []
        for own, (low, high) in zip(parts, boxes, strict=True):
            d = int(np.argmax(own.var(0))) if len(own) else 0
            v = float(np.median(own[:, d])) if len(own) else 0.0
            dim[at], value[at] = d, v
            at += 1
            right_low, left_high = low.copy(), high.copy()
            right_low[d], left_high[d] = max(low[d], v), min(high[d], v)
            next_parts += [own[own[:, d] <= v], own[own[:, d] > v]]
            next_boxes += [(low, left_high), (right_low, high)]
        parts, boxes = next_parts, next_boxes
    return Cells(dim, value, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]))


@dataclass
class Model:
    """What tasks need of the fit: all of a bounded size."""

    settings: Settings
    longest: float
    matrix: np.ndarray
    cells: Cells
    salts: np.ndarray  # shards of each cell
    ids: np.ndarray
    vectors: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Projections of data vectors."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.c_[x, rest] @ self.matrix

    def lift_query(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries, brought to the common length: nearness keeps its order."""
        scaled = q * (self.longest / np.sqrt((q * q).sum(1)))[:, None]
        return scaled @ self.matrix[:-1]

    def square_distance(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of the common length, from inner products with the queries as they are."""
        return np.maximum(2 * self.longest**2 - 2 * score * self.longest / np.sqrt((q * q).sum(1)), 0)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has components, all finite numbers, and not all zero."""
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


class _Shard:
    """One shard's distinct vectors in leaf order, with each one's smallest ids."""

    def __init__(self, model: Model, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        by_vector = np.argsort(inverse, kind="stable")
        place = np.cumsum(np.bincount(inverse))
        x = x[first]
        points = model.lift(x)
        leaves = split_leaves(points, model.settings.leaf)
        perm = np.concatenate(leaves)
        self.ids = [ids[by_vector[place[i] - n : place[i]][: k + 1]] for i, n in zip(perm.tolist(), np.bincount(inverse)[perm].tolist(), strict=True)]
        self.x, self.points = x[perm], points[perm]
        self.border = np.r_[0, np.cumsum([len(leaf) for leaf in leaves])]
        self.low, self.high = np.array([points[leaf].min(0) for leaf in leaves]), np.array([points[leaf].max(0) for leaf in leaves])

    def projected(self, asked: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Square distances of projected queries to projected vectors, leaf by leaf; infinite in leaves beyond a query's limit."""
        out = np.full((len(asked), len(self.points)), np.inf)
        opens = box_distance(asked, self.low, self.high) <= limit[:, None]
        for leaf in np.flatnonzero(opens.any(0)).tolist():
            who, own = np.flatnonzero(opens[:, leaf]), self.points[self.border[leaf] : self.border[leaf + 1]]
            out[who, self.border[leaf] : self.border[leaf + 1]] = (asked[who] ** 2).sum(1)[:, None] - 2 * asked[who] @ own.T + (own**2).sum(1)[None, :]
        return out

    def search(self, model: Model, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> tuple[list, list, list, np.ndarray]:
        """Query id, vector id and score of the k best of each query, its own id excepted; and how many vectors each query verified."""
        keep = k + 9  # the query's own vector, and more for the last digits of the fast product
        n, total = len(q), len(self.x)
        near = self.projected(model.lift_query(q), bound * factor)
        order = np.argsort(near, axis=1)
        near = np.take_along_axis(near, order, 1)
        best, row = np.full((n, keep), -np.inf), np.full((n, keep), -1, np.int64)
        verified, reach = np.zeros(n, np.int64), bound.copy()
        active, at, step = np.arange(n), 0, 2 * keep
        while at < total and len(active := active[np.isfinite(near[active, at]) & (near[active, at] <= reach[active] * factor)]):
            rows = order[active, at : at + step]
            shown = np.isfinite(near[active, at : at + step])
            scores = np.c_[best[active], np.where(shown, (self.x[rows] @ q[active][:, :, None])[:, :, 0], -np.inf)]
            rows = np.c_[row[active], np.where(shown, rows, -1)]
            top = np.argpartition(-scores, keep - 1, axis=1)[:, :keep]
            best[active], row[active] = np.take_along_axis(scores, top, 1), np.take_along_axis(rows, top, 1)
            verified[active] += shown.sum(1)
            # the k-th best without the query itself; copies of a vector count once, which only delays the stop
            kth = -np.partition(-best[active], k, axis=1)[:, k]
            fine = np.isfinite(kth)
            reach[active[fine]] = np.minimum(reach[active[fine]], model.square_distance(q[active[fine]], kth[fine]))
            at, step = at + step, min(2 * step, 256)
        out: tuple[list, list, list] = ([], [], [])
        for i in range(n):
            rows = row[i][row[i] >= 0]
            score = (self.x[rows] * q[i]).sum(1)
            found = sorted((-s, v) for s, r in zip(score.tolist(), rows.tolist(), strict=True) for v in self.ids[r].tolist() if v != query_ids[i])[:k]
            out[0].extend([query_ids[i]] * len(found))
            out[1].extend(v for _, v in found)
            out[2].extend(-s for s, _ in found)
        return *out, verified


def fit(vectors: DataFrame, settings: Settings) -> Model:
    """From the longest vector, the number of rows (at least one), and a sample: the rows of the smallest id hashes."""
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    total = vectors.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).toArrow().combine_chunks()
    ids = sample.column("vec_id").to_numpy()
    x = np.array(sample.column("vector").to_pylist(), np.float64)
    rng = np.random.default_rng(settings.seed)
    model = Model(settings, total["longest"] * (1 + 1e-9), rng.standard_normal((x.shape[1] + 1, settings.dims)), None, np.ones(1, np.int64), ids, x)
    model.cells = fit_cells(model.lift(x), min(settings.max_cells, max(1, total["n"] // settings.shard), max(1, len(x) // 8)))
    return model


def search(embeddings: DataFrame, queries: Column, k: int = 20, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest vectors by inner product of each row for which `queries` holds, among all other rows.

    Returns query_id, rank (from 1), vec_id, score (double precision, on the vectors as they are); ties go
    to the smaller id. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    rows without an id. Vectors of different lengths have no inner product: a query's candidates are those of
    its length, and each length is searched by itself. Of rows that repeat an id, each counts as a candidate
    once at its best, and rows of the query's own id never; a repeated query asks with its shortest, then
    smallest vector. Extra columns aren't read.
    """
    spark = embeddings.sparkSession
    plain = embeddings.select(embeddings[id_col].cast("bigint").alias("vec_id"), embeddings[vector_col].alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    plain = plain.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    asked = plain.where("asks").groupBy("vec_id").agg(F.min(F.struct(F.size("vector").alias("dim"), "vector")).alias("v")).select("vec_id", "v.*")
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for r in asked.select("dim").distinct().orderBy("dim").toLocalIterator():
        own = F.size("vector") == r["dim"]
        out = out.unionByName(_search_length(plain.where(own), asked.where(own), r["dim"], k, settings))
    return out


def _search_length(plain: DataFrame, asked: DataFrame, dim: int, k: int, settings: Settings) -> DataFrame:
    """search among vectors of one length: rows of `plain`, queries of `asked`."""
    spark = plain.sparkSession
    model = fit(plain, settings)
    factor = chi_square_quantile(settings.found, settings.dims)
    number = spark.sparkContext.broadcast(model)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = number.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(m.cells.of(m.lift(_matrix(batch.column(1), dim))).astype(np.int32)), batch.column(0), batch.column(1)], names=["cell", "vec_id", "vector"])

    kind = plain.schema["vector"].dataType.simpleString()
    dealt = plain.select("vec_id", "vector").mapInArrow(cells, f"cell int, vec_id bigint, vector {kind}")
    salts = np.ones(len(model.cells.low), np.int64)
    if len(salts) > 1 or model.settings.shard < len(model.ids):
        for r in dealt.groupBy("cell").count().collect():
            salts[r["cell"]] = ceil(r["count"] / (2 * settings.shard))
    else:
        salts[0] = ceil(plain.count() / (2 * settings.shard))
    model.salts = salts
    before = np.cumsum(salts) - salts
    shared = spark.sparkContext.broadcast(model)
    base, width = F.array(*map(F.lit, before.tolist())), F.array(*map(F.lit, salts.tolist()))
    shard = F.get(base, F.col("cell")) + F.pmod(F.xxhash64("vec_id"), F.get(width, F.col("cell")))
    data = dealt.select(shard.cast("bigint").alias("shard"), F.lit(False).alias("asks"), "vec_id", "vector", F.lit(0.0).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        first = np.cumsum(m.salts) - m.salts
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                ids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
                scores = q @ m.vectors.T
                scores[ids[:, None] == m.ids[None, :]] = -np.inf
                bound = np.full(len(q), np.inf)
                if scores.shape[1] > k:
                    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    fine = np.isfinite(kth)
                    bound[fine] = m.square_distance(q[fine], kth[fine]) * (1 + 1e-9)
                row, cell = np.nonzero(m.cells.distance(m.lift_query(q)) <= bound[:, None] * factor)
                n = m.salts[cell]
                rows = np.repeat(row, n)
                shards = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(rows), 4096):
                    take = pa.array(rows[a : a + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(shards[a : a + 4096]), pa.array(np.ones(len(take), bool)), batch.column(0).take(take), batch.column(1).take(take), pa.array(bound[rows[a : a + 4096]])], names=["shard", "asks", "vec_id", "vector", "bound"])

    asked = asked.select("vec_id", "vector").mapInArrow(route, f"shard bigint, asks boolean, vec_id bigint, vector {kind}, bound double")
    ordered = data.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        now, held, tree = None, [], None
        for batch in batches:
            shards, asks, ids, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            if not len(ids):
                continue
            x = _matrix(batch.column(3), dim)
            border = np.r_[np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])]), len(ids)]
            for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                if shards[a] != now:
                    now, held, tree = shards[a], [], None
                if not asks[a]:
                    held.append((ids[a:b], x[a:b].copy()))
                    continue
                if tree is None and held:
                    tree = _Shard(m, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    held = []
                for c in range(a, b if tree else a, 64):
                    d = min(b, c + 64)
                    found = tree.search(m, ids[c:d], x[c:d], bounds[c:d], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = ordered.mapInArrow(find, "query_id bigint, vec_id bigint, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
