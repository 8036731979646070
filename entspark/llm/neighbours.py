"""Approximate nearest neighbours by a few stable projections, kd-trees and a chi-square stopping test.

A vector is projected on M Gaussian directions.  As the normal distribution is
2-stable, the squared projected distance of two vectors over their squared
distance follows a chi-square distribution of M degrees.  So once the next
projected neighbour is at a distance D with ``P(chi2_M <= D^2 / d^2)`` at least
CONFIDENCE, where d is the distance of the k-th neighbour verified so far, a
better one is still ahead with a small probability only, and search stops.

The projected space is cut by a kd-tree.  Its top, made from a bounded sample,
cuts the table into cells; every row is in one.  Of vectors that are equal the
k + 1 least vec_ids are kept, as no more can be among the k nearest.  In a cell
a kd-tree of leaves orders the projected neighbours.

A query visits the cells by projected distance in rounds: its own, the next 4,
the next 16, and so on.  Before each round the test, with the distance of the
k-th neighbour that it has by then, rules out cells, and it is done when it
rules out all that are left.  Verifying is by true distance.  A cell of more
than CELL_ROWS rows is searched in chunks, and one that more than ASK_ROWS
queries ask in slices of these, so no task holds more than a chunk of rows and a
batch of queries.

Queries are rows of the table, all or those of a condition; no list of
candidates is cut, and expected recall is CONFIDENCE or more.

Defined results: null and empty vectors, those with a null or non-finite part,
those of another length than most, and null ids have no rows and are no one's
neighbour.  Rows that repeat a vec_id count once (the least vector of it).  A
vector isn't its own neighbour; other ids with an equal vector are, at distance
0.  Equal distances go by vec_id.  A table of k rows or fewer gives the
neighbours there are, an empty one none.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K

NEIGHBOURS = 10
#: Directions (an even number) and the confidence of the stopping test.
M, CONFIDENCE = 8, 0.95
CELL_ROWS, LEAF_ROWS = 4_096, 128
#: Projected rows from which the top of the tree is made; a cell has LEAST_SAMPLE of them at least.
SAMPLE_ROWS, LEAST_SAMPLE = 20_000, 4
#: Queries of a cell that one task answers, and that are answered together.
ASK_ROWS, ASK_BATCH = 65_536, 1_024
#: A round visits so many times the cells of the one before.
GROWTH = 4
SEED = 20


def chi2_cdf(x: float | np.ndarray, degrees: int = M):
    """P(chi2 <= x) of an even number of degrees of freedom."""
    half = np.asarray(x, float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_quantile(p: float, degrees: int = M) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < p else (low, mid)
    return high


def directions(dims: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dims, m))


class Boxes:
    """A kd-tree's leaves: the rows of each and the bounds of the projected rows."""

    def __init__(self, y: np.ndarray, leaf: int = LEAF_ROWS):
        self.rows: list[np.ndarray] = []
        todo = [np.arange(len(y))]
        while todo:
            own = todo.pop()
            if len(own) <= leaf:
                self.rows.append(own)
                continue
            part = y[own]
            axis = int(np.argmax(part.max(0) - part.min(0)))
            by = np.argpartition(part[:, axis], len(own) // 2)
            todo += [own[by[: len(own) // 2]], own[by[len(own) // 2 :]]]
        self.low = np.array([y[r].min(0) for r in self.rows])
        self.high = np.array([y[r].max(0) for r in self.rows])


def gap2(low: np.ndarray, high: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared projected distances (rows of y) x (boxes)."""
    out = np.zeros((len(y), len(low)))
    for a in range(y.shape[1]):
        d = np.maximum(0, np.maximum(low[None, :, a] - y[:, None, a], y[:, None, a] - high[None, :, a]))
        out += d * d
    return out


class Best:
    """The k nearest of each query so far: distance^2 and id, sorted."""

    def __init__(self, many: int, k: int):
        self.d2, self.id = np.full((many, k), np.inf), np.full((many, k), -1, np.int64)

    def add(self, query: np.ndarray, d2: np.ndarray, ident: np.ndarray) -> None:
        own = np.unique(query)
        k = self.d2.shape[1]
        q = np.concatenate([np.repeat(own, k), query])
        d = np.concatenate([self.d2[own].ravel(), d2])
        i = np.concatenate([self.id[own].ravel(), ident])
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        first = np.searchsorted(q, own)
        take = (first[:, None] + np.arange(k)).ravel()
        self.d2[own], self.id[own] = d[take].reshape(-1, k), i[take].reshape(-1, k)


class Cell:
    """The rows of a cell, or of a chunk of it, in a kd-tree of leaves over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.ids, self.x, self.degrees = ids, x, y.shape[1]
        self.norm = (x * x).sum(1)
        self.leaves = Boxes(y) if len(ids) else None

    def search(self, q_ids: np.ndarray, qx: np.ndarray, qy: np.ndarray, k: int, bound2: np.ndarray | None = None, confidence: float = CONFIDENCE) -> Best:
        """The k nearest rows to each query; ``bound2`` are squared distances that must be beaten or met."""
        best = Best(len(q_ids), k)
        if self.leaves is None or not len(q_ids):
            return best
        stop = chi2_quantile(confidence, self.degrees)
        limit = np.full(len(q_ids), np.inf) if bound2 is None else bound2.astype(float)
        leaves = self.leaves
        for own in Boxes(qy).rows:
            gaps = gap2(leaves.low, leaves.high, qy[own])
            for leaf in np.argsort(gaps.min(0), kind="stable"):
                # a query is done with a leaf when the test holds at the leaf's projected distance
                active = own[gaps[:, leaf] <= stop * limit[own]]
                if not len(active):
                    continue
                rows = leaves.rows[leaf]
                d2 = np.maximum(0, (qx[active] ** 2).sum(1)[:, None] + self.norm[rows][None, :] - 2 * qx[active] @ self.x[rows].T)
                i, j = np.nonzero((d2 <= limit[active][:, None] * (1 + 1e-9) + 1e-9) & (self.ids[rows][None, :] != q_ids[active][:, None]))
                if not len(i):
                    continue
                exact = ((qx[active[i]] - self.x[rows[j]]) ** 2).sum(1)
                best.add(active[i], exact, self.ids[rows[j]])
                limit[active] = np.minimum(limit[active], best.d2[active, k - 1])
        return best


class Top:
    """The kd-tree over the sample whose leaves are the cells; a cell's bounds are its planes."""

    def __init__(self, y: np.ndarray, cells: int):
        m = y.shape[1] if y.ndim == 2 else M
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, value, left, right; a negative child is the cell -1 - child
        self.low, self.high = [], []
        self.root = self._split(y.reshape(-1, m), max(0, math.ceil(math.log2(max(1, cells)))), np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, y: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
        if depth and len(y) > 1:
            axis = int(np.argmax(y.max(0) - y.min(0)))
            value = float(np.median(y[:, axis]))
            left = y[:, axis] < value
            if left.any():
                at = len(self.nodes)
                self.nodes.append((axis, value, 0, 0))
                lower, upper = low.copy(), high.copy()
                upper[axis] = lower[axis] = value
                self.nodes[at] = (axis, value, self._split(y[left], depth - 1, low, upper), self._split(y[~left], depth - 1, lower, high))
                return at
        self.low.append(low)
        self.high.append(high)
        return -len(self.low)

    def cell(self, y: np.ndarray) -> np.ndarray:
        out = np.full(len(y), 0, np.int64)
        todo = [(self.root, np.arange(len(y)))]
        while todo:
            node, own = todo.pop()
            if node < 0:
                out[own] = -1 - node
                continue
            axis, value, a, b = self.nodes[node]
            left = y[own, axis] < value
            todo += [(a, own[left]), (b, own[~left])]
        return out


_VECTORS = "cell int, vec_id long, vector binary"
_ASKS = "cell int, chunk int, vec_id long, bound double, vector binary"
_FOUND = "vec_id long, neighbour_id long, d2 double"


def _answers(q_ids: np.ndarray, best: Best) -> pa.RecordBatch:
    i, j = np.nonzero(np.isfinite(best.d2))
    return pa.RecordBatch.from_arrays([pa.array(q_ids[i], pa.int64()), pa.array(best.id[i, j], pa.int64()), pa.array(best.d2[i, j], pa.float64())], names=["vec_id", "neighbour_id", "d2"])


def _decoder(kind: type, dims: int):
    return lambda column: np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(float)


def _ask(top: Top, chunks: list[int], project: np.ndarray, kind: type, stop: float, begin: int, end: int):
    """Queries (vec_id, vector, bound) -> what they ask of the cells that are the begin-th to end-th nearest, where the test doesn't hold."""
    matrix = _decoder(kind, len(project))
    rows = max(1, (1 << 20) // len(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = np.array(chunks)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                bound = part.column(2).to_numpy(zero_copy_only=False)
                gaps = gap2(top.low, top.high, matrix(part.column(1)) @ project)
                near = np.argsort(gaps, axis=1, kind="stable")[:, begin:end]
                i, j = np.nonzero(np.take_along_axis(gaps, near, 1) <= stop * bound[:, None])
                cell = near[i, j]
                i, chunk = np.repeat(i, many[cell]), np.concatenate([np.arange(n) for n in many[cell]]) if len(cell) else np.empty(0, int)
                cell = np.repeat(cell, many[cell])
                own = pa.array(i)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(chunk, pa.int32()), part.column(0).take(own), part.column(2).take(own), part.column(1).take(own)], names=["cell", "chunk", "vec_id", "bound", "vector"])

    return run


def _answer(project: np.ndarray, kind: type, k: int, confidence: float):
    """Rows sorted by (cell, chunk, slice), vectors before the queries that ask them -> what is found."""
    matrix = _decoder(kind, len(project))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, cell = None, [], None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(4))))  # cell, chunk, slice, asks
            a = 0
            while a < len(names):
                b = a
                while b < len(names) and names[b] == names[a] and b - a < ASK_BATCH:
                    b += 1
                part = batch.slice(a, b - a)
                if names[a][:3] != key:
                    key, rows, cell = names[a][:3], [], None
                if not names[a][3]:
                    rows.append(part)
                elif rows or cell:
                    if cell is None:
                        ids, x = np.concatenate([r.column(4).to_numpy() for r in rows]), np.concatenate([matrix(r.column(6)) for r in rows])
                        cell, rows = Cell(ids, x, x @ project), []
                    ids, x = part.column(4).to_numpy(), matrix(part.column(6))
                    yield _answers(ids, cell.search(ids, x, x @ project, k, part.column(5).to_numpy(zero_copy_only=False), confidence))
                a = b

    return run


def _nearest_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy("d2", "neighbour_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, confidence: float = CONFIDENCE, asking: str | None = None) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance) of the k nearest rows to every row, or to those for which the condition ``asking`` on vec_id holds."""
    single = isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType)
    kind, real = (np.float32, "float") if single else (np.float64, "double")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{real}>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    good = good.groupBy("vec_id").agg(F.min("v").alias("v"))
    spark = vectors.sparkSession
    lengths = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "vec_id long, rank int, neighbour_id long, distance double")
    dims, many = lengths["n"], lengths["count"]
    good = good.filter(F.size("v") == dims)
    project = directions(dims)
    point = K.unit_hash(F.lit("neighbours"), F.col("vec_id").cast("string"))
    sample = [r.v for r in good.filter(point < min(1.0, SAMPLE_ROWS / many)).select("v").collect()]
    top = Top(np.array(sample, float).reshape(-1, dims) @ project, min(-(-many // CELL_ROWS), max(1, len(sample) // LEAST_SAMPLE)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.array(top.cell(x.astype(float) @ project), pa.int32()), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cell", "vec_id", "vector"])

    placed = K.cut(good.mapInArrow(place, _VECTORS))
    equal = F.row_number().over(W.partitionBy("cell", "vector").orderBy("vec_id"))
    index = K.cut(placed.withColumn("_rn", equal).filter(F.col("_rn") <= k + 1).drop("_rn"))
    # as many numbers as the top has leaves, which the sample bounds
    chunks = [1] * len(top.low)
    for r in index.groupBy("cell").count().collect():
        chunks[r["cell"]] = -(-r["count"] // CELL_ROWS)
    queries = placed.filter(asking) if asking else placed
    queries = queries.select("vec_id", "vector")
    stop = chi2_quantile(confidence)
    found, begin, width = spark.createDataFrame([], _FOUND), 0, 1
    while begin < len(chunks):
        bounds = found.groupBy("vec_id").agg(F.when(F.count("*") == k, F.max("d2")).alias("bound"))
        bounded = queries.join(bounds, "vec_id", "left").select("vec_id", "vector", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        asks = K.cut(bounded.mapInArrow(_ask(top, chunks, project, kind, stop, begin, begin + width), _ASKS))
        asked = [(r["cell"], chunks[r["cell"]], -(-r["count"] // (chunks[r["cell"]] * ASK_ROWS))) for r in asks.groupBy("cell").count().collect()]
        begin, width = begin + width, width * GROWTH
        if not asked:
            break
        cells = F.broadcast(spark.createDataFrame(asked, "cell int, chunks int, slices int"))
        rows = index.join(cells, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"), "vec_id", F.lit(0.0).alias("bound"), "vector")
        turned = asks.join(cells, "cell").select("cell", "chunk", F.pmod(F.xxhash64("vec_id"), "slices").cast("int").alias("slice"), F.lit(True).alias("asks"), "vec_id", "bound", "vector")
        both = rows.unionByName(turned).repartition("cell", "chunk", "slice").sortWithinPartitions("cell", "chunk", "slice", "asks")
        found = K.cut(_nearest_of(found.unionByName(both.mapInArrow(_answer(project, kind, k, confidence), _FOUND)), k).drop("rank"))
    return _nearest_of(found, k).select("vec_id", "rank", "neighbour_id", F.round(F.sqrt("d2"), 6).alias("distance"))


#: The queries of ``query``: a stated set against all rows.
ASKING = "vec_id % 50 = 0"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(K.table(spark, sf_dir, "embeddings"), asking=ASKING)
