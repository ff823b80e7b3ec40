"""Nearest neighbours by largest inner product: vantage-point trees per shard, pruned by the triangle inequality."""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvflow.llm.common import durable
from pvflow.llm.vectors import gathered, is_clean, matrix

#: Distinct vectors of a leaf.
LEAF = 256
#: Vectors of a shard, and queries that meet a shard in one task: they bound what a worker holds.
SHARD = 4_096
GROUP = 4_096
#: Bytes of an Arrow batch, a few trees.
ARROW_BYTES = str(16 << 20)


class Tree(NamedTuple):
    """A vantage-point tree over ``points``, which are in the order of the leaves.

    Node i takes points ``span[i]``; the first of them is its vantage point. ``child[i]`` are the nodes inside and
    outside (-1: a leaf), ``ring[i]`` the least and the largest distance of the points inside, then outside.
    """

    points: np.ndarray
    order: np.ndarray
    span: np.ndarray
    child: np.ndarray
    ring: np.ndarray
    reach: float


def lifted(products: np.ndarray, reach: float) -> np.ndarray:
    """Distances out of products with a vector of length ``reach``, on the sphere of that radius.

    A point x of the shard is thought of with one more component sqrt(reach^2 - |x|^2), where ``reach`` is the largest
    length in the shard. All points then have that length, and the nearest one has the largest product.
    """
    return np.sqrt(np.maximum(0.0, 2 * reach * reach - 2 * products))


def build(points: np.ndarray) -> Tree:
    """Halve the points around a vantage point, the farthest one from the last vantage point, down to leaves."""
    lengths = np.sqrt((points * points).sum(axis=1))
    reach = float(lengths.max(initial=0.0))
    extra = np.sqrt(np.maximum(0.0, reach * reach - lengths * lengths))
    order = np.arange(len(points))
    span, child, ring = [], [], []

    def node(lo: int, hi: int, far: np.ndarray | None) -> int:
        me = len(span)
        span.append((lo, hi))
        child.append((-1, -1))
        ring.append((0.0, 0.0, 0.0, 0.0))
        if hi - lo <= LEAF:
            return me
        if far is not None:
            k = int(far.argmax())
            order[[lo, lo + k]] = order[[lo + k, lo]]
        v, rest = order[lo], order[lo + 1 : hi].copy()
        dist = lifted(points[rest] @ points[v] + extra[rest] * extra[v], reach)
        half = len(rest) // 2
        by = np.argsort(dist, kind="stable")
        order[lo + 1 : hi], dist = rest[by], dist[by]
        ring[me] = (dist[0], dist[half - 1], dist[half], dist[-1])
        mid = lo + 1 + half
        child[me] = (node(lo + 1, mid, dist[:half]), node(mid, hi, dist[half:]))
        return me

    if len(points):
        node(0, len(points), None)
    return Tree(points[order], order, np.array(span, np.int64).reshape(-1, 2), np.array(child, np.int64).reshape(-1, 2), np.array(ring).reshape(-1, 4), reach)


def search(tree: Tree, queries: np.ndarray, keep: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``keep`` largest products of each query with the tree's points, the points' rows, and how many products it took.

    A subtree is left out for a query when the least distance that the triangle inequality allows there is above
    ``factor`` times the distance of its ``keep``-th best so far: with factor 1 no better point can be in it (points
    as good as the last one are still looked at), a smaller factor leaves out more. Queries go down together, each into
    the nearer half first. Equal products go to the lower row of ``order``; missing ones are -inf and -1. Products below
    a query's ``floor``, that of its last place so far, are not wanted; what is found may be less than ``keep`` then.
    """
    m = len(queries)
    best, rows = np.full((m, keep), -np.inf), np.full((m, keep), -1, np.int64)
    lengths = np.sqrt((queries * queries).sum(axis=1))
    scale = np.divide(tree.reach, lengths, out=np.zeros(m), where=lengths > 0)
    slack = 1e-7 * max(tree.reach, 1e-300)
    # sums in another order differ by some units in the last place
    floor = np.full(m, -np.inf) if floor is None else floor - 1e-9 * tree.reach * lengths
    done = 0

    def last(q: np.ndarray) -> np.ndarray:
        return np.maximum(best[q, -1], floor[q])

    def take(q: np.ndarray, products: np.ndarray, lo: int) -> None:
        nonlocal done
        done += products.size
        good = (products >= last(q)[:, None]).sum(axis=1)
        some = good > 0
        q, products = q[some], products[some]
        if len(q):
            found = np.broadcast_to(tree.order[lo : lo + products.shape[1]], products.shape)
            if (most := int(good.max())) < products.shape[1]:  # the largest ones hold all that are good enough
                few = np.argpartition(products, products.shape[1] - most, axis=1)[:, -most:]
                products, found = np.take_along_axis(products, few, 1), np.take_along_axis(found, few, 1)
            values, names = np.concatenate([best[q], products], axis=1), np.concatenate([rows[q], found], axis=1)
            by = np.lexsort((names, -values), axis=1)[:, :keep]
            best[q], rows[q] = np.take_along_axis(values, by, 1), np.take_along_axis(names, by, 1)

    def visit(at: int, q: np.ndarray) -> None:
        lo, hi = tree.span[at]
        inside, outside = tree.child[at]
        if inside < 0:
            take(q, queries[q] @ tree.points[lo:hi].T, lo)
            return
        products = queries[q] @ tree.points[lo]
        take(q, products[:, None], lo)
        dist = lifted(products * scale[q], tree.reach)
        near, middle, beyond, far = tree.ring[at]
        low = {inside: np.maximum(np.maximum(near - dist, dist - middle), 0), outside: np.maximum(np.maximum(beyond - dist, dist - far), 0)}
        first = dist * 2 < middle + beyond

        def go(to: int, which: np.ndarray) -> None:
            worst = last(q)
            bound = factor * lifted(worst * scale[q], tree.reach) + slack
            which = which & ((low[to] <= bound) | ~np.isfinite(worst))
            if which.any():
                visit(to, q[which])

        go(inside, first)
        go(outside, ~first)
        go(outside, first)
        go(inside, ~first)

    if len(tree.points) and m:
        visit(0, np.arange(m))
    return best, rows, done


def _shards(keep: int):
    """Cut what a task gets into shards and build their trees; equal vectors are one point with its smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, SHARD):
            width = batch.column("width").to_numpy()
            made = []
            for w in np.unique(width):
                some = batch.filter(pa.array(width == w))
                ids, vectors = some.column("vec_id").to_numpy(), matrix(some.column("v"), np.float64)
                by = np.argsort(ids, kind="stable")
                ids, vectors = ids[by], vectors[by]
                _, first, point = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
                point = np.argsort(np.argsort(first))[point.ravel()]  # points in the order of their smallest id
                by = np.lexsort((ids, point))
                ids, point = ids[by], point[by]
                starts = np.searchsorted(point, np.arange(len(first)))
                few = np.arange(len(ids)) - starts[point] < keep
                tree = build(vectors[np.sort(first)])
                buffer = io.BytesIO()
                np.savez(buffer, ids=ids[few], starts=np.searchsorted(point[few], np.arange(len(first) + 1)), **tree._asdict())
                made.append((int(w), buffer.getvalue()))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())], names=["width", "tree"])

    return run


class _Group:
    """Queries that meet the trees of a bucket one after the other, with the ``k`` best rows found so far."""

    def __init__(self, k: int, factor: float):
        self.k, self.factor = k, factor
        self.batches: list[pa.RecordBatch] = []
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))  # query's place, vec_id, score

    def ask(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def _asked(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and vectors of the queries of one length."""
        if not hasattr(self, "queries"):
            self.queries = pa.Table.from_batches(self.batches).combine_chunks()
            self.ids = self.queries.column("query_id").to_numpy()
            self.widths = self.queries.column("width").to_numpy()
            self.floor = np.full(len(self.ids), -np.inf)
        if width not in self.by_width:
            mine = self.widths == width
            vectors = matrix(self.queries.filter(pa.array(mine)).column("v").combine_chunks(), np.float64) if mine.any() else np.empty((0, width))
            self.by_width[width] = np.flatnonzero(mine), vectors
        return self.by_width[width]

    def meet(self, width: int, blob: bytes) -> None:
        place, vectors = self._asked(width)
        if not len(place):
            return
        data = np.load(io.BytesIO(blob))
        tree = Tree(*[data[f] for f in Tree._fields])
        tree = tree._replace(reach=float(tree.reach))
        ids, starts = data["ids"], data["starts"]
        # One point may be the query's own, and k + 1 points hold k ids of others however products tie.
        _, rows, _ = search(tree, vectors, self.k + 1, self.factor, self.floor[place])
        q, at = np.nonzero(rows >= 0)
        rows = rows[q, at]
        places = np.empty(len(tree.points), np.int64)
        places[tree.order] = np.arange(len(tree.points))
        score = np.zeros(len(q))
        for d in range(width):  # in the order of the components, so that equal vectors have equal scores
            score += vectors[q, d] * tree.points[places[rows], d]
        n = starts[rows + 1] - starts[rows]
        which = np.repeat(np.arange(len(q)), n)
        found = ids[np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        q, score = place[q[which]], score[which]
        other = found != self.ids[q]
        new = q[other], found[other], score[other]
        q, found, score = (np.concatenate(pair) for pair in zip(self.best, new, strict=True))
        by = np.lexsort((found, -score, q))
        q, found, score = q[by], found[by], score[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.floor[q[rank == self.k - 1]] = score[rank == self.k - 1]
        self.best = tuple(x[rank < self.k] for x in (q, found, score))

    def answer(self) -> pa.RecordBatch:
        q, found, score = self.best
        asked = self.queries.take(pa.array(q)) if len(q) else None
        if asked is None:
            arrays = [pa.array([], pa.int64()), pa.array([], pa.int64())]
        else:
            arrays = [asked.column(c).combine_chunks() for c in ("query_id", "query")]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(found), pa.array(score)], names=["query_id", "query", "vec_id", "score"])


def _nearest(k: int, factor: float):
    """Over rows in the order (bucket, part, queries first): one group of queries and one tree are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, trees = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "is_tree"))
            change = (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (trees[1:] != trees[:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                if key != (now := (bucket[start], part[start])):
                    if group is not None:
                        yield group.answer()
                    key, group = now, _Group(k, factor)
                some = batch.slice(start, end - start)
                if not trees[start]:
                    group.ask(some.select(["query_id", "query", "width", "v"]))
                elif group.batches:
                    for width, blob in zip(some.column("width"), some.column("tree"), strict=True):
                        group.meet(width.as_py(), blob.as_py())
        if group is not None:
            yield group.answer()

    return run


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, factor: float = 1.0) -> DataFrame:
    """The ``k`` rows of largest inner product for each query row: query_id, rank, vec_id, score.

    All rows are dealt into shards, and each shard becomes one vantage-point tree, written as a row of an index table.
    Queries go in groups of about ``GROUP``. Each group meets every tree: the trees are dealt into as many buckets as
    keep the cores busy, and a task takes one group through the trees of one bucket, so that the best found so far
    prunes the next tree and one list of ``k`` per (query, bucket) goes on to a window that keeps the best. As groups
    grow in number with the queries, buckets get fewer. Equal vectors, however many, are one point of a tree with its
    k + 1 smallest ids, which is all a query can need. ``factor`` 1 is exact; below it more is left out (``search``).

    * Rows whose vector is null, empty, all zero, or holds a null, NaN or infinite component take no part, nor do rows
      without id. Vectors are compared with vectors of their own length only.
    * Repeated rows (equal id and vector) count once. Rows that share an id but not the vector are queries and
      candidates of their own, but none is a candidate of a query with its id.
    * Ties go to the smaller id. A query without candidates has no rows; an empty table gives none.
    * Further columns, of whatever name, are left out. ``is_query`` is a condition on ``vec_id``.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor is above 0 and at most 1")
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & is_clean(F.col("v")) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id", "v").agg(F.first(F.size("v")).alias("width"))
    trees = durable(rows.mapInArrow(_shards(k + 1), "width int, tree binary"), "trees")
    queries = durable(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v", "width", F.xxhash64("vec_id", "v").alias("query")), "queries")
    n_trees, groups = trees.count(), max(1, -(-queries.count() // GROUP))
    buckets = max(1, min(n_trees, -(-2 * spark.sparkContext.defaultParallelism // groups)))
    spread = trees.withColumn("bucket", F.pmod(F.xxhash64("tree"), F.lit(buckets)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.withColumn("part", F.pmod(F.col("query"), F.lit(groups)).cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    met = asked.withColumn("is_tree", F.lit(False)).unionByName(spread.withColumn("is_tree", F.lit(True)), allowMissingColumns=True)
    met = met.repartition(buckets * groups, "bucket", "part").sortWithinPartitions("bucket", "part", "is_tree")
    found = met.mapInArrow(_nearest(k, factor), "query_id bigint, query bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
