"""Vector code compression: product codes learned by a lexicographic trie over distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import durable
from pvflow.llm.vectors import gathered, is_clean, matrix, slot_sums, whole

#: Vectors of one trie: bounds what a worker holds (rows x entries distances at the leaves of a block).
TRIE_ROWS = 16_384
#: A subtree of at most so many leaves is finished level by level, a larger one child by child.
BLOCK = 2_048


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and squared distance of each part; ``parts`` are distinct and in lexicographic order.

    The rows are the leaves of a trie whose level k branches on component k. A node holds one vector: the squared
    distance of its prefix to the prefixes of all entries. Children add one component to it, so leaves below a common
    prefix share that part of the work. Ties go to the lower entry.
    """
    n, width = parts.shape
    best, dist = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        lo, hi, depth, held = stack.pop()
        if hi - lo > BLOCK and depth < width:
            column = parts[lo:hi, depth]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])
            ends = np.append(starts[1:], hi - lo)
            for start, end in zip(starts[::-1], ends[::-1], strict=True):
                step = column[start] - entries[:, depth]
                stack.append((lo + int(start), lo + int(end), depth + 1, held + step * step))
            continue
        node = np.zeros(hi - lo, np.int64)  # of each leaf, its node on the present level
        sums = held[None, :]
        for k in range(depth, width):
            column = parts[lo:hi, k]
            first = np.ones(hi - lo, bool)
            first[1:] = (node[1:] != node[:-1]) | (column[1:] != column[:-1])
            at = np.flatnonzero(first)
            step = column[at, None] - entries[None, :, k]
            sums = sums[node[at]] + step * step
            node = np.cumsum(first) - 1
        best[lo:hi] = sums.argmin(axis=1)[node]
        dist[lo:hi] = sums.min(axis=1)[node]
    return best, dist


def distinct(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each occurs, and which one each row is."""
    order = np.lexsort(parts.T[::-1])
    rows = parts[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    index = np.empty(len(rows), np.int64)
    index[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    return rows[at], np.diff(np.append(at, len(rows))), index


def _sums(books: np.ndarray):
    """Per task: for each position and entry the sums of its parts' components, then their count."""
    positions, entries, width = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in gathered(batches, TRIE_ROWS):
            vectors = matrix(batch.column("comps"))
            out = np.zeros((positions, entries, width + 1), np.int64)
            for p in range(positions):
                leaves, weights, _ = distinct(vectors[:, p * width : (p + 1) * width])
                best, _ = walk(leaves, books[p])
                weighted = np.column_stack([leaves * weights[:, None], weights])
                np.add.at(out[p], best, weighted)
            yield out

    return partial


def _encode(books: np.ndarray):
    positions, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TRIE_ROWS):
            vectors = matrix(batch.column("comps"))
            codes = np.empty((len(vectors), positions), np.uint8)
            error = np.zeros(len(vectors), np.int64)
            for p in range(positions):
                leaves, _, index = distinct(vectors[:, p * width : (p + 1) * width])
                best, dist = walk(leaves, books[p])
                codes[:, p] = best[index]
                error += dist[index]
            text = pa.array([row.tobytes().hex() for row in codes], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positions: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """Product codes of all clean vectors: vec_id, label, code, error, label_error, codebooks_sha256.

    Components become whole numbers (``whole``: beyond +-2^24 they are held at that bound). Each position's codebook
    starts as that part of the ``entries`` first vectors by id (ids null last, equal ids by their vectors) and takes
    ``rounds`` rounds of nearest entry and componentwise floor of the mean. Each task works on tries of its own
    distinct parts and passes on sums; no part is shuffled, so a vector that fills a third of the table costs no
    more than others. Codebooks (positions x entries x width integers) are all that the driver holds.

    * Rows whose vector is null, or holds a null, NaN or infinite component, are dropped.
    * The width is set by the first clean vector, in the order above, whose length is a positive multiple of
      ``positions``; vectors of other lengths are dropped.
    * Repeated rows each count and each return a row. Rows without id or label are kept; labels null sum together.
    * With fewer vectors than ``entries`` the books are shorter; an empty table gives no rows.
    * Further columns, of whatever name, are left out.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(is_clean(F.col("v")))
    first = vectors.where((F.size("v") > 0) & (F.size("v") % positions == 0)).orderBy(F.col("vec_id").asc_nulls_last(), whole(F.col("v")), "v").select(F.size("v")).head()
    out = "vec_id {}, label {}, code string, error bigint".format(*[vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")])
    if first is None:
        empty = vectors.sparkSession.createDataFrame([], out + ", label_error bigint, codebooks_sha256 string")
        return empty
    width = first[0] // positions
    vectors = durable(vectors.where(F.size("v") == first[0]).select("vec_id", "label", whole(F.col("v")).alias("comps")), "vectors")

    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "comps").limit(entries).select("comps").collect()
    books = np.array([s[0] for s in seeds], np.int64).reshape(len(seeds), positions, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = slot_sums(vectors, _sums(books), (positions, len(seeds), width + 1))
        for p, e in zip(*np.nonzero(sums[:, :, width]), strict=True):
            books[p, e] = [total // sums[p, e, width] for total in sums[p, e, :width]]

    coded = durable(vectors.mapInArrow(_encode(books), out), "codes")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # Written, so that Spark knows its size and broadcasts it only if it is small.
    by_label = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
