"""Centroid clustering on bit planes: dot products as weighted popcounts of ANDed 64-bit words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import durable
from pvflow.llm.vectors import gathered, is_clean, matrix, slot_sums, whole

#: Components of a vector: a plane holds one bit of each in a 64-bit word.
WIDTH = 64
#: Vectors worked on at once: bounds what a worker holds (rows x centroids counts).
ROWS = 4_096


def planes_for(low: int, high: int) -> int:
    """Bits of the two's complement that holds ``low`` to ``high``."""
    return max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0) + 1


def pack(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Whole vectors (n x 64) as bit planes (n x planes): bit d of plane i is bit i of component d."""
    out = np.empty((len(vectors), planes), np.uint64)
    for i in range(planes):
        bits = ((vectors >> i) & 1).astype(np.uint8)
        out[:, i] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def unpack(words: np.ndarray) -> np.ndarray:
    n, planes = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words, "<u8").view(np.uint8), axis=1, bitorder="little")
    return np.tensordot(bits.reshape(n, planes, WIDTH).astype(np.int64), weights(planes), axes=(1, 0))


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts for: powers of two, the last plane being the sign."""
    w = 1 << np.arange(planes, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows with all others: the sum over pairs of planes of weight x common bits."""
    w = weights(words.shape[1])
    out = np.zeros((len(words), len(others)), np.int64)
    for i, wi in enumerate(w):
        for j, wj in enumerate(w):
            common = np.bitwise_count(words[:, i, None] & others[None, :, j])
            out += common * (wi * wj)
    return out


def squares(words: np.ndarray) -> np.ndarray:
    """The squared length of each row, from pairs of its own planes."""
    w = weights(words.shape[1])
    common = np.bitwise_count(words[:, :, None] & words[:, None, :]).astype(np.int64)
    return np.einsum("nij,i,j->n", common, w, w)


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, ties to the lower number, and the squared distance to it."""
    dist = squares(words)[:, None] - 2 * dots(words, centroids) + squares(centroids)[None, :]
    best = dist.argmin(axis=1)
    return best, dist[np.arange(len(best)), best]


def _words(batch: pa.RecordBatch) -> np.ndarray:
    return matrix(batch.column("planes")).view(np.uint64)


def _pack(planes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, ROWS):
            words = pack(matrix(batch.column("comps")), planes).view(np.int64)
            offsets = np.arange(0, words.size + 1, planes, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], names=["vec_id", "planes"])

    return run


def _sums(centroids: np.ndarray):
    """Per task: for each centroid the sums of its vectors' components, then their count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in gathered(batches, ROWS):
            words = _words(batch)
            best, _ = nearest(words, centroids)
            out = np.zeros((len(centroids), WIDTH + 1), np.int64)
            np.add.at(out, best, np.column_stack([unpack(words), np.ones(len(words), np.int64)]))
            yield out

    return partial


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, ROWS):
            best, dist = nearest(_words(batch), centroids)
            arrays = [batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(dist)]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    return run


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = 40, rounds: int = 5, salt: str = "2:") -> DataFrame:
    """k-means over whole vectors of 64 components: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are packed once into bit planes, as many as the smallest and largest component need, and written; every
    round reads only these. Each task passes on sums per centroid, and Spark adds them up. The driver holds the
    centroids (centroids x 64 integers). Nothing is dealt by cluster, so one of any size costs no more than others.
    The first centroids are the vectors with the smallest sha256 of ``salt`` and the id.

    * Vectors null, of another length, or with a null, NaN or infinite component are dropped; components beyond
      +-2^24 after scaling are held at that bound.
    * Repeated rows each count and each return a row. Rows without id are kept; they start no centroid unless rows
      with ids are too few. Rows of equal id go by their vectors.
    * With fewer vectors than ``centroids`` there are fewer clusters; an empty table gives no rows.
    * Further columns, of whatever name, are left out.
    """
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    vectors = vectors.where(is_clean(F.col("v")) & (F.size("v") == WIDTH)).select("vec_id", whole(F.col("v")).alias("comps"))
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    low, high = vectors.agg(F.min(F.array_min("comps")), F.max(F.array_max("comps"))).head()
    if low is None:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    planes = planes_for(low, high)
    order = [F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "comps"]
    seeds = [row.comps for row in vectors.orderBy(*order).limit(centroids).select("comps").collect()]
    packed = durable(vectors.mapInArrow(_pack(planes), f"vec_id {kind}, planes array<bigint>"), "planes")

    at = np.array(seeds, np.int64)
    for _ in range(rounds):
        sums = slot_sums(packed, _sums(pack(at, planes)), (len(at), WIDTH + 1))
        for c in np.flatnonzero(sums[:, WIDTH]):
            at[c] = [total // sums[c, WIDTH] for total in sums[c, :WIDTH]]

    assigned = durable(packed.mapInArrow(_assign(pack(at, planes)), f"vec_id {kind}, cluster int, distance bigint"), "clusters")
    of = {row.cluster: int(row.total) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    facts = [(c, inertia, sum(of.values()), digests[c]) for c, inertia in sorted(of.items())]
    # At most as many rows as there are centroids.
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))
    return assigned.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
