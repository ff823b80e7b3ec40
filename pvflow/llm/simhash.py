"""SimHash near-duplicates, linked through BK-trees.

Fingerprints at up to 4 differing bits agree wholly in 2 of 6 blocks of bits at least, so each distinct
fingerprint goes to one shard per pair of blocks, where it meets all its neighbours. A shard holds a BK-tree:
the children of a node are keyed by their integer Hamming distance to it, and a search follows only edges
within the radius of its own distance. Trees grow with the data, so they are not broadcast whole: the queries
of a tree are routed to it by the same key. A shard that grows large is cut into tiles of
bounded size, each with a tree over one part of the shard and another part as queries.

Copies are folded into one fingerprint first, and a tree reports a spanning star of each group it finds instead
of all pairs; the groups are then joined by alternating stars over the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import durable, map_columns

SHINGLE = 4
RADIUS = 4
BITS = 64
#: Blocks of bits; a pair within the radius shares all bits of ``BLOCKS - RADIUS`` of them at least.
BLOCKS = 6
#: Fingerprints of a shard beyond which it is cut into tiles, and the rows a task searches at once.
TILE = 4096
FLUSH_ROWS = 50_000
FRONTIER = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes (seed 42) of all ``size``-word shingles; 0 without words."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes.split cuts at the six white-space bytes only
    if not words:
        return 0
    counts, n = np.zeros(BITS, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, 1 << 14):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(at, min(n, at + (1 << 14)))]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a signed long ``fp``; a null text counts as empty."""

    def compute(texts: pa.Array) -> dict[str, pa.Array]:
        made = np.array([fingerprint(t, size) for t in texts.to_pylist()], np.uint64)
        return {"fp": pa.array(made.view(np.int64))}

    return map_columns(docs, [text], compute, "fp bigint")


class Forest:
    """BK-trees of many shards over one array of fingerprints; all trees grow and are searched level by level."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """``shard`` is sorted; the first fingerprint of each shard is the root of its tree."""
        n = len(fps)
        self.fps = fps
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = first[np.cumsum(np.isin(np.arange(n), first)) - 1] if n else first
        keys, children = [], []
        waiting = np.setdiff1d(np.arange(n), first)
        node = self.root[waiting]
        while len(waiting):
            edge = node * (BITS + 1) + np.bitwise_count(fps[waiting] ^ fps[node])
            # the first to arrive at an edge becomes the child there, the others go on below it
            edges, at, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(edges)
            children.append(waiting[at])
            settled = np.zeros(len(waiting), bool)
            settled[at] = True
            node, waiting = waiting[at][back][~settled], waiting[~settled]
        keys_all = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys_all)
        self.edges = keys_all[order]
        self.child = np.concatenate(children)[order] if children else np.zeros(0, np.int64)

    def search(self, query: np.ndarray, start: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``query``, node) within ``radius``, each query beginning at the node ``start``."""
        who, node = np.arange(len(query)), start
        found_q, found_n = [], []
        while len(who):
            if len(who) > FRONTIER:  # a broad search goes on in halves, so memory stays bounded
                half = len(who) // 2
                rest = [self._below(query, who[s], node[s], radius) for s in (slice(0, half), slice(half, None))]
                return np.concatenate(found_q + [r[0] for r in rest]), np.concatenate(found_n + [r[1] for r in rest])
            who, node, hit_q, hit_n = self._step(query, who, node, radius)
            found_q.append(hit_q)
            found_n.append(hit_n)
        empty = np.zeros(0, np.int64)
        return np.concatenate(found_q or [empty]), np.concatenate(found_n or [empty])

    def _below(self, query, who, node, radius):
        q, n = self.search(query[who], node, radius)
        return who[q], n

    def _step(self, query, who, node, radius):
        d = np.bitwise_count(query[who] ^ self.fps[node]).astype(np.int64)
        hit = d <= radius
        lo = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(d - radius, 0))
        hi = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
        many = hi - lo
        total = int(many.sum())
        at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        return np.repeat(who, many), self.child[at], who[hit], node[hit]


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the groups of each pair; ``parent`` maps every index to the least of its group."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def stars(shard: np.ndarray, fps: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least of its group) found in sorted shards; ``role`` as in ``links``."""
    inside = np.flatnonzero(role > 0)
    forest = Forest(fps[inside], shard[inside])
    shards, firsts = np.unique(shard[inside], return_index=True)
    # a shard without a tree has nothing to find
    at = np.minimum(np.searchsorted(shards, shard), max(len(shards) - 1, 0))
    asks = np.flatnonzero((shards[at] == shard) & (role != 1)) if len(shards) else inside
    parent = np.arange(len(fps))
    for begin in range(0, len(asks), 4096):
        part = asks[begin : begin + 4096]
        q, n = forest.search(fps[part], forest.root[firsts[at[part]]], radius)
        _join(parent, part[q], inside[n])
    moved = np.flatnonzero(parent != np.arange(len(fps)))
    least = fps.copy()
    np.minimum.at(least, parent, fps)
    a, b = fps[moved], fps[parent[moved]]
    return np.concatenate([a, b]), np.concatenate([least[parent[moved]]] * 2)


def block_keys(fp: str, radius: int = RADIUS, blocks: int = BLOCKS):
    """One shard key per choice of blocks that must agree."""
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (ends[i + 1] - ends[i])) - 1) << ends[i] for i in range(blocks)]
    keys = []
    for c, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        keys.append(F.xxhash64(F.lit(c), F.col(fp).bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, b <= a, whose closure joins all within the radius."""
    keyed = distinct.select("fp", F.explode(block_keys("fp", radius, blocks)).alias("shard"))
    sizes = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, "shard")
    # a large shard is cut into parts; each pair of parts meets in a tile, the first part in a tree, the second as queries
    cuts = F.ceil(F.col("n") / tile).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("part")), cuts).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    role = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 1).otherwise(0)
    pair = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
    met = met.select(pair.alias("shard"), "fp", role.alias("role"))  # 0 asks, 1 is in the tree, 2 both

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(keep_last: bool):
            shard, fps, role = (np.concatenate(x) for x in zip(*kept))
            kept.clear()
            stop = np.searchsorted(shard, shard[-1]) if keep_last else len(shard)
            if stop < len(shard):
                kept.append((shard[stop:], fps[stop:], role[stop:]))
            a, b = stars(shard[:stop], fps[:stop].view(np.uint64), role[:stop], radius)
            a, b = a.view(np.int64), b.view(np.int64)
            low, high = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([high, low], axis=1)[high != low], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
                if sum(len(k[0]) for k in kept) >= FLUSH_ROWS:
                    yield flush(True)
        if kept:
            yield flush(False)

    dealt = met.repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node on an edge, ``root`` being the least node it is joined to.

    Alternating large and small stars: each round is two aggregations and joins over the edges, whose number
    never grows, and a chain of any length needs about log2 rounds. A busy node meets its neighbours in joins
    that adaptive execution can split, never in one row.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        after = print_of(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _grouped(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """doc_id, fp, root (the same for all rows of a component) and component_id of every row."""
    printed = durable(fingerprints(docs.select("doc_id", "text"), size=size).select("doc_id", "fp"), "fingerprints")
    distinct = printed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), radius))
    # only fingerprints with a link need their root; all others are components of their own
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = durable(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return printed.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed) and component_id of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of up to ``radius`` bits, null ids not counting
    (a component of null ids only has a null one). Equal rows give equal results; an empty table an empty one. Texts
    without words have the fingerprint 0 and are linked like others. Further columns are left out.
    """
    return _grouped(docs, size, radius).select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id, all columns of ``docs``.

    A group's document is named by its id and its fingerprint, so unlike texts that share an id are told apart. Of rows
    that share both, the least by their other columns stays. A document without an id never stands for a group,
    and as it cannot be named it is kept. An empty table gives an empty one. Columns may have any names.
    """
    groups = durable(_grouped(docs, size, radius).where("doc_id IS NOT NULL").select("doc_id", "fp", "root"), "groups")
    stay = groups.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("_one")).select("_one.*")
    several = groups.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    rest = [c for c in docs.columns if c != "doc_id"]

    def least(rows: DataFrame, keys: list) -> DataFrame:
        first = rows.groupBy(*keys).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_row"))
        return first.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns])

    one = stay.join(several, "doc_id", "left_anti").select("doc_id")
    plain = least(docs.join(one, "doc_id", "left_semi"), ["doc_id"])
    # the texts of shared ids are fingerprinted again, beside the columns they came with
    shared = docs.join(several, "doc_id", "left_semi").select(F.col("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    marked = fingerprints(shared, size=size).join(stay, ["doc_id", "fp"], "left_semi")
    told = marked.groupBy("doc_id", "fp").agg(F.min("_row").alias("_row"))
    told = told.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.`{c}`") for c in docs.columns])
    return plain.unionByName(told).unionByName(docs.where("doc_id IS NULL"))
