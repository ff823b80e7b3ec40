"""Product codes, bit-plane clusters and vantage-point trees against brute force, with every awkward row."""

import hashlib
import math

import numpy as np
import pytest

from pvflow.llm import codes, planes, vptree
from pvflow.llm.codes import compress
from pvflow.llm.planes import cluster
from pvflow.llm.vptree import nearest
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vectors(n=300, width=64, seed=3):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, width)) * rng.choice([0.05, 0.2, 0.9], size=(n, 1))
    return [(i, [float(x) for x in np.float32(v)], i % 4 if i % 7 else None) for i, v in enumerate(made)]


def odd_rows(width=64):
    good = vectors(1, width, 9)[0][1]
    return [
        (900, None, 1),
        (901, [], 1),
        (902, [None] + good[1:], 1),
        (903, [NAN] + good[1:], 1),
        (904, good[:-1] + [-INF], 1),
        (905, good[:-1], 1),  # another length
        (906, [0.0] * width, 2),
        (907, [float(np.float32(1e30))] + good[1:], 2),
        (None, good, 2),
        (940, good, None),
        (940, good, None),  # a repeated row
        (960, good, 3),  # a tie
        (980, good, 3),
    ]


@pytest.fixture(scope="module")
def table(llm):
    df = llm.createDataFrame(vectors() + odd_rows(), SCHEMA).repartition(5).cache()
    df.count()
    return df


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [max(-(2**24), min(2**24, math.floor(256 * x))) if abs(x) > 1e6 else math.floor(256 * x) for x in v]


def last(key):
    return (key is None, key or 0)


def squared(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def closest(v, book):
    return min((squared(v, e), i) for i, e in enumerate(book))


def moved(book, members):
    return [[sum(c) // len(m) for c in zip(*m, strict=True)] if (m := members.get(i)) else e for i, e in enumerate(book)]


def brute_codes(rows, positions, entries, rounds, width):
    kept = sorted(((i, w, label) for i, v, label in rows if (w := whole(v)) is not None and len(w) == width), key=lambda r: (last(r[0]), r[1]))
    n = width // positions
    part = lambda w, p: w[p * n : p * n + n]
    books = [[part(w, p) for _, w, _ in kept[:entries]] for p in range(positions)]
    for _ in range(rounds):
        for p in range(positions):
            members = {}
            for _, w, _ in kept:
                members.setdefault(closest(part(w, p), books[p])[1], []).append(part(w, p))
            books[p] = moved(books[p], members)
    out = []
    for i, w, label in kept:
        hits = [closest(part(w, p), books[p]) for p in range(positions)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in hits), sum(d for d, _ in hits)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, label, c, e, sum(r[3] for r in out if r[1] == label), digest) for i, label, c, e in out), key=lambda r: (last(r[0]), r))


@pytest.mark.parametrize("positions, entries, block", [(16, 64, 2048), (16, 8, 4), (4, 5, 16)])
def test_codes(table, monkeypatch, positions, entries, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    monkeypatch.setattr(codes, "TRIE_ROWS", 64)
    got = compress(table, positions=positions, entries=entries).collect()
    want = brute_codes(vectors() + odd_rows(), positions, entries, 2, 64)
    assert sorted((tuple(r) for r in got), key=lambda r: (last(r[0]), r)) == want


def test_walk_equals_all_distances():
    rng = np.random.default_rng(1)
    for block, width in ((1, 4), (8, 3), (10_000, 5), (2, 1)):
        parts, weights, index = codes.distinct(rng.integers(-4, 4, size=(500, width)))
        assert (np.lexsort(parts.T[::-1]) == np.arange(len(parts))).all() and weights.sum() == 500 == len(index)
        entries = rng.integers(-4, 4, size=(11, width))
        entries[7] = entries[2]  # a tie
        all_of = ((parts[:, None] - entries) ** 2).sum(axis=2)
        codes.BLOCK, kept = block, codes.BLOCK
        try:
            best, dist = codes.walk(parts, entries)
        finally:
            codes.BLOCK = kept
        assert (best == all_of.argmin(axis=1)).all() and (dist == all_of.min(axis=1)).all()


def test_codes_of_few_and_no_rows(llm):
    none = llm.createDataFrame([], SCHEMA)
    assert compress(none).count() == 0 and compress(none).columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert compress(llm.createDataFrame([(1, [0.5] * 15, 1), (2, None, 1)], SCHEMA)).count() == 0
    few = llm.createDataFrame(vectors(3), SCHEMA).select("*", F.lit("x").alias("code"), F.lit(1).alias("error"), F.lit(2).alias("v"), F.lit(3).alias("of"))
    got = compress(few).collect()
    assert [r.code for r in sorted(got)] == [f"{i:02x}" * 16 for i in range(3)] and {r.error for r in got} == {0}


def brute_clusters(rows, centroids, rounds):
    kept = [(i, w) for i, v, _ in rows if (w := whole(v)) is not None and len(w) == 64]
    hashed = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    book = [w for _, w in sorted(kept, key=lambda r: (hashed(r[0]), r[1]))[:centroids]]
    for _ in range(rounds):
        members = {}
        for _, w in kept:
            members.setdefault(closest(w, book)[1], []).append(w)
        book = moved(book, members)
    hits = [(i, *closest(w, book)[::-1]) for i, w in kept]
    total = sum(d for _, _, d in hits)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    return sorted(((i, c, d, sum(x for _, k, x in hits if k == c), total, digest[c]) for i, c, d in hits), key=lambda r: (last(r[0]), r))


@pytest.mark.parametrize("centroids", [40, 3, 1000])
def test_clusters(table, monkeypatch, centroids):
    monkeypatch.setattr(planes, "ROWS", 100)
    rounds = 5 if centroids < 1000 else 1
    got = cluster(table, centroids=centroids, rounds=rounds).collect()
    want = brute_clusters(vectors() + odd_rows(), centroids, rounds)
    assert sorted((tuple(r) for r in got), key=lambda r: (last(r[0]), r)) == want


def test_bit_planes():
    rng = np.random.default_rng(2)
    for low, high in ((0, 0), (-1, 0), (-1, 1), (-256, 256), (-(2**24), 2**24), (5, 7), (-128, 127), (-129, 127)):
        n = planes.planes_for(low, high)
        assert -(2 ** (n - 1)) <= low and high < 2 ** (n - 1)
        a, b = (rng.integers(low, high + 1, size=(k, 64)) for k in (9, 5))
        a[0], a[1] = low, high
        x, y = planes.pack(a, n), planes.pack(b, n)
        assert (planes.unpack(x) == a).all() and (planes.dots(x, y) == a @ b.T).all() and (planes.squares(x) == (a * a).sum(axis=1)).all()


def test_clusters_of_few_and_no_rows(llm):
    none = cluster(llm.createDataFrame([], SCHEMA))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    few = llm.createDataFrame(vectors(2), SCHEMA).select("*", F.lit("x").alias("cluster"), F.lit(1).alias("planes"), F.lit(2).alias("comps"))
    assert {(r.distance, r.inertia) for r in cluster(few).collect()} == {(0, 0)}


def brute_neighbours(rows, every, k):
    seen = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, a in seen:
        if q % every == 0:
            near = []
            for i, b in seen:
                if i != q and len(a) == len(b):
                    score = 0.0
                    for x, y in zip(a, b, strict=True):
                        score += x * y
                    near.append((-score, i))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("leaf, shard, group, k", [(256, 4096, 4096, 20), (4, 40, 7, 20), (3, 1000, 2, 3)])
def test_neighbours(table, monkeypatch, leaf, shard, group, k):
    monkeypatch.setattr(vptree, "LEAF", leaf)
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "GROUP", group)
    got = nearest(table, F.col("vec_id") % 20 == 0, k=k).collect()
    assert sorted(tuple(r) for r in got) == brute_neighbours(vectors() + odd_rows(), 20, k)


def test_neighbours_with_many_ties(llm, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 4)
    monkeypatch.setattr(vptree, "SHARD", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in (rng.integers(-1, 2, size=4) if i % 3 else [1, 1, 0, 0])], 0) for i in range(240)]
    got = nearest(llm.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 5 == 0, k=7).collect()
    assert sorted(tuple(r) for r in got) == brute_neighbours(rows, 5, 7)


def test_neighbours_of_few_and_no_rows(llm):
    ask = F.col("vec_id") % 20 == 0
    assert nearest(llm.createDataFrame([], SCHEMA), ask).count() == 0
    assert nearest(llm.createDataFrame(vectors(1), SCHEMA), ask).count() == 0
    few = llm.createDataFrame(vectors(3), SCHEMA).select("*", *[F.lit(1).alias(n) for n in ("v", "width", "query", "bucket", "score")])
    got = nearest(few, ask).collect()
    assert sorted(r.vec_id for r in got) == [1, 2] and [r.rank for r in got] == [1, 2]
    with pytest.raises(ValueError):
        nearest(few, ask, factor=0.0)


def test_relaxed_pruning_keeps_recall_and_saves_work():
    """Factor 1 is exact; on vectors in groups a smaller one looks at fewer points and keeps nine of ten neighbours."""
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 64))
    points = np.repeat(middles, 100, axis=0) + 0.25 * rng.normal(size=(4000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    asked = points[::50]
    want = np.sort(asked @ points.T, axis=1)[:, :-21:-1]
    tree, looked = vptree.build(points), {}
    for factor in (1.0, 0.5, 0.3):
        best, _, looked[factor] = vptree.search(tree, asked, 20, factor)
        recall = np.mean([np.isin(w.round(9), b.round(9)).mean() for w, b in zip(want, best, strict=True)])
        assert recall == 1 if factor == 1 else recall >= 0.9, (factor, recall)
    assert looked[0.3] < 0.8 * looked[1.0] <= 0.8 * asked.shape[0] * len(points), looked
