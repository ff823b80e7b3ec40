"""Mixing sources to target weights, in blocks of a fixed number of words.

The words of a source form one stream, in an order fixed by a hash, cut into blocks of equal length. Output comes in
shards of equal length; every shard draws how many of its slots each source fills, multinomially. The slots of a source
are numbered through all shards, and slot ``j`` takes the block at place ``j`` of a pseudorandom permutation of the
source's blocks, a new permutation for every pass. A pass uses each block once, so no block is taken more often
than any other by more than one. Slots meet their blocks in a join on (source, block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pvflow.llm.common import WORD, durable, parts, text_of

WEIGHTS = (3, 1, 2)
#: The mix takes so many times the words of all sources, and of one source so many times its own at most.
SHARE = 1.5
MOST_PASSES = 2
BLOCK = 32
#: Slots of an output shard.
SHARD_SLOTS = 4096
#: Shards whose counts are summed up in one window.
SHARD_RUN = 1024
#: Parts of a source's stream whose running sums are taken apart.
LANES = 256
#: The table of sources is planned on the driver, so their number is bounded.
MOST_SOURCES = 50_000
SEED = 20240

_WORD = re.compile(WORD)


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, passes: float = MOST_PASSES) -> list[float]:
    """Words to take of each source (name, size): by weight, none above ``passes`` times its size.

    Weights go to the names in code-point order, null last. What a full source cannot take is shared by weight
    among the others until none is above its limit.
    """
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i][0] is None, sizes[i][0] or ""))
    weight = {i: WEIGHTS[rank % len(WEIGHTS)] for rank, i in enumerate(order)}
    limit = [passes * n for _, n in sizes]
    out, left = [0.0] * len(sizes), share * sum(n for _, n in sizes)
    free = set(weight)
    while free:
        unit = left / sum(weight[i] for i in free)
        full = {i for i in free if unit * weight[i] >= limit[i]}
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = float(limit[i])
            left -= limit[i]
        free -= full
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, seed: np.ndarray | int, rounds: int = 32) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (swap-or-not shuffle), place by place; ``seed`` may differ per place."""
    x = index.astype(np.uint64)
    size, key = np.uint64(n), np.uint64(seed) if np.isscalar(seed) else seed.astype(np.uint64)
    with np.errstate(over="ignore"):
        for r in range(1, rounds + 1):
            turn = _mixed(key + np.uint64(r) * np.uint64(0x9E3779B97F4A7C15))
            other = (turn % size + size - x) % size
            swap = _mixed(np.maximum(x, other) ^ (turn >> np.uint64(7)) ^ turn) & np.uint64(1)
            x = np.where(swap == 1, other, x)
    return x.astype(np.int64)


def drawn(shard: int, slots: int, shares: np.ndarray, turn: int = 0, seed: int = SEED) -> np.ndarray:
    """How many of the ``slots`` of a shard each source fills: one multinomial draw, the same for every run."""
    return np.random.default_rng([seed, turn, shard]).multinomial(slots, shares)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _source_table(sized: DataFrame, block: int) -> list[dict]:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goals = targets([(r["source"], r["size"]) for r in rows])
    table = []
    for sid, (r, goal) in enumerate(zip(rows, goals)):
        blocks = -(-r["size"] // block)
        table.append({"sid": sid, "source": r["source"], "source_size": r["size"], "target": goal, "blocks": blocks})
        table[-1]["slots"] = goal * blocks / r["size"] if r["size"] else 0.0
    return table


def _numbered(counts: DataFrame) -> DataFrame:
    """``counts`` (shard, sid, n) with ``first``: how many slots of the source the shards before hold.

    Two levels of sums, so that no window runs over all shards of a source.
    """
    runs = counts.withColumn("run", F.expr(f"shard div {SHARD_RUN}"))
    sums = runs.groupBy("sid", "run").agg(F.sum("n").alias("run_n"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "run", F.coalesce(F.sum("run_n").over(before), F.lit(0)).alias("run_first"))
    inside = Window.partitionBy("sid", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("run_first") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return runs.join(sums, ["sid", "run"]).select("shard", "sid", "n", first.alias("first"))


def _drawn(open_slots: DataFrame, shares: np.ndarray, turn: int) -> DataFrame:
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, slots in zip(batch.column("shard").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                n = drawn(shard, slots, shares, turn)
                sid = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sid), shard)), pa.array(sid), pa.array(n[sid])], names=["shard", "sid", "n"])

    return open_slots.select("shard", "slots").mapInArrow(draw, "shard bigint, sid bigint, n bigint")


def draw_counts(spark, weights: np.ndarray, most: list[int]) -> DataFrame:
    """(shard, sid, n, first): multinomial counts of every shard, no source above ``most`` slots altogether.

    Slots that a source has drawn beyond its limit are drawn again, in their shards, among the sources that have
    room; so every slot is filled while any source has room.
    """
    total = min(int(round(weights.sum())), sum(most))
    shards = -(-total // SHARD_SLOTS)
    open_slots = spark.range(shards).select(
        F.col("id").alias("shard"), F.least(F.lit(SHARD_SLOTS), F.lit(total) - F.col("id") * SHARD_SLOTS).cast("bigint").alias("slots")
    )
    room = spark.createDataFrame([(i, int(m)) for i, m in enumerate(most)], "sid bigint, most bigint")
    counts, free, turn = None, (weights > 0) & (np.array(most) > 0), 0
    while total and free.any():
        shares = np.where(free, weights, 0.0)
        new = _drawn(open_slots, shares / shares.sum(), turn)
        counts = new if counts is None else counts.unionByName(new).groupBy("shard", "sid").agg(F.sum("n").alias("n"))
        kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("most") - F.col("first")))
        limited = _numbered(counts).join(F.broadcast(room), "sid").select("shard", "sid", "n", kept.alias("kept"))
        limited = durable(limited, "draws")
        lost = limited.where("kept < n").groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("slots"))
        full = {r.sid for r in limited.groupBy("sid").agg(F.sum("kept").alias("k")).join(F.broadcast(room), "sid").where("k >= most").select("sid").collect()}
        counts = limited.where("kept > 0").select("shard", "sid", F.col("kept").alias("n"))
        if limited.where("kept < n").isEmpty():
            break
        free, open_slots, turn = free & ~np.isin(np.arange(len(most)), sorted(full)), lost, turn + 1
    if counts is None:
        return spark.createDataFrame([], "shard bigint, sid bigint, n bigint, first bigint")
    return _numbered(counts)


def _taken_blocks(spark, table: list[dict]) -> DataFrame:
    """(sid, block, slot, shard): every filled slot of the mix."""
    blocks = [t["blocks"] for t in table]
    counts = draw_counts(spark, np.array([t["slots"] for t in table]), [MOST_PASSES * b for b in blocks])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, sid, n, first = (batch.column(c)[i].as_py() for c in ("shard", "sid", "n", "first"))
                slot = np.arange(first, first + n)
                turn = slot // blocks[sid]
                block = permuted(slot % blocks[sid], blocks[sid], turn * len(blocks) + sid + SEED)
                arrays = [np.full(len(slot), sid, np.int64), block, slot, np.full(len(slot), shard, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["sid", "block", "slot", "shard"])

    # a fixed number of tasks: a row stands for thousands of slots, which sizes of rows do not show
    return counts.repartition(parts(spark), "sid", "shard").mapInArrow(fill, "sid bigint, block bigint, slot bigint, shard bigint")


def _placed(sized: DataFrame, table: list[dict]) -> DataFrame:
    """``sized`` with sid, start: where each document of one word or more begins in the stream of its source.

    A stream runs through lanes picked by a hash, and within a lane by that hash and the id. Lanes are summed apart, so a
    source that holds most of the words spreads over many tasks.
    """
    sources = _facts(sized.sparkSession, table).select("sid", "name")
    rows = sized.where("size > 0").join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    rows = rows.withColumn("turn", F.xxhash64(F.lit("stream"), "doc_id", "size")).withColumn("lane", F.pmod("turn", F.lit(LANES)))
    lanes = rows.groupBy("sid", "lane").agg(F.sum("size").alias("lane_size"))
    before = Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("sid", "lane", F.coalesce(F.sum("lane_size").over(before), F.lit(0)).alias("lane_start"))
    rows = rows.join(lanes, ["sid", "lane"])
    inside = Window.partitionBy("sid", "lane").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("lane_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return rows.withColumn("start", start).drop("turn", "lane", "lane_start")


def _facts(spark, table: list[dict]) -> DataFrame:
    """The planned sources as a table: sid, name, source_size, target."""
    rows = [(t["sid"], t["source"], t["source_size"], t["target"]) for t in table]
    return spark.createDataFrame(rows, "sid bigint, name string, source_size bigint, target double")


def mixed_pieces(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself: shard, slot, and what its block holds of each document, with the columns of ``docs``.

    A piece is the text from the first to the last word that a block takes of a document, blanks between them included;
    ``n_chars`` is its length. A block that is taken twice gives its pieces twice, in different shards or slots. Together
    the pieces of a document hold its words as often as ``mix`` counts them. Null and empty texts give no pieces, an empty
    table none at all. Rows of equal id and size but other text follow one another in any order, so which words of them share
    a block may change between runs. Columns of ``docs`` named shard, slot, block, sid, start, size or name would meet
    those made here; rename them first.
    """
    spark = docs.sparkSession
    columns = docs.columns
    sized = docs.withColumn("size", word_count(text_of()))
    table = _source_table(sized.select("source", "size"), block)
    if not any(t["blocks"] for t in table):
        return docs.limit(0).select(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("slot"), *columns)
    placed = _placed(sized, table)
    fields = [f for f in placed.schema.fields if f.name in columns]
    schema = StructType(fields + [StructField("sid", LongType()), StructField("block", LongType())])
    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, sid, start = (batch.column(n)[i].as_py() for n in ("text", "sid", "start"))
                spans = [m.span() for m in _WORD.finditer(text)]
                first = np.arange(start // block, (start + len(spans) - 1) // block + 1)
                begin = np.maximum(first * block - start, 0)
                end = np.minimum((first + 1) * block - start, len(spans)) - 1
                pieces = [text[spans[b][0] : spans[e][1]] for b, e in zip(begin, end)]
                row = pa.array(np.full(len(first), i, np.int64))
                made = {n: batch.column(n).take(row) for n in names if n in columns}
                made |= {"text": pa.array(pieces, pa.string()), "n_chars": pa.array([len(p) for p in pieces], pa.int64())}
                made |= {"sid": pa.array(np.full(len(first), sid, np.int64)), "block": pa.array(first)}
                yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

    pieces = placed.select(*[f.name for f in fields], "sid", "start").mapInArrow(cut, schema)
    # a merge join: the slots come out of few rows, so Spark's estimate would send them all to every task
    return pieces.join(_taken_blocks(spark, table).hint("merge"), ["sid", "block"]).select("shard", "slot", *columns)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    A null text has no words, a null source is a source of its own. Documents without words are taken 0 times; rows
    that repeat are documents of their own. An empty table gives an empty result; reruns agree. Further columns, of
    whatever name, are left out.
    """
    spark = docs.sparkSession
    sized = durable(docs.select("doc_id", "source", word_count(text_of()).alias("size")), "sizes")
    table = _source_table(sized, block)
    if not table:
        return sized.select("doc_id", "size", F.col("size").alias("source_size"), F.col("size").cast("double").alias("target"), F.col("size").alias("taken"))
    placed = _placed(sized, table)
    uses = _taken_blocks(spark, table).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    last = F.col("start") + F.col("size") - 1
    spans = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.floor(last / block).cast("bigint"))))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    # a document is known by its place in its source's stream
    taken = spans.join(uses.hint("merge"), ["sid", "block"], "left").groupBy("sid", "start", "doc_id", "size")
    taken = taken.agg(F.sum(words * F.coalesce("uses", F.lit(0))).alias("taken")).select("doc_id", "size", "sid", "taken")
    empty = sized.where("size = 0").join(F.broadcast(_facts(spark, table)), F.col("source").eqNullSafe(F.col("name")))
    empty = empty.select("doc_id", "size", "sid", F.lit(0).cast("bigint").alias("taken"))
    rows = taken.unionByName(empty).join(F.broadcast(_facts(spark, table).drop("name")), "sid")
    return rows.select("doc_id", "size", "source_size", "target", "taken")
