"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many virtual nodes on a ring of hash values, and a row belongs to the first node clockwise
of its own hash. Loads are bounded: a shard takes no more rows than its capacity, and what overflows goes on
clockwise to the next node whose shard has room. Capacities add up to the number of rows and differ by one
at most, so balance is guaranteed, and only the overflow leaves its home.

The walk along the ring needs the number of rows per arc only, never the rows: a table of fixed size (arcs x
slices) whatever the input. Rows queue in ring order, each node accepts the next few of the queue, and a row
finds its shard from its place in the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvflow.llm.common import let, text_of

SHARDS = 16
VIRTUAL_NODES = 96
#: Equal parts of an arc, so that ranking rows within an arc spreads over more tasks.
SLICES = 8
#: Equal parts of the ring by which a row finds its arc without looking at every node.
CELL_BITS = 12


def ring(spark: SparkSession, shards: int, nodes: int) -> DataFrame:
    """arc (0.. in ring order), pos, shard; ``shards * nodes`` rows."""
    points = spark.range(shards * nodes).select(F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.expr(f"id div {shards}").alias("replica"))
    points = points.select("shard", F.xxhash64(F.lit("node"), "shard", "replica").alias("pos"))
    order = Window.orderBy("pos", "shard")
    return points.select((F.row_number().over(order) - 1).cast("int").alias("arc"), "pos", "shard")


def _cell(pos: Column) -> Column:
    return F.shiftright(pos, 64 - CELL_BITS).cast("int")


def _cells(nodes: DataFrame, arcs: int) -> DataFrame:
    """Per cell of the ring: its nodes in order, and the arc that begins after them."""
    spark = nodes.sparkSession
    half = 1 << (CELL_BITS - 1)
    cells = spark.range(-half, half).select(F.col("id").cast("int").alias("cell"))
    own = nodes.groupBy(_cell(F.col("pos")).alias("cell")).agg(F.sort_array(F.collect_list(F.struct("pos", "arc"))).alias("own"), F.max("arc").alias("last"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cells.join(F.broadcast(own), "cell", "left")
    after = F.coalesce(F.max("last").over(before) + 1, F.lit(0))
    return own.select("cell", F.coalesce("own", F.array().cast("array<struct<pos:bigint,arc:int>>")).alias("own"), F.pmod(after, F.lit(arcs)).alias("after"))


def _walk(arcs: Column, total: Column, shards: int) -> Column:
    """Array of (from, to, shard, slot): the queue places that each step along the ring accepts, two laps long.

    ``arcs`` is an array of (shard, n) in ring order. Two laps suffice: after the first every row has
    entered the queue, and the second passes every shard that still has room.
    """
    quota = lambda s: F.floor(total / shards).cast("bigint") + F.when(s < total % shards, 1).otherwise(0)
    start = F.struct(
        F.lit(0).cast("bigint").alias("entered"),
        F.lit(0).cast("bigint").alias("placed"),
        F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"),
        F.array().cast("array<struct<from:bigint,to:bigint,shard:int,slot:bigint>>").alias("steps"),
    )

    def step(acc: Column, arc: Column) -> Column:
        entered, placed, load = acc["entered"] + arc["n"], acc["placed"], acc["load"]
        held = F.get(load, arc["shard"])
        take = F.least(entered - placed, quota(arc["shard"]) - held)
        made = F.struct(placed.alias("from"), (placed + take).alias("to"), arc["shard"].alias("shard"), held.alias("slot"))
        return F.struct(
            entered.alias("entered"),
            (placed + take).alias("placed"),
            F.transform(load, lambda v, i: F.when(i == arc["shard"], v + take).otherwise(v)).alias("load"),
            F.when(take > 0, F.concat(acc["steps"], F.array(made))).otherwise(acc["steps"]).alias("steps"),
        )

    idle = F.transform(arcs, lambda a: F.struct(a["shard"].alias("shard"), F.lit(0).cast("bigint").alias("n")))
    return F.aggregate(F.concat(arcs, idle), start, step)["steps"]


def assign(docs: DataFrame, key: list[str], shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``docs`` with shard and slot (gapless from 0 in each shard), shard sizes at most one apart.

    The place on the ring is a hash of the ``key`` columns, which may be null; rows with the same key stand
    side by side in an order by that hash, and equal rows are interchangeable. ``docs`` should be narrow: its
    rows are shuffled once. Columns of ``docs`` named shard or slot are replaced. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    arcs = shards * nodes
    points = ring(spark, shards, nodes)
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64(*key).alias("_pos"))
    placed = packed.join(F.broadcast(_cells(points, arcs)), _cell(F.col("_pos")) == F.col("cell")).drop("cell")
    arc = let(F.filter("own", lambda p: p["pos"] >= F.col("_pos")), lambda p: F.coalesce(F.get(p, F.lit(0))["arc"], F.col("after")))
    # rows queue by (arc, slice, hash)
    placed = placed.withColumn("_arc", arc.cast("int")).drop("own", "after")
    placed = placed.withColumn("_slice", F.pmod(F.xxhash64("_pos"), F.lit(SLICES)).cast("int"))

    counts = placed.groupBy("_arc", "_slice").agg(F.count("*").alias("n"))
    queue = Window.orderBy("_arc", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_arc", "_slice", "n", F.coalesce(F.sum("n").over(queue), F.lit(0)).alias("base"))

    per_arc = points.join(F.broadcast(counts.groupBy("_arc").agg(F.sum("n").alias("n"))), F.col("arc") == F.col("_arc"), "left")
    per_arc = per_arc.agg(
        F.sort_array(F.collect_list(F.struct("arc", "shard", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))).alias("arcs"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
    )
    ordered = F.transform("arcs", lambda a: F.struct(a["shard"].alias("shard"), a["n"].alias("n")))
    steps = per_arc.select(F.explode(_walk(ordered, F.col("total"), shards)).alias("s")).select("s.*")

    # cut the queue at every group and every step: each piece has one group and one step
    cuts = bases.select(F.col("base").alias("at"), F.struct("_arc", "_slice", "base").alias("g"), F.lit(None).cast("struct<from:bigint,to:bigint,shard:int,slot:bigint>").alias("s"))
    cuts = cuts.unionByName(steps.select(F.col("from").alias("at"), F.lit(None).cast(cuts.schema["g"].dataType).alias("g"), F.struct("from", "to", "shard", "slot").alias("s")))
    sofar = Window.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = cuts.select("at", F.last("g", True).over(sofar).alias("g"), F.last("s", True).over(sofar).alias("s")).distinct()
    plan = pieces.where("g IS NOT NULL AND s IS NOT NULL").groupBy("g._arc", "g._slice", "g.base")
    plan = plan.agg(F.sort_array(F.collect_list(F.struct("at", F.col("s.from").alias("from"), F.col("s.shard").alias("shard"), F.col("s.slot").alias("slot")))).alias("pieces"))

    ranked = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_arc", "_slice").orderBy("_pos", *[F.col(f"_row.`{k}`") for k in key])).cast("bigint") - 1)
    ranked = ranked.join(F.broadcast(plan), ["_arc", "_slice"]).withColumn("_at", F.col("base") + F.col("_n"))
    found = let(F.filter("pieces", lambda p: p["at"] <= F.col("_at")), lambda p: F.element_at(p, -1))
    ranked = ranked.withColumn("_piece", found)
    slot = F.col("_piece.slot") + F.col("_at") - F.col("_piece.from")
    kept = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    return ranked.select(*kept, F.col("_piece.shard").alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; the law is ``rows``.

    That law balances counts and does not keep equal texts together. Null texts have size 1; null ids and repeated
    rows take slots of their own. An empty table gives an empty one. Further columns, of whatever name, are left out.
    """
    body = text_of()
    narrow = docs.select("doc_id", (F.octet_length(body) + 1).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"))
    out = assign(narrow, ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
