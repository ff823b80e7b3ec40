"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into pieces (runs of up to eight characters between white space), and its k-mers are the
sequences of ``K`` pieces, numbered by occurrence so that repeats count. Numbered k-mers are hashed into one random
order, whose range is split into 64 equal parts: every part stands for one sketch (one-permutation
hashing: each k-mer is hashed once instead of once per sketch). A sketch takes the ``L`` = 2 least numbered
k-mers of its part, puts them back into text order and hashes the pair. Moving text about changes such pairs
even where the set of k-mers stays, which makes the likeness follow edit distance and not the set alone.

Everything happens inside a row: no k-mer is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvflow.llm.common import let, parts, text_of

PIECE = r"[^\x20\x09-\x0D]{1,8}"
K = 2
L = 2
SKETCH_BITS = 6
#: Low bits that hold a position in a text; an array of longs cannot be longer.
POSITION_BITS = 28
_POSITION = (1 << POSITION_BITS) - 1


def _ints(n: Column) -> Column:
    """0 .. n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _kmers(pieces: Column) -> Column:
    """Per k-mer a long: its hash in the high bits, its position in the low ones. A shorter text is one k-mer."""
    n = F.when(F.size(pieces) == 0, 0).otherwise(F.greatest(F.size(pieces) - (K - 1), F.lit(1)))
    key = lambda i: F.xxhash64(*[F.get(pieces, i + j) for j in range(K)])
    return F.transform(_ints(n), lambda i: key(i).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("bigint")))


def _same(a: Column, b: Column, low_bits: int) -> Column:
    return F.shiftright(a, low_bits) == F.shiftright(b, low_bits)


def _numbered(sorted_kmers: Column) -> Column:
    """(hash of k-mer and occurrence number, position) of each k-mer of the sorted array."""
    starts = F.filter(
        _ints(F.size(sorted_kmers)),
        lambda i: (i == 0) | ~_same(F.get(sorted_kmers, i), F.get(sorted_kmers, i - 1), POSITION_BITS),
    )

    def run(start: Column, stop: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), stop - start - 1),
            lambda o: F.struct(
                F.xxhash64(F.shiftright(F.get(sorted_kmers, start + o), POSITION_BITS), o).alias("x"),
                F.get(sorted_kmers, start + o).bitwiseAND(F.lit(_POSITION)).alias("pos"),
            ),
        )

    def runs(s: Column) -> Column:
        return F.flatten(F.transform(s, lambda start, r: run(start, F.coalesce(F.get(s, r + 1), F.size(sorted_kmers)))))

    return let(starts, runs)


def _part(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - SKETCH_BITS)


def _pairs(order: Column) -> Column:
    """Per part of the sorted (x, pos) array one long: the part, and 32 bits of the hash of its two least in text order."""

    def item(e: Column, i: Column) -> Column:
        after = F.get(order, i + 1)
        other = F.when(_part(after["x"]) == _part(e["x"]), after)
        first = F.when(other["pos"] < e["pos"], other["x"]).otherwise(e["x"])
        second = F.when(other["pos"] < e["pos"], e["x"]).otherwise(other["x"])
        return F.shiftleft(_part(e["x"]), 32).bitwiseOR(F.xxhash64(first, second).bitwiseAND(F.lit(0xFFFFFFFF)))

    leads = F.transform(
        order,
        lambda e, i: F.when((i == 0) | (_part(F.get(order, i - 1)["x"]) != _part(e["x"])), item(e, i)),
    )
    return F.filter(leads, lambda e: e.isNotNull())


def sketch(text: Column) -> Column:
    """One long per part that holds k-mers: the part in the high half, the hash of its pair in the low one."""
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    ordered = lambda k: let(F.sort_array(_numbered(k)), _pairs)
    return let(pieces, lambda p: let(F.sort_array(_kmers(p)), ordered))


def written(sketches: Column) -> Column:
    """The fingerprint as text: ten hexadecimal digits a sketch, in order of the parts."""
    return F.lower(F.array_join(F.transform(sketches, lambda e: F.lpad(F.hex(e), 10, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches among the parts that either text fills, on the scale of one k-mer; 1 without words.

    A sketch survives if each of its ``L`` k-mers does, so the ``L``-th root of the share is taken.
    """
    heads = lambda s: F.transform(s, lambda e: F.shiftright(e, 32))
    either = F.size(F.array_union(heads(a), heads(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.pow(F.size(F.array_intersect(a, b)) / either, F.lit(1 / L)))


def with_next(docs: DataFrame, carried: list[str], derive) -> DataFrame:
    """``derive(docs)`` with a struct ``next`` of the ``carried`` columns of the next document.

    Next is the following row in descending doc_id order, after the last the first; ties go by text, null ids come
    last. ``derive`` adds columns to docs (doc_id, text) row by row. Rows are dealt once, by ranges of doc_id
    between approximate quantiles; each range also gets a copy of the row that follows it, one row a range. Ids are
    taken to be nearly unique: rows with one id, or with none, share a range.
    """
    ranges = 4 * parts(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda b: b >= F.col("doc_id"))))
    placed = docs.select("doc_id", "text").withColumn("range", place)

    # the first row of each range is copied to the end of the range before it
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top"))
    firsts = placed.join(F.broadcast(tops), "range").where(F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    by_range = Window.orderBy("range")
    last = F.max("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    moves = tops.select("range", F.coalesce(F.lag("range").over(by_range), last).alias("to"))
    copies = firsts.join(F.broadcast(moves), "range").select("doc_id", "text", F.col("to").alias("range"))

    rows = derive(placed.withColumn("copied", F.lit(0))).unionByName(derive(copies.withColumn("copied", F.lit(1))))
    order = Window.partitionBy("range").orderBy("copied", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    rows = rows.withColumn("next", F.lead(F.struct(*carried)).over(order))
    return rows.where("copied = 0").drop("copied", "range")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of ``docs``.

    The edited text has its last third (whole code points, rounded down) replaced by as many code points, or all
    there are, from the start of the next document. Null texts count as empty; an empty text has no sketch, and two
    such texts are alike (1.0). Equal texts have equal fingerprints. A lone document is its own next. An empty table gives
    an empty one; repeated rows each return a row. Further columns, of whatever name, are left out.
    """
    narrow = docs.select("doc_id", text_of().alias("text"))
    rows = with_next(narrow, ["text", "sketch"], lambda d: d.withColumn("sketch", sketch(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next.text", third))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
