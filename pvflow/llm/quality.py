"""Quality rules: text statistics and a hashed n-gram likelihood ratio, in DataFrame functions only.

Uni- and bigrams of lower-cased words are hashed into a fixed number of bins. Two multinomials are counted over the bins,
one from the trusted target documents, one from all documents of the raw corpus; a document's score is the mean
log ratio of the two over its n-grams. The target counts are shrunk towards the corpus, so an n-gram that the target
lacks by chance says little. The threshold is fixed before any document is judged: half of the trusted documents, by
the checksum of their id, make the target counts, and the score that all but a small share of the other half reach is
the threshold. Every trusted document is in one half, the corpus counts cover all documents, and each document is
compared with the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import WORD, durable, let, text_of

BINS = 1 << 14
#: N-grams of the corpus that are mixed into the target counts.
PRIOR = float(BINS)
#: Share of the trusted documents that the threshold gives up.
GIVEN_UP = 0.01
# The base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
_SPACE = "\x09\x0a\x0b\x0c\x0d\x20"
_POSITION_BITS = 28
_POSITION = (1 << _POSITION_BITS) - 1


def _ints(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def repeated_words(hashes: Column) -> Column:
    """Words in three-word windows that occur twice or more, from the array of word hashes.

    Windows are sorted by part of their hash together with their place; only those that share this part
    with a neighbour are then compared by the whole hash.
    """
    window = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(3)])
    short = F.transform(_ints(F.size(hashes) - 2), lambda i: window(i).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(i.cast("bigint")))

    def alike(rows: Column, of) -> Column:
        """Elements that agree in ``of`` with the one before or after."""
        before = lambda e, i: (i > 0) & (of(F.get(rows, F.greatest(i - 1, F.lit(0)))) == of(e))
        after = lambda e, i: (i < F.size(rows) - 1) & (of(F.get(rows, i + 1)) == of(e))
        return F.filter(rows, lambda e, i: before(e, i) | after(e, i))

    def exact(close: Column) -> Column:
        whole = F.transform(
            close,
            lambda e: F.struct(
                window(e.bitwiseAND(F.lit(_POSITION)).cast("int")).alias("h"),
                e.bitwiseAND(F.lit(_POSITION)).cast("int").alias("at"),
            ),
        )
        twice = let(F.sort_array(whole), lambda w: alike(w, lambda e: e["h"]))
        return F.sort_array(F.transform(twice, lambda e: e["at"]))

    def covered(places: Column) -> Column:
        gap = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(places, gap), F.lit(0), lambda a, g: a + g)

    return let(F.sort_array(short), lambda s: let(exact(alike(s, lambda e: F.shiftright(e, _POSITION_BITS))), covered))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the array ``grams``.

    A null text counts as empty. ``grams`` holds the bins of the lower-cased n-grams.
    """
    body = text_of(text)
    words = F.regexp_extract_all(body, F.lit(WORD), F.lit(0))
    blank = body
    for c in SYMBOLS:
        blank = F.replace(blank, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n"),
            F.length(F.array_join(w, "")).alias("chars"),
            let(F.transform(w, lambda x: F.xxhash64(x)), repeated_words).alias("repeats"),
            let(F.transform(w, lambda x: F.xxhash64(F.lower(x))), _bins).alias("grams"),
        )

    measured = docs.withColumn("_words", let(words, of_words))
    measured = measured.withColumns(
        {
            "n_words": F.col("_words.n").cast("bigint"),
            "word_chars": F.col("_words.chars").cast("bigint"),
            "n_symbols": (F.octet_length(body) - F.octet_length(blank)).cast("bigint"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
            "n_repeat_words": F.col("_words.repeats").cast("bigint"),
            "grams": F.col("_words.grams"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("base_failed", failed).drop("_words")


def _bins(h: Column) -> Column:
    """Bins of all words and pairs of neighbours, from the array of word hashes."""
    one = F.transform(h, lambda x: F.pmod(x, F.lit(BINS)).cast("int"))
    two = F.transform(_ints(F.size(h) - 1), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(BINS)).cast("int"))
    return F.concat(one, two)


def grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the bins of its n-grams alone."""
    words = F.regexp_extract_all(text_of(text), F.lit(WORD), F.lit(0))
    return docs.withColumn("grams", let(F.transform(words, lambda x: F.xxhash64(F.lower(x))), _bins))


def log_ratio(target: DataFrame, corpus: DataFrame) -> DataFrame:
    """log p(bin | target) - log p(bin | corpus): one row with one array of ``BINS`` numbers."""
    spark = corpus.sparkSession
    count = lambda d: d.select(F.explode("grams").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    bins = spark.range(BINS).select(F.col("id").cast("int").alias("bin"))
    both = bins.join(count(target).withColumnRenamed("n", "t"), "bin", "left").join(count(corpus).withColumnRenamed("n", "c"), "bin", "left")
    filled = both.select("bin", F.coalesce("t", F.lit(0)).alias("t"), (F.coalesce("c", F.lit(0)) + 1).alias("c"))
    rows = filled.agg(F.sort_array(F.collect_list(F.struct("bin", "t", "c"))).alias("r"), F.sum("t").alias("ts"), F.sum("c").alias("cs"))

    def ratio(e: Column) -> Column:
        corpus_share = e["c"] / F.col("cs")
        return F.log((e["t"] + PRIOR * corpus_share) / (F.col("ts") + PRIOR)) - F.log(corpus_share)

    return rows.select(F.transform("r", ratio).alias("weights"))


def score(weights: Column) -> Column:
    """Mean weight of the bins in ``grams``; null without any."""
    total = let(weights, lambda w: F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(w, g)))
    return F.when(F.size("grams") > 0, total / F.size("grams"))


def judge(docs: DataFrame, trusted: DataFrame, given_up: float = GIVEN_UP) -> DataFrame:
    """doc_id, the base columns, score and kept of every row of ``docs`` (doc_id, text).

    ``trusted`` has the doc_id of the documents that the target multinomial and the threshold are learned from; ids that
    are null or unknown are of no use there. Raw counts cover all documents. A document is kept if it passes the base
    rules and its score reaches the threshold.
    Without trusted documents every score is 0 and the base rules decide alone. A null text has no words and fails; a
    document without id is judged but never trusted. Equal texts are judged alike, repeated rows each. An empty table gives an
    empty one. Further columns of either table, of whatever name, are left out.
    """
    narrow = docs.select("doc_id", "text")
    sure = trusted.select("doc_id").where("doc_id IS NOT NULL").distinct()
    # the ids grow with the corpus, so they are never broadcast; each half of the documents is dealt once
    sure = sure.hint("shuffle_hash")
    corpus = grams(narrow)
    target = grams(narrow.join(sure, "doc_id", "left_semi"))
    fitting = F.crc32(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))) % 2 == 0
    weights = durable(log_ratio(target.where(fitting), corpus), "log-ratio").scalar()
    weighed = lambda d: d.withColumn("_weights", weights)
    floor = weighed(target.where(~fitting)).select(score(F.col("_weights")).alias("s")).agg(F.coalesce(F.percentile_approx("s", given_up, 10000), F.lit(float("-inf"))).alias("least"))
    scored = weighed(base_rules(narrow)).withColumn("score", score(F.col("_weights"))).drop("grams", "_weights")
    least = floor.scalar()
    kept = ~F.col("base_failed") & F.coalesce(F.col("score") >= least, F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return scored.select(*columns, kept.alias("kept"), "score")
