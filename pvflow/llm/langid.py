"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree: counts of the bytes seen after the last 3, 2, 1 and
0 bytes. A byte the longest known context has not seen is coded by an escape (method C: an escape counts as
often as the context has distinct successors) and then by the next shorter context, the bytes already ruled
out being excluded. The statistics stay frozen while texts are scored, so the exact code length of a byte
depends on its context alone and is tabulated once: scoring is one table look-up per byte for all languages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pvflow.llm.common import map_columns

ORDER = 3
#: The classifier is fitted on a bounded sample: so many documents and bytes of each language at most.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 1_500_000
#: Parts of a language that are ranked apart.
LANES = 64
UNKNOWN = "und"
#: Bytes of text coded at once: some hundred bytes of memory each.
TAKEN_BYTES = 1 << 18
#: A text that needs more bits per byte than this under every language resembles none of them.
REJECT_BITS = 6.5

SCHEMA = "lang_pred string, score double, bits_per_byte double"


@dataclass(frozen=True)
class ContextTrees:
    """Code lengths in bits: ``bits[state * symbols + class]`` holds one value per language.

    Bytes fall into classes: 0 pads the front of a text, 1.. are the bytes of the sample, the last stands
    for every other byte. ``state[c1, c2, c3]`` is the longest context known to any language.
    """

    langs: tuple[str, ...]
    byte_class: np.ndarray
    symbols: int
    state: np.ndarray
    bits: np.ndarray

    def lengths(self, texts: Sequence[bytes]) -> np.ndarray:
        """Code length of each text under each language, shape (texts, languages)."""
        out = np.zeros((len(texts), len(self.langs)))
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            if len(t) > TAKEN_BYTES:  # a very long text is coded in pieces that overlap by one context
                out[i] = self._long(t)
                continue
            group.append(i)
            size += len(t)
            if size > TAKEN_BYTES:
                out[group] = self._batch([texts[j] for j in group])
                group, size = [], 0
        if group:
            out[group] = self._batch([texts[j] for j in group])
        return out

    def _codes(self, classes: np.ndarray) -> np.ndarray:
        k = self.symbols
        context = (classes[:-3] * k + classes[1:-2]) * k + classes[2:-1]
        return self.state[context] * k + classes[3:]

    def _long(self, text: bytes) -> np.ndarray:
        total = np.zeros(len(self.langs))
        step = TAKEN_BYTES
        for at in range(0, len(text), step):
            before = np.zeros(ORDER, np.int64)
            if at:
                before = self.byte_class[np.frombuffer(text, np.uint8, ORDER, at - ORDER)]
            piece = self.byte_class[np.frombuffer(text[at : at + step], np.uint8)]
            total += self.bits[self._codes(np.concatenate([before, piece]))].sum(axis=0, dtype=np.float64)
        return total

    def _batch(self, texts: Sequence[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + ORDER)
        classes = np.zeros(int(ends[-1]), np.int64)
        body = np.ones(len(classes), bool)
        for r in range(ORDER):
            body[ends - sizes - 1 - r] = False
        classes[body] = self.byte_class[np.frombuffer(b"".join(texts), np.uint8)]
        keep = body[ORDER:]
        codes = self._codes(classes)[keep]
        sums = np.zeros((len(codes) + 1, len(self.langs)))
        np.cumsum(self.bits[codes], axis=0, out=sums[1:])
        stops = np.cumsum(sizes)
        return sums[stops] - sums[stops - sizes]


def fit(samples: dict[str, list[bytes]]) -> ContextTrees:
    """Context trees of the languages, frozen into one table of code lengths."""
    langs = tuple(sorted(samples))
    seen = np.unique(np.concatenate([np.frombuffer(t, np.uint8) for ts in samples.values() for t in ts] or [np.zeros(0, np.uint8)]))
    other = 256 - len(seen)
    k = len(seen) + 2
    byte_class = np.full(256, k - 1, np.int64)
    byte_class[seen] = np.arange(1, len(seen) + 1)
    # bytes per class: what the order below 0 spreads evenly, and what a class cost is divided by
    width = np.concatenate([[0.0], np.ones(len(seen)), [float(other)]])

    streams = {}
    for lang in langs:
        pieces = [np.concatenate([np.zeros(ORDER, np.int64), byte_class[np.frombuffer(t, np.uint8)]]) for t in samples[lang]]
        streams[lang] = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)

    def grams(classes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (context of ``order`` classes, next class) and their counts."""
        if len(classes) <= ORDER:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = np.zeros(len(classes) - ORDER, np.int64)
        for back in range(order, 0, -1):
            code = code * k + classes[ORDER - back : len(classes) - back]
        code = code * k + classes[ORDER:]
        return np.unique(code[classes[ORDER:] > 0], return_counts=True)

    # probabilities after each known context, by order; row r of order n belongs to context known[n][r]
    known = [np.zeros(1, np.int64)]
    for order in range(1, ORDER + 1):
        contexts = [grams(streams[lang], order)[0] // k for lang in langs]
        known.append(np.unique(np.concatenate(contexts)) if contexts else np.zeros(0, np.int64))
    tables = []
    for lang in langs:
        prior = (width / width.sum())[None, :]
        by_order = []
        for order in range(ORDER + 1):
            # the row of the context that is one shorter; dropping the oldest class of a known context leaves a known one
            below = np.zeros(len(known[order]), np.int64)
            if order:
                shorter = known[order] % (k ** (order - 1))
                below = np.searchsorted(known[order - 1], shorter)
                below = np.minimum(below, len(known[order - 1]) - 1)
            p = prior[below] if order else prior.copy()
            code, count = grams(streams[lang], order)
            if len(code):
                n = np.zeros((len(known[order]), k))
                n[np.searchsorted(known[order], code // k), code % k] = count
                total, distinct = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
                rest = np.where(n > 0, 0.0, p)
                left = rest.sum(axis=1, keepdims=True)
                escape = np.where(left > 0, distinct, 0)
                share = np.divide(rest, left, out=np.zeros_like(rest), where=left > 0)
                coded = (n + escape * share) / np.maximum(total + escape, 1)
                p = np.where(total > 0, coded, p)
            by_order.append(p)
            prior = p
        tables.append(np.concatenate(by_order))
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = [-np.log2(t / np.where(width > 0, width, 1.0)) for t in tables]
    bits = np.stack(bits, axis=-1) if bits else np.zeros((1, k, 0))
    bits = np.where(np.isfinite(bits), bits, 0.0).reshape(len(bits) * k, len(langs)).astype(np.float32)

    starts = np.cumsum([0] + [len(x) for x in known])
    state = np.zeros(k**ORDER, np.int32)
    for order in range(1, ORDER + 1):
        rows = (starts[order] + np.arange(len(known[order]))).astype(np.int32)
        spread = k ** (ORDER - order)  # every longer context that ends in this one
        state.reshape(spread, k**order)[:, known[order]] = rows
    return ContextTrees(langs, byte_class, k, state, bits)


def sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """Whole texts of a bounded, repeatable sample of each language, chosen by a hash of the id and the text.

    ``labelled`` has doc_id, text and lang. At most ``docs`` texts a language reach the driver, and of these the
    first whose sizes add up to ``most_bytes`` (a longer text is passed over).
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.octet_length("text").alias("size"), F.xxhash64("doc_id", "text").alias("pick"))
    rows = rows.where((F.col("size") > 0) & (F.col("size") <= most_bytes))
    # ranked within lanes first, so that a language that holds most rows leaves few to the rank over all its lanes
    lane = Window.partitionBy("lang", F.pmod("pick", F.lit(LANES))).orderBy("pick", "size")
    narrow = Window.partitionBy("lang").orderBy("pick", "size")
    chosen = rows.select("lang", "pick", "size").withColumn("rank", F.row_number().over(lane)).where(F.col("rank") <= docs)
    chosen = chosen.withColumn("rank", F.row_number().over(narrow)).where(F.col("rank") <= docs)
    upto = Window.partitionBy("lang").orderBy("rank")
    chosen = chosen.withColumn("upto", F.sum("size").over(upto)).where(F.col("upto") <= most_bytes)
    taken = {(r.lang, r.pick) for r in chosen.select("lang", "pick").collect()}
    out: dict[str, list[bytes]] = {}
    if taken:
        picks = sorted({p for _, p in taken})
        texts = rows.where(F.col("pick").isin(picks)).groupBy("lang", "pick").agg(F.first("text").alias("text"))
        for r in texts.orderBy("lang", "pick").collect():
            if (r.lang, r.pick) in taken:
                out.setdefault(r.lang, []).append(r.text.encode())
    return out


def predict(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and bits_per_byte; rows stay where they are.

    The language with the shortest code wins, ties going to the first by name; ``score`` is its share of
    2 ** -length over all languages. ``und`` with score 0 and null bits if the text is null, has no letter, or no
    language was learned. Columns of ``docs`` that bear one of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(trees, f.name) for f in fields(trees)))

    def score(texts: pa.Array) -> dict[str, pa.Array]:
        import regex

        letter = regex.compile(r"\p{L}")
        model = ContextTrees(*shared.value)
        given = texts.to_pylist()
        ok = [i for i, t in enumerate(given) if t and model.langs and letter.search(t)]
        raw = [given[i].encode() for i in ok]
        lang: list[str] = [UNKNOWN] * len(given)
        sure = np.zeros(len(given))
        rate: list[float | None] = [None] * len(given)
        if ok:
            bits = model.lengths(raw)
            best = bits.argmin(axis=1)
            least = bits[np.arange(len(ok)), best]
            share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            for j, i in enumerate(ok):
                lang[i], rate[i] = model.langs[best[j]], float(least[j] / len(raw[j]))
            sure[ok] = share
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(sure), "bits_per_byte": pa.array(rate, pa.float64())}

    return map_columns(docs, [text], score, SCHEMA)


def held_out(doc_id: str = "doc_id", mod: int = 5, rest: int = 0):
    """Whether crc32 of the id as text leaves ``rest``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % mod == rest


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the labelled documents that are not held out and predict all; adds held_out, lang_pred, score, bits_per_byte.

    Columns of ``docs`` with one of these names are replaced. Null ids count as the empty text in the checksum, null
    texts and labels teach nothing. An empty table gives an empty one, one without labels ``und`` throughout.
    """
    flagged = docs.withColumn("held_out", held_out())
    return predict(flagged, fit(sample(flagged.where("NOT held_out"))))


def keep_known(docs: DataFrame, most_bits: float = REJECT_BITS) -> DataFrame:
    """The documents in some learned language; a null lang is filled with the prediction.

    Where no language can be learned (no labelled text, an empty table) nothing is rejected and all rows pass as they
    are. Rows with equal ids are judged each. All columns of ``docs`` stay, whatever their names.
    """
    made = {"held_out", "lang_pred", "score", "bits_per_byte"}
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c.lower() in made}
    flagged = docs.withColumnsRenamed(own).withColumn("held_out", held_out())
    trees = fit(sample(flagged.where("NOT held_out")))
    if not trees.langs:
        return docs
    found = predict(flagged, trees).where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") <= most_bits))
    found = found.withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])
