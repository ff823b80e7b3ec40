"""Language-model scores from a weighted backoff automaton that is sharded by n-gram.

States are histories: the root, every word and every pair of words of the training texts. A state h has an arc for every
word w that ever followed it, weighted with its smoothed probability

    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K),

where h' is h without its first word, and a failure arc to h' with weight K / (c(h) + K), which is what the formula gives a
word that never followed. So the probabilities of a state add up to 1 whatever its counts are. At the root stands (c + 1) /
(N + V + 1). No n-gram is left out, however rare, and none for the size of the corpus.

The automaton is never in one place. Texts are dealt into chunks. Pass one lists the distinct words, pairs and triples of each
chunk with their training counts, sorted by a 63-bit hash and cut into buckets of the hash range. Each bucket is added up
in one task, and each chunk gets the counts of just its own n-grams back: the arcs its texts can take. Pass two meets
each chunk with them and takes its texts through from left to right, all positions of a chunk at once: the two words before a
position name its state, and the longest one that the counts know gives the arc. What a task holds is bounded by the
size of a chunk (or of a single longer text) and of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.llm.common import durable, parts
from pvflow.llm.langid import held_out

#: Weight of the shorter history, in counts.
K = 4.0
#: Tokens of a chunk, and bytes of text that a bucket stands for.
CHUNK = 1_000_000
BUCKET_BYTES = 6_000_000
#: The end of a text; no word holds a blank.
END = b" "
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KEEP = 200_000
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
ORDERS = 3


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = text.translate(_LOWER).split()  # bytes.split cuts at the six white-space bytes only
    words.append(END)
    return words


class Hasher:
    """63-bit hashes of words, in the high bits; the lowest is free."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        cache, out = self.cache, []
        if len(cache) > _KEEP:
            cache.clear()
        for w in words:
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w, 42) & 0xFFFFFFFFFFFFFFFE
            out.append(h)
        return np.array(out, np.uint64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes, in order (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b >> np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & _EVEN


class Chunk(NamedTuple):
    """Texts one after the other: the first token of each and the keys of the n-grams that end at each token."""

    starts: np.ndarray
    size: int
    keys: list[np.ndarray]
    at: list[np.ndarray]


def chunk_of(hashes: list[np.ndarray]) -> Chunk:
    sizes = np.array([len(h) for h in hashes], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate(hashes)
    place = np.arange(len(words)) - np.repeat(starts, sizes)  # of a token in its text
    second, third = np.flatnonzero(place > 0), np.flatnonzero(place > 1)
    pairs = np.zeros(len(words), np.uint64)
    pairs[second] = _joined(words[second - 1], words[second])
    triples = _joined(pairs[third - 1], words[third])
    return Chunk(starts, len(words), [words, pairs[second], triples], [np.arange(len(words)), second, third])


def _firsts(ordered: np.ndarray) -> np.ndarray:
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return first


def counted(keys: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs where ``out`` (held out) is 0."""
    marked = np.sort(keys | out)
    base = marked & _EVEN
    first = np.flatnonzero(_firsts(base))
    training = (np.uint64(1) - (marked & np.uint64(1))).astype(np.uint32)
    return base[first], np.add.reduceat(training, first).astype(np.uint32) if len(first) else np.zeros(0, np.uint32)


def planes(values: np.ndarray) -> bytes:
    """Whole numbers in as many bytes as the largest needs (first byte), bytes of equal rank together, as those compress best."""
    size = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([size]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    ranks = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((ranks.shape[1], 8), np.uint8)
    out[:, : raw[0]] = ranks.T
    return out.view("<u8").ravel()


def _written(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def _read(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=np.uint64)


class Gathered(NamedTuple):
    """Rows of a chunk: its name, ids, held-out flags, and of each text its hashed tokens or its bytes."""

    name: str
    ids: list
    out: list[bool]
    texts: list


def _chunks(batches: Iterator[pa.RecordBatch], hashed: bool) -> Iterator[Gathered]:
    """The rows of a partition in chunks of at least ``CHUNK`` tokens, named by what is in them."""
    import xxhash

    hasher, ids, held, texts, size, digest = Hasher(), [], [], [], 0, xxhash.xxh3_128()
    for batch in batches:
        for i, out, text in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text")], strict=True):
            raw = (text or "").encode()
            words = tokens(raw)
            ids.append(i)
            held.append(out)
            texts.append(hasher(words) if hashed else raw)
            digest.update(len(raw).to_bytes(8, "big") + bytes([out]))
            digest.update(raw)
            size += len(words)
            if size >= CHUNK:
                full = Gathered(digest.hexdigest(), ids, held, texts)
                ids, held, texts, size, digest = [], [], [], 0, xxhash.xxh3_128()
                yield full
                del full
    if ids:
        yield Gathered(digest.hexdigest(), ids, held, texts)


_ASKED = "kind int, ord int, bucket bigint, chunk string, keys binary, counts binary"


def _ask(buckets: int):
    """The distinct n-grams of each chunk by order and bucket, with their training counts."""
    edges = np.array([-(-j * (1 << 63) // buckets) * 2 for j in range(1, buckets)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _chunks(batches, True):
            chunk = chunk_of(held.texts)
            out = np.repeat(np.array(held.out, np.uint64), [len(h) for h in held.texts])
            held.texts.clear()
            for ord_ in range(ORDERS):
                keys, counts = counted(chunk.keys[ord_], out[chunk.at[ord_]])
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(j, a, b) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                made = {
                    "kind": pa.array([0] * len(rows), pa.int32()),
                    "ord": pa.array([ord_] * len(rows), pa.int32()),
                    "bucket": pa.array([j for j, _, _ in rows], pa.int64()),
                    "chunk": pa.array([held.name] * len(rows), pa.string()),
                    "keys": pa.array([_written(keys[a:b]) for _, a, b in rows], pa.binary()),
                    "counts": pa.array([planes(counts[a:b]) for _, a, b in rows], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))
            del chunk, out, made, keys, counts  # before the next chunk is gathered

    return run


_TOLD = "kind int, ord int, bucket bigint, chunk string, counts binary, total bigint, known bigint"


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, a run at a time."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield now, rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield now, rows


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's counts over all chunks, back to each chunk in the order of its own keys."""
    for (ord_, bucket), rows in _grouped(batches, ["ord", "bucket"]):
        keys = [_read(r["keys"]) for r in rows]
        every = np.concatenate(keys)
        order = np.argsort(every)
        first = _firsts(every[order])
        sums = np.add.reduceat(np.concatenate([unplanes(r["counts"]) for r in rows])[order], np.flatnonzero(first))
        found = np.empty(len(every), np.uint64)
        found[order] = sums[np.cumsum(first) - 1]
        ends = np.cumsum([len(k) for k in keys])
        n = len(rows)
        made = {
            "kind": pa.array([0] * n, pa.int32()),
            "ord": pa.array([ord_] * n, pa.int32()),
            "bucket": pa.array([bucket] * n, pa.int64()),
            "chunk": pa.array([r["chunk"] for r in rows], pa.string()),
            "counts": pa.array([planes(found[e - len(k) : e]) for e, k in zip(ends, keys, strict=True)], pa.binary()),
            "total": pa.array([int(sums.sum())] + [0] * (n - 1), pa.int64()),
            "known": pa.array([int((sums > 0).sum())] + [0] * (n - 1), pa.int64()),
        }
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


_TEXTS = "kind int, ord int, bucket bigint, chunk string, ids array<bigint>, held array<boolean>, sizes array<bigint>, body binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for held in _chunks(batches, False):
        made = {
            "kind": pa.array([1], pa.int32()),
            "ord": pa.array([0], pa.int32()),
            "bucket": pa.array([0], pa.int64()),
            "chunk": pa.array([held.name], pa.string()),
            "ids": pa.array([held.ids], pa.list_(pa.int64())),
            "held": pa.array([held.out], pa.list_(pa.bool_())),
            "sizes": pa.array([[len(t) for t in held.texts]], pa.list_(pa.int64())),
            "body": pa.array([packer.compress(b"".join(held.texts))], pa.binary()),
        }
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def traverse(chunk: Chunk, counts: list[np.ndarray], total: int, known: int, k: float = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: known tokens, sum of the root's log10 probabilities, and log10 probability under the automaton.

    ``counts`` are those of the chunk's distinct n-grams by order, in the order of their keys.
    """
    found = []
    for keys, values in zip(chunk.keys, counts, strict=True):
        order = np.argsort(keys)
        at = np.empty(len(keys), np.int64)
        at[order] = np.cumsum(_firsts(keys[order])) - 1
        found.append(values[at].astype(np.float64))
    one, second, third = found[0], chunk.at[1], chunk.at[2]
    two = np.zeros(chunk.size)
    two[second] = found[1]
    root = (one + 1) / (total + known + 1)
    p = root.copy()
    p[second] = (two[second] + k * root[second]) / (one[second - 1] + k)
    p[third] = (found[2] + k * p[third]) / (two[third - 1] + k)
    sums = lambda x: np.add.reduceat(x, chunk.starts)
    return sums((one > 0).astype(np.int64)), sums(np.log10(root)), sums(np.log10(p))


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(total: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        hasher, names = Hasher(), [c.split()[0] for c in _SCORES.split(", ")]
        for (name,), rows in _grouped(batches, ["chunk"]):
            told = {(r["ord"], r["bucket"]): r["counts"] for r in rows if not r["kind"]}  # equal chunks are told the same
            counts = [np.concatenate([unplanes(told[at]) for at in sorted(told) if at[0] == o] or [np.zeros(0, np.uint64)]) for o in range(ORDERS)]
            for row in (r for r in rows if r["kind"]):
                body, at, hashes = zstandard.ZstdDecompressor().decompress(row["body"]), 0, []
                for size in row["sizes"]:
                    hashes.append(hasher(tokens(body[at : at + size])))
                    at += size
                chunk = chunk_of(hashes)
                if not told or len(counts[0]) != len(np.unique(chunk.keys[0])):
                    raise ValueError(f"chunk {name} was not counted: the input gave its rows in another order; write it first")
                n_known, base, score = traverse(chunk, counts, total, known)
                n = len(hashes)
                arrays = [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(row["held"], pa.bool_()),
                    pa.array([len(h) for h in hashes], pa.int64()),
                    pa.array(n_known, pa.int64()),
                    pa.array(np.full(n, total, np.int64)),
                    pa.array(base),
                    pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                del body, hashes, chunk, arrays
            del told, counts, rows

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``docs`` is read twice and has to give its rows in the same order both times, as files and written tables do; if it
    does not, the job ends with an error. A null text is empty (its only token is the end), a null id counts as the empty
    text in the checksum. Repeated rows are scored and counted each. Without training documents every probability
    is 1 and every score 0; an empty table gives no rows. Words and n-grams are told apart by 63-bit hashes. Further
    columns, of whatever name, are left out.
    """
    spark = docs.sparkSession
    flagged = docs.select("doc_id", "text", held_out(mod=7, rest=2).alias("held_out"))
    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(spark)
    asked = flagged.mapInArrow(_ask(max(1, -(-size // BUCKET_BYTES))), _ASKED)
    told = asked.repartition(n, "ord", "bucket").sortWithinPartitions("ord", "bucket", "chunk").mapInArrow(_add_up, _TOLD)
    told = durable(told, "counts")
    total, known = told.where("ord = 0").agg(F.sum("total"), F.sum("known")).first()
    texts = flagged.mapInArrow(_pack, _TEXTS)
    met = told.drop("total", "known").unionByName(texts, allowMissingColumns=True)
    met = met.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "ord", "bucket")
    return met.mapInArrow(_score(total or 0, known or 0), _SCORES)
