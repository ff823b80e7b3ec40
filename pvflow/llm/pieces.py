"""Sampled SentencePiece segmentations and lossless decoding.

A segmentation is drawn from the piece lattice of a text: forward filtering sums the weights of all
segmentations of every prefix, backward sampling then picks pieces from the end with these sums. The random numbers are a
hash of a seed, the row key and the place in the text, so a row is always segmented alike, wherever it is computed.

Pieces never cross the start of a run of blanks, so a text falls into chunks whose lattices are
independent. Chunks of equal length are filtered and sampled together as matrices; the few long ones one by one in
logarithms. Weights follow the rank of a piece in the vocabulary (a power law), since a BPE
vocabulary has merge ranks and no probabilities. Characters without a piece fall back to byte pieces. So does a
literal U+2581, which would otherwise come back as a blank: decoding gives back every text exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pvflow.llm.common import map_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 7
#: Exponent of the power law; the larger, the closer the samples stay to long pieces.
ALPHA = 1.5
#: Bytes of a chunk beyond which it is segmented by itself.
LONG = 48
#: Cells of the matrices worked on at once, and bytes of text taken at once.
CELLS = 1 << 18
TEXT_BYTES = 1 << 19

_MARK = "▁"
_BLANK = 0xFF  # stands for the blank mark; no UTF-8 text has it
_SCALE = 30.0  # per byte, keeps sums over a chunk in range; cancels out

SCHEMA = "pieces array<int>, n_pieces bigint, lossless boolean"


class Lattice:
    """Trie and weights of a vocabulary."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        spelled: list[bytes] = []
        kept: dict[bytes, tuple[int, float]] = {}
        least = 1.0
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                spelled.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(_MARK, " ").encode())
                rank = max(0.0, -sp.get_score(i))
                weight = (min(rank, size) + 10.0) ** -alpha
                kept[_blanked(piece.replace(_MARK, " "))] = (i, weight)
                least = min(least, weight)
        self.byte_weight = least * 0.1
        nodes = [{}]
        at = [(0, 0.0, 0)]  # per node: id, weight, length
        for piece, (i, weight) in kept.items():
            node = 0
            for b in piece:
                node = nodes[node].setdefault(b, len(nodes))
                if node == len(nodes):
                    nodes.append({})
                    at.append((0, 0.0, 0))
            at[node] = (i, weight, len(piece))
        used = sorted({b for n in nodes for b in n})
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        # node 0 is the dead end, node 1 the root
        self.step = np.zeros((len(nodes) + 1, len(used) + 1), np.int32)
        for n, below in enumerate(nodes):
            for b, m in below.items():
                self.step[n + 1, self.column[b]] = m + 1
        self.node_id = np.array([0] + [a[0] for a in at], np.int64)
        self.node_weight = np.array([0.0] + [a[1] for a in at])
        self.longest = max((a[2] for a in at), default=1)
        # bytes at which every chunk begins and ends, as no piece has them
        self.alone = np.array([b < 0x80 and b not in used for b in range(256)])
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)

    # --- encoding ---

    def encode(self, texts: Sequence[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after the other, and the number of pieces of each; ``keys`` seed the rows."""
        raw = [_blanked(" " + t) if t else b"" for t in texts]
        sizes = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        opens = np.zeros(len(data), bool)
        opens[(ends - sizes)[sizes > 0]] = True
        blank, alone = data == _BLANK, self.alone[data]
        opens[1:] |= (blank[1:] & ~blank[:-1]) | alone[1:] | alone[:-1]
        starts = np.flatnonzero(opens)
        lengths = np.diff(np.append(starts, len(data)))
        doc = np.searchsorted(ends, starts, "right")
        with np.errstate(over="ignore"):
            base = _mixed(keys[doc].astype(np.uint64) ^ _mixed(np.uint64(seed)))
            base = _mixed(base + (starts - (ends - sizes)[doc]).astype(np.uint64))
        out = np.full(len(data), -1, np.int32)
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, bounds):
            n = int(lengths[group[0]])
            if n > LONG:
                for c in group:
                    self._one(data[starts[c] : starts[c] + n], int(base[c]), out[starts[c] : starts[c] + n])
                continue
            rows = max(1, CELLS // (n * min(n, self.longest)))
            for at in range(0, len(group), rows):
                part = group[at : at + rows]
                self._many(data, starts[part], n, base[part], out)
        placed = out >= 0
        upto = np.concatenate([[0], np.cumsum(placed)])
        return out[placed], upto[ends] - upto[ends - sizes]

    def _many(self, data: np.ndarray, starts: np.ndarray, n: int, base: np.ndarray, out: np.ndarray) -> None:
        m = data[starts[:, None] + np.arange(n)]
        columns = self.column[m]
        node = np.ones((len(m), n), np.int32)
        weights, nodes = [], []
        for length in range(1, min(n, self.longest) + 1):
            node = self.step[node[:, : n - length + 1], columns[:, length - 1 :]]
            if length > 1 and not node.any():
                break
            nodes.append(node)
            weights.append(self.node_weight[node] * _SCALE**length)
        lead = _lead_length(m)
        fallback = np.zeros((len(m), n), bool)
        for k in range(1, 5):
            if k > n:
                break
            has = weights[k - 1] > 0 if k <= len(weights) else np.zeros((len(m), n - k + 1), bool)
            lost = (lead[:, : n - k + 1] == k) & ~has
            for j in range(k):
                fallback[:, j : n - k + 1 + j] |= lost
        weights[0] = np.where(fallback, self.byte_weight * _SCALE, weights[0])
        sums = np.zeros((len(m), n + 1))
        sums[:, 0] = 1.0
        for end in range(1, n + 1):
            for length in range(1, min(end, len(weights)) + 1):
                sums[:, end] += sums[:, end - length] * weights[length - 1][:, end - length]
        # from the end, take the length whose share of the sum holds the random number
        rows, pos, turn = np.arange(len(m)), np.full(len(m), n), 0
        while len(rows):
            left = _uniform(base[rows], turn) * sums[rows, pos]
            chosen = np.zeros(len(rows), np.int64)
            open_ = np.arange(len(rows))
            for length in range(1, len(weights) + 1):
                open_ = open_[pos[open_] >= length]
                if not len(open_):
                    break
                r, p = rows[open_], pos[open_] - length
                share = sums[r, p] * weights[length - 1][r, p]
                some = share > 0
                chosen[open_[some]] = length  # the last possible length stands if rounding leaves a rest
                left[open_] -= share
                open_ = open_[~((left[open_] < 0) & some)]
            pos = pos - chosen
            ids = np.empty(len(rows), np.int64)
            for length in np.unique(chosen):
                at = np.flatnonzero(chosen == length)
                ids[at] = self.node_id[nodes[length - 1][rows[at], pos[at]]]
            bytewise = (chosen == 1) & fallback[rows, pos]
            ids[bytewise] = self.byte_id[m[rows[bytewise], pos[bytewise]]]
            out[starts[rows] + pos] = ids
            more = pos > 0
            rows, pos, turn = rows[more], pos[more], turn + 1

    def _one(self, chunk: np.ndarray, base: int, out: np.ndarray) -> None:
        """The same for one chunk of any length, in logarithms."""
        n = len(chunk)
        columns, values = self.column[chunk].tolist(), chunk.tolist()
        lead = _lead_length(chunk).tolist()
        into: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for start in range(n):
            if not lead[start]:
                continue
            node, whole = 1, False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                node = int(self.step[node, columns[end - 1]])
                if not node:
                    break
                if self.node_weight[node] > 0:
                    into[end].append((start, math.log(self.node_weight[node]), int(self.node_id[node])))
                    whole = whole or end == start + lead[start]
            if not whole:
                for j in range(start, min(n, start + lead[start])):
                    into[j + 1].append((j, math.log(self.byte_weight), int(self.byte_id[values[j]])))
        sums = [0.0] + [-math.inf] * n
        for end in range(1, n + 1):
            terms = [sums[s] + w for s, w, _ in into[end]]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                sums[end] = top + math.log(sum(math.exp(t - top) for t in terms))
        pos, turn = n, 0
        while pos:
            left = float(_uniform(np.array([base], np.uint64), turn)[0])
            possible = [(s, w, i) for s, w, i in sorted(into[pos], reverse=True) if sums[s] > -math.inf]
            for s, w, i in possible:
                left -= math.exp(sums[s] + w - sums[pos])
                if left < 0:
                    break
            out[s], pos, turn = i, s, turn + 1

    # --- decoding ---

    def decode(self, pieces: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row of pieces."""
        first = self.spelled_at[pieces]
        size = self.spelled_at[pieces + 1] - first
        stop = np.cumsum(size)
        index = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(first - (stop - size), size)
        whole = self.spelled[index].tobytes()
        stops = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [whole[a + 1 : b] if b > a else b"" for a, b in zip(stops, stops[1:])]


def _blanked(text: str) -> bytes:
    """UTF-8 with every blank as one reserved byte."""
    return text.encode().replace(b" ", bytes([_BLANK]))


def _lead_length(b: np.ndarray) -> np.ndarray:
    """Bytes of the character that begins here, 0 within one."""
    return np.where(b < 0x80, 1, np.where(b == _BLANK, 1, np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, np.where(b >= 0xC0, 2, 0)))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's step."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(base: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mixed(base + np.uint64(turn)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of a bounded size together."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > TEXT_BYTES:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", model_path: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` with pieces, n_pieces and lossless, row by row; nothing is shuffled.

    ``lossless`` says whether decoding the pieces gives back the text; it is checked for every row. A null or empty text
    has no pieces. Rows with equal key and text get equal pieces, a null key counts as 0. Columns of ``docs`` that bear
    one of the new names are replaced. The vocabulary is read on the driver and sent to the tasks.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"model": f.read()})

    def encode(texts: pa.Array, keys: pa.Array) -> dict[str, pa.Array]:
        held = shared.value
        if "lattice" not in held:  # once per worker
            held["lattice"] = Lattice(held["model"], alpha)
        lattice = held["lattice"]
        given = [t or "" for t in texts.to_pylist()]
        seeds = np.array([k or 0 for k in keys.to_pylist()], np.int64).view(np.uint64)
        pieces, counts, same = [], [], []
        for part in groups(given):
            p, c = lattice.encode(given[part], seeds[part], seed)
            same += [d == t.encode() for d, t in zip(lattice.decode(p, c), given[part])]
            pieces.append(p)
            counts.append(c)
        n = np.concatenate(counts)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces).astype(np.int32)))
        return {"pieces": lists, "n_pieces": pa.array(n.astype(np.int64)), "lossless": pa.array(same, pa.bool_())}

    return map_columns(docs, [text, key], encode, SCHEMA)
