"""Secret scans by dictionary-primed zstandard novelty.

Three fixed patterns give the base findings. Beyond them, every unbroken string in a sensitive
context is judged by its *marginal compressed bytes*: how many bytes zstandard needs for it on top of
the surrounding text, when primed with a dictionary of common identifiers. What an identifier list or
the neighbourhood explains costs little; a random key costs about its own length and is reported.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from pvflow.llm.common import map_columns

# The patterns of the base findings, their order and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: A candidate of the novelty test, and what makes its context sensitive.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"key|secret|token|passw|pwd|auth|bearer|credential|private|session|cookie|signature|salt|licen[cs]e", re.I | re.A
)
CONTEXT_BEFORE = 40
SURROUNDING = 256
#: Marginal bytes per byte from which a candidate counts as incompressible.
NOVELTY = 0.85

SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint"


def primed(words: Sequence[str]):
    """A compressor whose window starts with the identifiers."""
    import zstandard

    data = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def identifier_dictionary() -> tuple[str, ...]:
    """Identifiers that code and configuration files are full of, from the language's own name tables."""
    parts = ["key", "secret", "token", "password", "auth", "bearer", "credential", "private", "session", "user", "config", "value", "name", "example"]
    joined = [f"{a}_{b}" for a in parts for b in parts] + [a + b.title() for a in parts for b in parts]
    methods = sorted({m for t in (str, bytes, dict, list, set, int, float) for m in dir(t)})
    return tuple(joined + sorted(dir(builtins)) + methods + sorted(keyword.kwlist) + parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def marginal_bytes(compressor, surrounding: bytes, candidate: bytes) -> int:
    return len(compressor.compress(surrounding + candidate)) - len(compressor.compress(surrounding))


def novel_spans(text: str, base: list[tuple[int, int, int]], compressor, threshold: float) -> list[tuple[int, int, int]]:
    """Incompressible strings in a sensitive context that no base finding touches."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if not SENSITIVE.search(text, max(0, start - CONTEXT_BEFORE), start):
            continue
        if any(start < e and s < end for s, _, e in base):
            continue
        around = (text[max(0, start - SURROUNDING) : start] + text[end : end + SURROUNDING]).encode("utf-8", "replace")
        candidate = m.group().encode()
        if marginal_bytes(compressor, around, candidate) >= threshold * len(candidate):
            found.append((start, 3, end))
    return found


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, text: str = "text", threshold: float = NOVELTY, dictionary: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, n_novel, base_sha256 and spans.

    One row per input row, in place: nothing is shuffled, so copies, repeated rows and null ids need no care.
    A null text counts as empty (no span, the digest of the empty string). Whole texts are read; the
    window of 256 characters around a candidate is only its yardstick. Columns of ``docs`` that bear one
    of the new names are replaced.
    """
    words = tuple(dictionary) if dictionary is not None else identifier_dictionary()

    def scan(texts: pa.Array) -> dict[str, pa.Array]:
        compressor = primed(words)
        out: list[tuple] = []
        for t in texts.to_pylist():
            t = t or ""
            base = base_spans(t)
            new = novel_spans(t, base, compressor, threshold)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            out.append((*counts, digest, written(sorted(base + new)), len(new)))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.string(), pa.int64()]
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
        return {n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds))}

    return map_columns(docs, [text], scan, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (of the columns of documents) with every found span replaced by ``mark``; n_chars follows.

    Rows stay where they are: null and empty texts stay as they are, repeated rows are treated alike, an empty table stays
    empty. Columns with the names that ``find_secrets`` adds are replaced.
    """
    columns = docs.columns

    def hide(texts: pa.Array, spans: pa.Array, n_chars: pa.Array) -> dict[str, pa.Array]:
        out, sizes = [], []
        for t, s, n in zip(texts.to_pylist(), spans.to_pylist(), n_chars.to_pylist()):
            if s:
                pieces, at = [], 0
                for start, end in sorted(tuple(map(int, x.split(":")[1:])) for x in s.split(",")):
                    if start >= at:
                        pieces += [t[at:start], mark]
                    at = max(at, end)
                t = "".join(pieces) + t[at:]
                n = len(t)
            out.append(t)
            sizes.append(n)
        return {"text": pa.array(out, pa.string()), "n_chars": pa.array(sizes, pa.int64())}

    found = find_secrets(docs)
    return map_columns(found, ["text", "spans", "n_chars"], hide, "text string, n_chars bigint").select(*columns)
