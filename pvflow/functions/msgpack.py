"""MsgPack values one by one, written on top of ``struct``; the columnar forms are in ``packing`` and ``decoding``.

Values follow the schema of the column: structs and maps become MsgPack maps,
arrays become arrays, doubles 64-bit floats and floats 32-bit floats.
"""

from __future__ import annotations

import struct

_SMALL_MAP, _SMALL_ARRAY, _SMALL_TEXT = 0x80, 0x90, 0xA0
# Format codes of the MsgPack specification, size in bytes and struct code.
_UINTS = [(0xCC, ">B", 1 << 8), (0xCD, ">H", 1 << 16), (0xCE, ">I", 1 << 32), (0xCF, ">Q", 1 << 64)]
_INTS = [(0xD0, ">b", 1 << 7), (0xD1, ">h", 1 << 15), (0xD2, ">i", 1 << 31), (0xD3, ">q", 1 << 63)]
_FLOATS = {0xCA: ">f", 0xCB: ">d"}
_TEXTS = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}
_BLOBS = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I"}
_ARRAYS = {0xDC: ">H", 0xDD: ">I"}
_MAPS = {0xDE: ">H", 0xDF: ">I"}
_CONST = {0xC0: None, 0xC2: False, 0xC3: True}


def _sized(size: int, small: int, small_limit: int, codes: dict[int, str]) -> bytes:
    if size < small_limit:
        return bytes([small | size])
    for code, fmt in codes.items():
        if size < 1 << (8 * struct.calcsize(fmt)):
            return bytes([code]) + struct.pack(fmt, size)
    raise ValueError("too long for MsgPack")


def map_head(size: int) -> bytes:
    return _sized(size, _SMALL_MAP, 16, _MAPS)


def array_head(size: int) -> bytes:
    return _sized(size, _SMALL_ARRAY, 16, _ARRAYS)


def pack(value) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack("b", value)
        codes, size = (_UINTS, value) if value >= 0 else (_INTS, -value - 1)
        for code, fmt, limit in codes:
            if size < limit:
                return bytes([code]) + struct.pack(fmt, value)
        raise ValueError("integer out of range")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _sized(len(raw), _SMALL_TEXT, 32, _TEXTS) + raw
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), 0, 0, _BLOBS) + bytes(value)
    if isinstance(value, dict):
        body = b"".join(pack(k) + pack(v) for k, v in value.items())
        return map_head(len(value)) + body
    return array_head(len(value)) + b"".join(pack(v) for v in value)


def _constant(value):
    return lambda buf, pos: (value, pos)


def _number(fmt: str):
    packed = struct.Struct(fmt)
    return lambda buf, pos: (packed.unpack_from(buf, pos)[0], pos + packed.size)


def _blob(buf: bytes, pos: int, size: int):
    end = pos + size
    if end > len(buf):
        raise ValueError("cut short")
    return buf[pos:end], end


def _text(buf: bytes, pos: int, size: int):
    raw, pos = _blob(buf, pos, size)
    return raw.decode(), pos


def _extension(buf: bytes, pos: int, size: int):
    """A tagged value; only its bytes are kept."""
    return _blob(buf, pos + 1, size)


def _items(buf: bytes, pos: int, size: int):
    items = []
    for _ in range(size):
        item, pos = unpack_from(buf, pos)
        items.append(item)
    return items, pos


def _pairs(buf: bytes, pos: int, size: int):
    out = {}
    for _ in range(size):
        key, pos = unpack_from(buf, pos)
        out[key], pos = unpack_from(buf, pos)
    return out, pos


def _counted(body, size: int):
    return lambda buf, pos: body(buf, pos, size)


def _prefixed(body, fmt: str):
    number = _number(fmt)

    def read(buf, pos):
        size, pos = number(buf, pos)
        return body(buf, pos, size)

    return read


# The reader of each first byte.
_READERS: dict[int, object] = {
    **{c: _constant(c) for c in range(0x80)},
    **{_SMALL_MAP | n: _counted(_pairs, n) for n in range(16)},
    **{_SMALL_ARRAY | n: _counted(_items, n) for n in range(16)},
    **{_SMALL_TEXT | n: _counted(_text, n) for n in range(32)},
    **{c: _constant(v) for c, v in _CONST.items()},
    **{c: _number(fmt) for c, fmt, _ in (*_UINTS, *_INTS)},
    **{c: _number(fmt) for c, fmt in _FLOATS.items()},
    **{c: _prefixed(_blob, fmt) for c, fmt in _BLOBS.items()},
    **{c: _prefixed(_text, fmt) for c, fmt in _TEXTS.items()},
    **{c: _prefixed(_items, fmt) for c, fmt in _ARRAYS.items()},
    **{c: _prefixed(_pairs, fmt) for c, fmt in _MAPS.items()},
    **{c: _prefixed(_extension, fmt) for c, fmt in zip((0xC7, 0xC8, 0xC9), (">B", ">H", ">I"))},
    **{0xD4 + n: _counted(_extension, 1 << n) for n in range(5)},
    **{c: _constant(c - 256) for c in range(0xE0, 0x100)},
}


def unpack_from(buf: bytes, pos: int = 0):
    """(value, next position); raises ``ValueError`` or ``struct.error`` on bad input."""
    if pos >= len(buf):
        raise ValueError("cut short")
    reader = _READERS.get(buf[pos])
    if reader is None:
        raise ValueError(f"unknown code {buf[pos]}")
    return reader(buf, pos + 1)


def unpack(buf: bytes):
    return unpack_from(bytes(buf))[0]
