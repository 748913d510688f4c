"""Block codecs on 64-bit patterns: XOR codecs, direct-addressable codes, general-purpose compressors."""

from __future__ import annotations

import lzma

import numpy as np
import pyarrow as pa

from tessera.functions.bits import field, pack, pack_fields, unpack

MASK = (1 << 64) - 1


class Writer:
    """Fields of up to 64 bits, most significant bit first; packed all together at the end."""

    def __init__(self):
        self.values, self.widths = [], []

    def put(self, value: int, bits: int) -> None:
        self.values.append(value)
        self.widths.append(bits)

    def done(self) -> tuple[bytes, int]:
        widths = np.array(self.widths, np.int64)
        return pack_fields(np.array(self.values, np.uint64), widths), int(widths.sum())


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def get(self, bits: int) -> int:
        if not bits:
            return 0
        a, end = self.at, self.at + bits
        self.at = end
        last = (end + 7) >> 3
        return int.from_bytes(self.data[a >> 3 : last], "big") >> (8 * last - end) & ((1 << bits) - 1)


def clz(x: int) -> int:
    return 64 - x.bit_length()


def ctz(x: int) -> int:
    return (x & -x).bit_length() - 1 if x else 64


def gorilla_encode(v: list[int]) -> tuple[bytes, int]:
    """XOR with the value before; a window of meaningful bits is kept as long as it fits. Length 64 is written as 0."""
    w = Writer()
    w.put(v[0], 64)
    lead, trail = 0, 64
    for before, now in zip(v, v[1:], strict=False):
        x = before ^ now
        if not x:
            w.put(0, 1)
            continue
        lz, tz = min(clz(x), 31), ctz(x)
        if lz >= lead and tz >= trail and lead + trail < 64:
            w.put(0b10, 2)
            w.put(x >> trail, 64 - lead - trail)
        else:
            n = 64 - lz - tz
            w.put(0b11, 2)
            w.put(lz, 5)
            w.put(n & 63, 6)
            w.put(x >> tz, n)
            lead, trail = lz, tz
    return w.done()


def gorilla_decode(data: bytes, n: int) -> list[int]:
    r = Reader(data)
    out = [r.get(64)]
    lead, trail = 0, 64
    while len(out) < n:
        x = 0
        if r.get(1):
            if r.get(1):
                lead = r.get(5)
                trail = 64 - lead - (r.get(6) or 64)
            x = r.get(64 - lead - trail) << trail
        out.append(out[-1] ^ x)
    return out


# The leading-zero classes of the Chimp codecs.
CLASSES = (0, 8, 12, 16, 18, 20, 22, 24)


def _class(lz: int) -> int:
    return next(k for k in range(7, -1, -1) if CLASSES[k] <= lz)


def chimp_encode(v: list[int], window: int = 1) -> tuple[bytes, int]:
    """Chimp, or with ``window=128`` the variant that may refer to one of 128 values by their low 14 bits.

    Flags: 00 equal, 01 many trailing zeros, 10 leading class as before, 11 new leading class.
    """
    far = window > 1
    index_bits, least = (7, 13) if far else (0, 6)
    w = Writer()
    w.put(v[0], 64)
    last_seen: dict[int, int] = {}
    if far:
        last_seen[v[0] & 0x3FFF] = 0
    stored = -1
    for k in range(1, len(v)):
        now, ref = v[k], k - 1
        x = v[ref] ^ now
        tz = ctz(x)
        if far:
            cand = last_seen.get(now & 0x3FFF, -1)
            if 0 <= cand and k - cand <= window and ctz(v[cand] ^ now) > least:
                ref, x = cand, v[cand] ^ now
                tz = ctz(x)
            elif x and tz > least:
                tz = least
            last_seen[now & 0x3FFF] = k
        if not x:
            w.put(0, 2)
            w.put(ref % (1 << index_bits), index_bits)
            stored = -1
        elif tz > least:
            c = _class(clz(x))
            n = 64 - CLASSES[c] - tz
            w.put(1, 2)
            w.put(ref % (1 << index_bits), index_bits)
            w.put(c, 3)
            w.put(n & 63, 6)
            w.put(x >> tz, n)
            stored = -1
        else:
            c = _class(clz(x))
            if c == stored:
                w.put(2, 2)
            else:
                w.put(3, 2)
                w.put(c, 3)
                stored = c
            w.put(x, 64 - CLASSES[c])
    return w.done()


def chimp_decode(data: bytes, n: int, window: int = 1) -> list[int]:
    far = window > 1
    r = Reader(data)
    out = [r.get(64)]
    c = 0
    while len(out) < n:
        flag, k = r.get(2), len(out)
        if flag < 2:
            ref = out[k - 1]
            if far:
                slot = r.get(7)
                ref = out[k - 1 - (k - 1 - slot) % 128]
            x = 0
            if flag:
                lead = CLASSES[r.get(3)]
                size = r.get(6) or 64
                x = r.get(size) << (64 - lead - size)
            out.append(ref ^ x)
        else:
            if flag == 3:
                c = r.get(3)
            out.append(out[-1] ^ r.get(64 - CLASSES[c]))
    return out


def _zeros(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading and trailing zeros of 64-bit patterns; 64 and 64 of zero."""
    full = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        full |= full >> np.uint64(k)
    low = (x & (~x + np.uint64(1))) - np.uint64(1)
    return 64 - np.bitwise_count(full).astype(np.int64), np.bitwise_count(low).astype(np.int64)


#: Values that a block of TSXor refers back to.
NEAR = 127


def tsxor_encode(v: list[int]) -> tuple[bytes, int]:
    """Whole bytes, and a window of the last 127 values (zeros at first), newest first: a hit is its place; else the xor
    with the value that leaves most zeros at both ends, without its zero bytes; else 255 and the value."""
    out = bytearray()
    past = np.concatenate((np.zeros(NEAR, np.uint64), np.array(v, np.uint64)))
    for k, x in enumerate(v):
        d = past[k : k + NEAR][::-1] ^ past[k + NEAR]
        hit = np.flatnonzero(d == 0)
        if len(hit):
            out.append(int(hit[0]))
            continue
        lead, trail = _zeros(d)
        o = int((lead + trail).argmax())
        lead, trail = int(lead[o]) // 8, int(trail[o]) // 8
        if lead + trail > 1:
            n = 8 - lead - trail
            out += bytes((0x80 | o, trail << 4 | n)) + (int(d[o]) >> 8 * trail).to_bytes(n, "big")
        else:
            out += b"\xff" + x.to_bytes(8, "big")
    return bytes(out), 8 * len(out)


def tsxor_decode(data: bytes, n: int) -> list[int]:
    out, window, at = [], [0] * 127, 0
    while len(out) < n:
        b = data[at]
        at += 1
        if b < 0x80:
            x = window[b]
        elif b == 255:
            x, at = int.from_bytes(data[at : at + 8], "big"), at + 8
        else:
            trail, size = data[at] >> 4, data[at] & 15
            x = window[b & 127] ^ int.from_bytes(data[at + 1 : at + 1 + size], "big") << 8 * trail
            at += 1 + size
        out.append(x)
        window = [x, *window[:-1]]
    return out


def dac_levels(at_least: list[int]) -> list[int]:
    """Bit widths of the levels that make ``dac_encode`` write the fewest bits; ``at_least[b]`` counts the values of ``b`` bits or more.

    A level of ``c`` bits takes a header byte, ``c`` bits for each value that ends in it, and, if any goes on, a mark for
    each value that reaches it.
    """
    top = max((b for b, n in enumerate(at_least) if n), default=0) or 1
    beyond = [*at_least[1:], *[0] * (top + 2)]  # values of more than b bits
    cheapest, chosen = [0] * (top + 1), [top] * (top + 1)
    for b in range(top - 1, -1, -1):
        reach = beyond[b] if b else at_least[0]
        cheapest[b], chosen[b] = min((8 + c * (reach - beyond[c]) + (reach if beyond[c] else 0) + cheapest[c], c) for c in range(b + 1, top + 1))
    widths, b = [], 0
    while b < top:
        b = chosen[b]
        widths.append(b)
    return widths


def _lengths(x: np.ndarray) -> np.ndarray:
    return 64 - _zeros(x)[0]


def dac_encode(v: list[int]) -> tuple[bytes, int]:
    """Number of levels; then, each from a whole byte on: width, marks of the values that go on (not in the last level), values that end there.

    A value is stored whole in the first level it fits, so that one place can be read through its marks alone.
    """
    x = np.array(v, np.uint64)
    lengths = _lengths(x)
    counts = np.bincount(lengths, minlength=66)
    levels = dac_levels(counts[::-1].cumsum()[::-1].tolist())
    out = bytearray([len(levels)])
    bits = 8
    for k, width in enumerate(levels):
        over = lengths > width
        out.append(width)
        if k + 1 < len(levels):
            out += np.packbits(over).tobytes()
            bits += len(x)
        out += pack(x[~over], width)
        bits += 8 + width * int((~over).sum())
        x, lengths = x[over], lengths[over]
    return bytes(out), bits


def _dac_level(data: bytes, at: int, n: int, last: bool) -> tuple[int, np.ndarray | None, int, int]:
    """Width, marks, place of the values, and number of those that end in the level which begins at a byte."""
    width, at = data[at], at + 1
    if last:
        return width, None, at, n
    marks = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) >> 3, at), count=n).astype(bool)
    return width, marks, at + ((n + 7) >> 3), n - int(marks.sum())


def dac_decode(data: bytes, n: int) -> list[int]:
    out, places, at = np.zeros(n, np.uint64), np.arange(n), 1
    for k in range(data[0]):
        width, marks, at, ends = _dac_level(data, at, len(places), k + 1 == data[0])
        here = places if marks is None else places[~marks]
        size = (ends * width + 7) >> 3
        out[here] = unpack(data[at : at + size], width, ends)
        places, at = places[:0] if marks is None else places[marks], at + size
    return out.tolist()


def dac_at(data: bytes, n: int, i: int) -> int:
    """The ``i``-th value alone: its marks lead down the levels, and one field is read."""
    at = 1
    for k in range(data[0]):
        width, marks, at, ends = _dac_level(data, at, n, k + 1 == data[0])
        before = i if marks is None else int(marks[:i].sum())
        if marks is None or not marks[i]:
            return field(data, 8 * at + width * (i if marks is None else i - before), width)
        n, i, at = n - ends, before, at + ((ends * width + 7) >> 3)
    raise ValueError("a value goes on beyond the last level")


def _general(name: str):
    def encode(v: list[int]) -> tuple[bytes, int]:
        raw = np.array(v, np.uint64).astype(">u8").tobytes()
        out = lzma.compress(raw) if name == "xz" else pa.compress(raw, codec=name, asbytes=True)
        return out, 8 * len(out)

    def decode(data: bytes, n: int) -> list[int]:
        raw = lzma.decompress(data) if name == "xz" else pa.decompress(data, decompressed_size=8 * n, codec=name, asbytes=True)
        return np.frombuffer(raw, ">u8").tolist()

    return encode, decode


#: Codecs that read one value without decoding its block.
POINT = {"dac": dac_at}
CODECS = {
    "gorilla": (gorilla_encode, gorilla_decode),
    "chimp": (chimp_encode, chimp_decode),
    "chimp128": (lambda v: chimp_encode(v, 128), lambda d, n: chimp_decode(d, n, 128)),
    "tsxor": (tsxor_encode, tsxor_decode),
    "dac": (dac_encode, dac_decode),
    **{c: _general(c) for c in ("lz4", "snappy", "brotli", "zstd", "xz")},
}
