"""Numbers of a fixed width in binary columns: packed and unpacked in NumPy, read one by one as a Column expression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width, most significant bit first, one after the other."""
    if not width:
        return b""
    v = np.ascontiguousarray(values).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.packbits(np.unpackbits(v, axis=1)[:, 64 - width :]).tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def pack_fields(values: np.ndarray, widths: np.ndarray) -> bytes:
    """As ``pack``, each value in a width of its own, up to 64."""
    ends = np.cumsum(widths)
    which = np.repeat(np.arange(len(widths)), widths)
    shift = (ends[which] - 1 - np.arange(len(which))).astype(np.uint64)
    return np.packbits(((values[which] >> shift) & np.uint64(1)).astype(np.uint8)).tobytes()


def field(data: bytes, bit: int, width: int) -> int:
    """The number of ``width`` bits from ``bit`` on."""
    end = bit + width
    last = (end + 7) >> 3
    return int.from_bytes(data[bit >> 3 : last], "big") >> (8 * last - end) & ((1 << width) - 1)


def pack_column(values: Column, width: Column) -> Column:
    """An array of numbers that aren't negative to ``pack`` of it; null for null."""

    @F.arrow_udf("binary")
    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        return pa.array([pack(flat[a:z], n) for a, z, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), w.to_pylist(), strict=True)], pa.binary())

    return run(values, width.cast("int"))


def unpack_column(data: Column, width: Column, n: Column) -> Column:
    """The inverse: ``n`` numbers each; zeros where the width is 0 or the data null."""

    @F.arrow_udf("array<bigint>")
    def run(d: pa.Array, w: pa.Array, k: pa.Array) -> pa.Array:
        return pa.array([unpack(x or b"", y if x else 0, z).view(np.int64) for x, y, z in zip(d.to_pylist(), w.to_pylist(), k.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return run(data, width.cast("int"), n.cast("int"))


def field_column(data: Column, index: Column, width: Column) -> Column:
    """The ``index``-th number (from 0) of ``pack``, from the nine bytes around it; widths are 1 to 64."""
    shift = lambda f, x, n: F.call_function(f, x, n.cast("int"))
    bit = index.cast("bigint") * width
    first, off = shift("shiftright", bit, F.lit(3)) + 1, bit.bitwiseAND(F.lit(7).cast("bigint"))
    byte = lambda at, n: F.hex(F.substring(data, at.cast("int"), F.lit(n)))
    word = F.conv(F.rpad(byte(first, 8), 16, "0"), 16, -10).cast("bigint")
    after = F.coalesce(F.conv(byte(first + 8, 1), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return shift("shiftrightunsigned", shift("shiftleft", word, off).bitwiseOR(shift("shiftright", after, 8 - off)), 64 - width)
