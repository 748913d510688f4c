"""Function families and bit arithmetic as Column expressions: the one evaluator of encoder and decoder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.schema import EXPONENTIAL, LINEAR, QUADRATIC, SQRT


def evaluate(j: Column, model: Column, s: Column, t0: Column, t1: Column, t2: Column) -> Column:
    """Value of a fragment's function at its ``j``-th point (from 0). The quadratic counts from 0, the others from 1."""
    x = (j + 1).cast("double")
    z = j.cast("double")
    return (
        F.when(model == LINEAR, F.ceil(t1 * x + t2))
        .when(model == QUADRATIC, F.ceil(t0 * z * z + t1 * z + t2))
        .when(model == SQRT, F.round(t1 * F.sqrt(x + s) + t2).cast("bigint"))
        .when(model == EXPONENTIAL, F.round(t2 * F.exp(t1 * x)).cast("bigint"))
    )


def evaluate_row(j: Column) -> Column:
    return evaluate(j, *(F.col(c) for c in ("model", "s", "t0", "t1", "t2")))


def epsilon(bpc: Column) -> Column:
    """Largest error above the function that ``bpc`` bits can correct."""
    return F.when(bpc <= 1, F.lit(0)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), (bpc - 1).cast("int")) - 1) if isinstance(bpc, Column) else F.lit(eps(bpc))


def eps(bpc: int) -> int:
    return 0 if bpc <= 1 else (1 << (bpc - 1)) - 1


def bits_of(e: int) -> int:
    """The inverse of ``eps``: 0 for 0, else 1 + log2(e + 1)."""
    return 0 if e <= 0 else (e + 1).bit_length()


def offset(bpc: Column) -> Column:
    """What is added to an error to make a residual that isn't negative."""
    return F.when(bpc == 0, F.lit(0).cast("bigint")).otherwise(epsilon(bpc) + 1)


def bit_length(v: Column) -> Column:
    """Bits of a value read as unsigned, 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def width(low: Column, high: Column) -> Column:
    """Fewest bits for errors from ``low`` to ``high``: 0 only without any error."""
    most = F.greatest(high + 1, -low, F.lit(1).cast("bigint"))
    return F.when((low == 0) & (high == 0), 0).otherwise(1 + bit_length(most - 1)).cast("tinyint")


def leading_zeros(v: Column) -> Column:
    return F.lit(64) - bit_length(v)


def trailing_zeros(v: Column) -> Column:
    return F.when(v == 0, 64).otherwise(bit_length(v.bitwiseAND(F.bitwise_not(v) + F.when(v == F.lit(-(1 << 63)), 0).otherwise(1))) - 1)


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("bigint")))


def rebase(model: int, z: int, s: int, t0: float, t1: float, t2: float):
    """Coefficients of the same function counted from ``z`` points further on."""
    import math

    if model == LINEAR:
        return s, t0, t1, t1 * z + t2
    if model == EXPONENTIAL:
        return s, t0, t1, t2 * math.exp(t1 * z)
    if model == QUADRATIC:
        return s, t0, 2 * t0 * z + t1, t0 * z * z + t1 * z + t2
    return s + z, t0, t1, t2
