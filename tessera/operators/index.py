"""Sorted keys: Elias-Fano parts, predecessor search, and a learned index of linear segments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fit import longest
from tessera.functions.groups import map_groups
from tessera.sources.fragments import cut, materialise

CHUNK = 1 << 16


def low_width(n: int, universe: int) -> int:
    """Bits of the low part for ``n`` values below ``universe``."""
    return 1 if n == 0 or n > universe else max(1, math.floor(max(1.0, math.log2(universe * math.log(2) / n)) + 0.5))


def split(key: Column, width: int) -> tuple[Column, Column]:
    """High and low part."""
    return F.shiftright(key, width), key.bitwiseAND(F.lit((1 << width) - 1))


def elias_fano_bits(n: int, universe: int) -> int:
    w = low_width(n, universe)
    return n * w + (universe >> w) + n + 1


def ranked(keys: DataFrame, key: str = "key") -> DataFrame:
    """``key, rank`` from 0, by range partitions: rows of a partition are counted first, so no task holds all keys."""
    p = cut(keys.select(F.col(key).alias("key")), "key")
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = p.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"))
    return p.join(F.broadcast(before), "part").select("key", (F.col("before") + F.col("place")).cast("bigint").alias("rank"))  # one row a partition


def predecessor(keys: DataFrame, probes: DataFrame, key: str = "key", probe: str = "probe") -> DataFrame:
    """``probe, predecessor``: the largest key not above the probe, null below the first.

    Keys and probes lie together in range partitions of similar size, whatever their distribution; a probe sees its
    partition, and the largest key of the partitions before. Only one row a partition meets in one place.
    """
    both = keys.select(F.col(key).alias("v"), F.lit(0).alias("is_probe")).unionByName(probes.select(F.col(probe).alias("v"), F.lit(1).alias("is_probe")))
    both = cut(both, "v", "is_probe")
    own = F.when(F.col("is_probe") == 0, F.col("v"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy("part").agg(F.max(own).alias("top")).select("part", F.max("top").over(w).alias("carry"))
    w = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("own", F.max(own).over(w)).filter("is_probe = 1")
    return found.join(F.broadcast(carry), "part").select(F.col("v").alias("probe"), F.coalesce("own", "carry").alias("predecessor"))


#: Ranks of one group of an Elias-Fano table, so that no row grows with the keys.
GROUP = 4096
ELIAS_FANO = "grp bigint, high bigint, first_rank bigint, width int, lows array<bigint>"


def elias_fano(ranks: DataFrame, width: int) -> DataFrame:
    """Sorted keys (``key, rank``) in the parts that Elias-Fano stores: one row for each high part and group of ranks, with its low parts in order."""
    h, low = split(F.col("key"), width)
    each = ranks.select(F.floor(F.col("rank") / GROUP).alias("grp"), h.alias("high"), F.struct("rank", low.alias("low")).alias("x"))
    g = each.groupBy("grp", "high").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select("grp", "high", F.col("x")[0]["rank"].alias("first_rank"), F.lit(width).alias("width"), F.col("x.low").alias("lows"))


def elias_fano_keys(stored: DataFrame) -> DataFrame:
    """``key, rank`` of all keys of a stored table."""
    e = stored.select("high", "first_rank", "width", F.posexplode("lows").alias("i", "low"))
    return e.select(F.call_function("shiftleft", F.col("high"), F.col("width")).bitwiseOR(F.col("low")).alias("key"), (F.col("first_rank") + F.col("i")).alias("rank"))


def elias_fano_at(stored: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rank, key`` of the given ranks; those outside have no row. An equi-join by group, then the row that holds the rank."""
    p = ranks.select("rank").withColumn("grp", F.floor(F.col("rank") / GROUP))
    j = stored.join(p, "grp").filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.size("lows")))
    low = F.get("lows", (F.col("rank") - F.col("first_rank")).cast("int"))
    return j.select("rank", F.call_function("shiftleft", F.col("high"), F.col("width")).bitwiseOR(low).alias("key"))


def elias_fano_around(stored: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rank, key, before, after``: each key with its neighbours, null at the ends."""
    r = ranks.select("rank")
    each = r.select(F.explode(F.array(F.col("rank") - 1, F.col("rank"), F.col("rank") + 1)).alias("rank")).distinct()
    keys = materialise(elias_fano_at(stored, each), "around")
    side = lambda d, name: keys.select((F.col("rank") - d).alias("rank"), F.col("key").alias(name))
    return r.join(keys, "rank").join(side(-1, "before"), "rank", "left").join(side(1, "after"), "rank", "left")


SEGMENTS = "chunk bigint, seg int, first bigint, slope double, at double, base bigint"


def _segments(key: np.ndarray, rank: np.ndarray, error: float) -> list[tuple]:
    out, at, n = [], 0, len(key)
    while at < n:
        ahead = 1024
        while True:  # numbers are counted from the first key, so that doubles hold them
            x = (key[at : at + ahead] - key[at]).astype(np.float64)
            r = (rank[at : at + ahead] - rank[at]).astype(np.float64)
            k, slope, b = longest(x.tolist(), (r - error).tolist(), (r + error).tolist(), 0, len(x))
            if k < len(x) or at + len(x) == n:
                break
            ahead *= 4
        out.append((int(key[at]), slope, b, int(rank[at])))
        at += k
    return out


def pgm_build(ranks: DataFrame, error: int = 8, chunk: int = CHUNK) -> DataFrame:
    """Bottom level of the index over distinct ``key, rank``: segments whose line is within ``error`` of every rank."""

    def run(key, columns):
        return [(int(key[0]), k, *s) for k, s in enumerate(_segments(columns["key"], columns["rank"], error))]

    r = ranks.select(F.floor(F.col("rank") / chunk).alias("chunk"), "key", "rank")
    return map_groups(r, ["chunk"], ["rank"], run, SEGMENTS)


#: Bytes of a segment: first key, slope, place and rank at its start.
SEGMENT_BYTES = 32


def pgm_tower(segments: DataFrame, error: int = 4) -> list[DataFrame]:
    """The levels of an index from the bottom to a single segment; each is built over the first keys of the one below, and
    has the rank of each segment (``rank``, by ``first``)."""
    levels = []
    while True:
        keyed = ranked(segments.select(F.col("first").alias("key")))
        level = materialise(segments.join(keyed, F.col("first") == F.col("key")).select("rank", "first", "slope", "at", "base"), "level")
        levels.append(level)
        if level.count() <= 1:
            return levels
        segments = pgm_build(keyed, error)


def pgm_levels(segments: DataFrame, error: int = 4) -> DataFrame:
    """``level, segments, bytes`` from the bottom up to a single segment."""
    out = None
    for k, level in enumerate(pgm_tower(segments, error)):
        one = level.agg(F.count("*").alias("segments")).select(F.lit(k).alias("level"), "segments", (F.col("segments") * SEGMENT_BYTES).alias("bytes"))
        out = one if out is None else out.unionByName(one)
    return out


def pgm_descend(levels: list[DataFrame], probes: DataFrame, n: int, error: int = 8, upper: int = 4) -> DataFrame:
    """``probe, lo, hi`` as ``pgm_search``, down the levels: a segment gives a range of ranks in the level below, in which the
    last one that begins at or before the probe is looked for. Ranges are a few ranks wide; each level is one join by rank."""
    p = probes.select("probe").distinct().withColumn("rank", F.lit(0).cast("bigint"))
    for k in range(len(levels) - 1, -1, -1):
        e = error if k == 0 else upper
        size = n if k == 0 else levels[k - 1].count()
        s = levels[k].withColumn("next_base", F.col("rank") + 1).join(levels[k].select((F.col("rank")).alias("next_base"), F.col("base").alias("end")), "next_base", "left").drop("next_base")
        j = p.join(s, "rank")
        guess = F.floor(F.col("base") + F.col("slope") * (F.col("probe") - F.col("first")) + F.col("at"))
        guess = F.greatest(F.lit(0), F.least(guess, F.coalesce("end", F.lit(size))))
        below = F.col("probe") < F.col("first")
        lo = F.when(below, 0).otherwise(F.greatest(F.lit(0), guess - e - 1)).cast("bigint")
        hi = F.when(below, 0).otherwise(F.least(F.lit(size), guess + e + 2)).cast("bigint")
        found = j.select("probe", lo.alias("lo"), hi.alias("hi"))
        if not k:
            return found
        each = found.withColumn("rank", F.explode(F.sequence("lo", "hi"))).join(levels[k - 1].select("rank", "first"), "rank")
        p = each.groupBy("probe").agg(F.coalesce(F.max(F.when(F.col("first") <= F.col("probe"), F.col("rank"))), F.lit(0).cast("bigint")).alias("rank"))


def pgm_search(segments: DataFrame, probes: DataFrame, n: int, error: int = 8) -> DataFrame:
    """``probe, lo, hi``: the first rank whose key is not below the probe is in ``[lo, hi]``, ``hi`` at most ``n``."""
    owner = predecessor(segments, probes.select("probe").distinct(), "first", "probe")
    nxt = segments.withColumn("next_base", F.lead("base", 1, n).over(Window.partitionBy("chunk").orderBy("first")))
    j = owner.join(nxt, owner["predecessor"] == nxt["first"], "left")
    guess = F.floor(F.col("base") + F.col("slope") * (F.col("probe") - F.col("first")) + F.col("at"))
    guess = F.greatest(F.lit(0), F.least(guess, F.col("next_base")))
    return j.select("probe", F.coalesce(F.greatest(F.lit(0), guess - error - 1), F.lit(0)).cast("bigint").alias("lo"), F.coalesce(F.least(F.lit(n), guess + error + 2), F.lit(0)).cast("bigint").alias("hi"))


def lower_bound(ranks: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """``probe, rank`` of the first key not below it (``n`` if there is none), looking only at ranks in ``[lo, hi]``."""
    each = found.withColumn("rank", F.explode(F.sequence("lo", "hi")))
    j = each.join(ranks, "rank", "left").filter("key >= probe OR key IS NULL")
    return j.groupBy("probe").agg(F.least(F.min("rank"), F.lit(n)).cast("bigint").alias("rank"))
