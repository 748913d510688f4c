"""Access to compressed series: full, approximate, point and range access. Points and ranges are Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.bits import field_column, unpack_column
from tessera.functions.models import evaluate_row, offset
from tessera.operators.compress import CHUNK
from tessera.schema import QUADRATIC, SQRT


def _value(j: Column) -> Column:
    r = F.when(F.col("bpc") == 0, F.lit(0).cast("bigint")).otherwise(field_column(F.col("residuals"), j, F.col("bpc")) - offset(F.col("bpc")))
    return evaluate_row(j) + r + F.col("shift")


def residuals(f: DataFrame) -> Column:
    """The residuals of each fragment as an array of ``len`` numbers."""
    return unpack_column(F.col("residuals"), F.col("bpc"), F.col("len"))


def decompress(fragments: DataFrame) -> DataFrame:
    """``series_id, pos, y`` of every point."""
    f = fragments.withColumn("r", residuals(fragments))
    f = f.select("series_id", "start", "model", "s", "t0", "t1", "t2", "bpc", "shift", F.posexplode("r").alias("j", "r"))
    return f.select("series_id", (F.col("start") + F.col("j")).alias("pos"), (evaluate_row(F.col("j")) + F.col("r") - offset(F.col("bpc")) + F.col("shift")).alias("y"))


def approximate(fragments: DataFrame) -> DataFrame:
    """``series_id, pos, y`` by the functions alone; the residuals aren't read."""
    f = fragments.select("series_id", "start", "model", "s", "t0", "t1", "t2", "shift", F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("j"))
    return f.select("series_id", (F.col("start") + F.col("j")).alias("pos"), (evaluate_row(F.col("j")) + F.col("shift")).alias("y"))


def at(fragments: DataFrame, probes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``series_id, pos, y`` for rows ``series_id, pos`` of ``probes``: an equi-join on chunk, then the fragment that holds it."""
    p = probes.select("series_id", "pos").withColumn("chunk_id", F.floor(F.col("pos") / chunk))
    j = fragments.join(p, ["series_id", "chunk_id"]).filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("len")))
    return j.select("series_id", "pos", _value(F.col("pos") - F.col("start")).alias("y"))


def at_position(fragments: DataFrame, pos: int, chunk: int = CHUNK) -> DataFrame:
    """One position of every series; the conditions on ``chunk_id`` and ``start`` reach the scan."""
    f = fragments.filter((F.col("chunk_id") == pos // chunk) & (F.col("start") <= pos) & (F.col("start") + F.col("len") > pos))
    return f.select("series_id", F.lit(pos).cast("bigint").alias("pos"), _value(F.lit(pos).cast("bigint") - F.col("start")).alias("y"))


def scan(fragments: DataFrame, first: int, end: int, chunk: int = CHUNK) -> DataFrame:
    """Positions from ``first`` to before ``end`` of every series; only fragments that overlap are opened."""
    f = fragments.filter(F.col("chunk_id").between(first // chunk, max(first, end - 1) // chunk) & (F.col("start") < end) & (F.col("start") + F.col("len") > first) & F.lit(first < end))
    lo = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    hi = F.least(F.lit(end) - F.col("start"), F.col("len").cast("bigint"))
    values = F.transform(F.sequence(lo, hi - 1), _value)  # made before rows are, so that no row carries a payload
    f = f.select("series_id", (F.col("start") + lo).alias("from"), F.posexplode(values).alias("k", "y"))
    return f.select("series_id", (F.col("from") + F.col("k")).alias("pos"), "y")


def ends(fragments: DataFrame) -> DataFrame:
    """Fragments with the start of the next one, the bit offset of their residuals in the series, and how many fragments
    before them have a third coefficient (parabolas) or a shift of their own (square roots).

    Running sums go within a chunk, and chunks, one row each, are summed by series; so a series of many fragments isn't one task.
    """
    bits, quads, roots = F.col("len").cast("bigint") * F.col("bpc"), (F.col("model") == QUADRATIC).cast("bigint"), (F.col("model") == SQRT).cast("bigint")
    f = fragments.withColumn("_b", bits).withColumn("_q", quads).withColumn("_r", roots)
    chunks = f.groupBy("series_id", "chunk_id").agg(F.sum("_b").alias("cb"), F.sum("_q").alias("cq"), F.sum("_r").alias("cr"), F.min("start").alias("first"))
    w = Window.partitionBy("series_id").orderBy("chunk_id")
    before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = chunks.select("series_id", "chunk_id", before("cb").alias("cb"), before("cq").alias("cq"), before("cr").alias("cr"), F.lead("first").over(w).alias("next_first"))
    w = Window.partitionBy("series_id", "chunk_id").orderBy("start")
    so_far = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("next_start", F.lead("start").over(w)).withColumn("_b", so_far("_b")).withColumn("_q", so_far("_q")).withColumn("_r", so_far("_r"))
    f = f.join(chunks, ["series_id", "chunk_id"])
    return f.select(*fragments.columns, F.coalesce("next_start", "next_first").alias("next_start"), (F.col("cb") + F.col("_b")).alias("offset_bits"), (F.col("cq") + F.col("_q")).alias("quadratic_rank"), (F.col("cr") + F.col("_r")).alias("sqrt_rank"))


def slope_cone(points: DataFrame, error: float) -> DataFrame:
    """``series_id, pos, low, high``: the slopes from the first point of a series that pass all points up to each within ``error``;
    null at the first. A running intersection of intervals; it is empty where ``low > high``."""
    anchor = points.groupBy("series_id").agg(F.min(F.struct("pos", "y")).alias("a"))
    p = points.join(anchor, "series_id").withColumn("dx", F.col("pos") - F.col("a.pos")).withColumn("dy", F.col("y") - F.col("a.y"))
    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bound = lambda e: F.when(F.col("dx") > 0, (F.col("dy") + F.lit(float(e))) / F.col("dx"))
    return p.select("series_id", "pos", F.max(bound(-error)).over(w).alias("low"), F.min(bound(error)).over(w).alias("high"))
