"""Series from tables and binary files, and the normalisation of their values."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.fragments import cut


def to_series(df: DataFrame, series: Column, order: Sequence, value: Column, pos: Column | None = None) -> DataFrame:
    """``series_id, pos, y``: the position in the order of a series, counted from 0. Rows without value are left out.

    With a dense ``pos`` no window is needed, which for one huge series would be one task.
    """
    df = df.select(series.cast("string").alias("series_id"), value.alias("y"), (F.lit(0) if pos is None else pos).cast("bigint").alias("pos"), *(c.alias(f"o{k}") for k, c in enumerate(order)))
    df = df.filter(F.col("y").isNotNull())
    if pos is None:
        w = Window.partitionBy("series_id").orderBy(*(f"o{k}" for k in range(len(order))), "y")
        df = df.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint"))
    return df.select("series_id", "pos", "y")


def to_series_large(df: DataFrame, series: Column, order: Sequence, value: Column) -> DataFrame:
    """As ``to_series``, for series that no task can hold: range partitions by series and order are written once, and a
    point's position is its place in its partition plus the points of its series in the partitions before."""
    names = [f"o{k}" for k in range(len(order))]
    df = df.select(series.cast("string").alias("series_id"), value.alias("y"), *(c.alias(n) for n, c in zip(names, order, strict=True)))
    p = cut(df.filter(F.col("y").isNotNull()), "series_id", *names, "y")
    counts = p.groupBy("series_id", "part").agg(F.count("*").alias("c"), F.min("place").alias("first"))
    w = Window.partitionBy("series_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a series reaches into
    counts = counts.select(F.col("series_id").alias("of"), F.col("part").alias("in"), (F.coalesce(F.sum("c").over(w), F.lit(0)) - F.col("first")).alias("add"))
    j = p.join(counts, F.col("series_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    return j.select("series_id", (F.col("place") + F.col("add")).cast("bigint").alias("pos"), "y")


def cents(c: Column) -> Column:
    return F.round(c * 100).cast("bigint")


def shifts(points: DataFrame, epsilon: int) -> DataFrame:
    """``series_id, shift``: what is taken off so that all values are above ``epsilon``."""
    low = F.min("y")
    return points.groupBy("series_id").agg((F.when(low < 0, low - 1).otherwise(F.lit(-1)) - epsilon).cast("bigint").alias("shift"))


def normalise(points: DataFrame, epsilon: int) -> DataFrame:
    """``points`` with ``shift``, and ``y`` less it, by a join with one row a series: no series has to fit one task."""
    s = shifts(points, epsilon)
    return points.join(s, "series_id").withColumn("y", F.col("y") - F.col("shift"))


def denormalise(points: DataFrame) -> DataFrame:
    return points.withColumn("y", F.col("y") + F.col("shift")).drop("shift")


def read_binary(spark: SparkSession, path: str, dtype: str = "<i8", header: bool = True, max_size: int | None = None, pattern: str = "*.bin") -> DataFrame:
    """``series_id`` (the file's path), ``pos, y`` of arrays of eight-byte numbers, with or without a leading count."""
    kind = "double" if dtype.endswith("f8") else "bigint"

    def run(batches):
        for b in batches:
            for name, data in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                n = len(data) // 8
                if header:
                    if len(data) < 8:
                        raise ValueError(f"{name} has no count")
                    n, data = min(struct.unpack("<q", data[:8])[0], n - 1), data[8:]
                n = n if max_size is None else min(n, max_size)
                y = np.frombuffer(data, dtype, n)
                for a in range(0, n, 1 << 16):
                    part = y[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part), dtype=np.int64)), pa.array(part.astype(dtype.lstrip("<>")))], names=["series_id", "pos", "y"])

    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(run, f"series_id string, pos bigint, y {kind}")


def read_rows(spark: SparkSession, path: str, schema: str, delimiter: str = " ") -> DataFrame:
    """Text rows parted by one character, without quoting."""
    return spark.read.option("sep", delimiter).option("quote", "").schema(schema).csv(path)


def uniform_keys(spark: SparkSession, n: int, seed: int = 123) -> DataFrame:
    """``n`` keys, uniform below 2**62."""
    return spark.range(n).select((F.rand(seed) * float(1 << 62)).cast("bigint").alias("key"))
