"""Fragments on disk: Parquet with packed residuals, a text dump, and tables between stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(fragments: DataFrame, path: str) -> None:
    """By series, chunk and start, so that row-group statistics prune point and range access."""
    fragments.repartitionByRange("series_id", "chunk_id", "start").sortWithinPartitions("series_id", "chunk_id", "start").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; a session in one process gets a temporary folder instead, which goes with it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: computed once, and not again if an executor is lost."""
    path = f"{scratch(df.sparkSession)}-{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in range partitions of similar size, sorted, with the number of its partition and its place in that.

    Written once, so that whatever is computed from it sees the same cuts.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return materialise(d.withColumn("part", F.spark_partition_id()).withColumn("place", place), "cut")


def verify(fragments: DataFrame, points: DataFrame) -> DataFrame:
    """``series_id, n, mismatches``: decompress stored fragments and count the points that differ, or that one side lacks."""
    from tessera.operators.access import decompress

    j = points.select("series_id", "pos", "y").join(decompress(fragments).withColumnRenamed("y", "z"), ["series_id", "pos"], "full")
    return j.groupBy("series_id").agg(F.count("y").alias("n"), F.count_if(~F.col("y").eqNullSafe(F.col("z"))).alias("mismatches"))


def as_rows(fragments: DataFrame) -> DataFrame:
    """Rows of the dump: residuals as ``[a:b:c]``, numbers with five decimals."""
    from tessera.operators.access import residuals

    n = lambda c: F.format_string("%.5f", c)
    listed = F.when((F.col("bpc") == 0) | F.col("residuals").isNull(), F.lit("")).otherwise(F.array_join("r", ":"))
    return fragments.withColumn("r", residuals(fragments)).select("series_id", F.col("frag_id").alias("ifragment"), "bpc", F.col("model").alias("type"), "s", n("t0").alias("t0"), n("t1").alias("t1"), n("t2").alias("t2"), "len", F.concat(F.lit("["), listed, F.lit("]")).alias("residuals"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A dump (``as_rows``) or a size report as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
