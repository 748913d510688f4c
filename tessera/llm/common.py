"""Helpers shared by the training-data operators: scratch tables, Arrow batches, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the five ASCII controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where that is unset, a session in one process gets a temporary folder, which goes when that process ends; on a
    cluster executors would not see it, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def clean_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; call it when the results have been written, which read them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tessera-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Unless the session sets them, rows go to Python in batches of so many, and of 16 MB unless one row is larger: long
    texts make the default of 10,000 large."""
    for name, value in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 16 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage so that a lost executor recomputes from files that all executors see, and hides the
    partitioning of an aggregate, so that adaptive execution may split skewed partitions of a later join.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` before the application's end. Only once all that is made of them has been written
    as well: a lost executor must find everything that is still to be read."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly; a join above then gets an exchange of its own, which adaptive execution can split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches, rows: int = 256, mb: float = 32):
    """Cut Arrow batches so that one piece has few rows and, unless a single row is larger, few megabytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(rows, b.num_rows - at)
            while n > 1 and b.slice(at, n).get_total_buffer_size() and b.slice(at, n).nbytes > mb * 1e6:
                n //= 2
            yield b.slice(at, n)
            at += n


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


#: Bits of the map of ids in ``sieve``, at most: 4 MB.
SIEVE_BITS = 1 << 25


def sieved(df: DataFrame, ids: DataFrame, key: str, hit: str) -> DataFrame:
    """``df`` with a boolean ``hit``: true for every row whose long ``key`` is in ``ids`` (one column), and for some others.

    The ids are hashed to a map of bits, 16 an id up to ``SIEVE_BITS``, whose 4 KB pieces are broadcast. With more ids
    the map fills up and is true for more rows.
    """
    spark, name = df.sparkSession, ids.columns[0]
    bits = min(SIEVE_BITS, 1 << max(15, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(F.lit(7), F.col(c).cast("long")), F.lit(bits))
    at = ids.filter(F.col(name).isNotNull()).select((place(name) + 1).alias("at"))
    pieces_ = at.groupBy(F.bitmap_bucket_number("at").alias("__piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    pieces_ = materialise(pieces_, "sieve")
    j = df.withColumn("__at", place(key)).join(F.broadcast(pieces_), F.shiftright("__at", 15) + 1 == F.col("__piece"), "left")
    low = F.col("__at").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(low, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), low.bitwiseAND(F.lit(7)).cast("int"))) != 0
    return j.withColumn(hit, F.coalesce(on, F.lit(False))).select(*df.columns, hit)


def sieve(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose long ``key`` is in ``ids`` (one column, distinct), and some others: a cheap first step of a
    semi-join, by ``sieved``; so rows that have no match mostly go before anything of them is shuffled."""
    return sieved(df, ids, key, "__hit").filter("__hit").drop("__hit")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of the graph of ``edges`` between long ids: one row ``(node, component)`` per node with an edge.

    Alternates large-star and small-star rounds until nothing changes; each round is one written table.
    ``component`` is the smallest id of the component. Loops, repeated and reversed edges are fine; rows with
    a null end are ignored. A hub's rows may be split, since every join has plain exchanges on both sides.
    """

    def down(df):  # larger end first
        return df.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    e = materialise(down(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(down(large), "large")
        low = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(down(small.unionByName(low.select("u", F.col("m").alias("v")))), "small")
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
