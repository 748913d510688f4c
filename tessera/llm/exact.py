"""Exact dedup (operator 2) by progressive refinement, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, materialise, spread, table

PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, length, prefix_hash, full_hash`` of every row, from one pass over the texts."""
    t = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("t"))
    return t.select("id", F.length("t").alias("length"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("prefix_hash"), F.sha2("t", 256).alias("full_hash"))


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once; counts are summed before the shuffle and hot keys may be split.

    The rows are written: an aggregate above would otherwise take over the join's partitioning, in which all rows
    of a hot key lie in one task, and count there without summing before its shuffle.
    """
    shared = rows.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    return materialise(rows.join(spread(shared), keys, "left_semi"), "repeated")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of equal normalised texts: ``id, keep_id, group_size, kept, full_hash``, one row per input row.

    Refines by length, then by prefix hash, then by the hash of the full text; a row leaves the refinement as soon
    as nothing shares its key. Null texts equal empty ones. Rows of one id are each a member: both stay if that id is
    the smallest of its group. A null id never stays before another; a group of null ids keeps null. An empty table
    gives no rows.
    """
    sig = materialise(signatures(docs, key, text), "signatures")
    left = repeated(repeated(sig, ["length"]), ["length", "prefix_hash"])
    keys = ["length", "prefix_hash", "full_hash"]
    groups = left.groupBy(*keys).agg(F.min("id").alias("low"), F.count("*").alias("c")).filter("c > 1")
    out = sig.join(spread(groups), keys, "left")
    keep = F.coalesce("low", "id")
    return out.select("id", keep.alias("keep_id"), F.coalesce("c", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "full_hash")


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told by id and text, so of rows that share an id only those whose own text stays do; rows alike in both stay
    or go together. Null texts count as empty, null ids match themselves, an empty table gives an empty table.
    """
    stay = exact_groups(docs, key, text).filter("kept").select(F.col("id").alias("__stay"), F.col("full_hash").alias("__hash")).distinct()
    return docs.join(stay, F.col(key).eqNullSafe(F.col("__stay")) & (F.sha2(normalised(F.col(text)), 256) == F.col("__hash")), "left_semi")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("full_hash").alias("text_sha256")
    )


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""
