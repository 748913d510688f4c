"""Mixing sources to target weights (operator 9) by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, materialise, spread, table

#: Documents of a source are ordered by MD5 of seed and id; this many hex digits of it make the bucket of the first of two running sums.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Sources in code point order, null last, weigh ``weights``, repeating. Together they should get ``share`` times all
    sizes; no target may exceed ``max_epochs`` times its source's size. Instead of clamping round by round, sources are
    sorted by cap over weight: those before the first at which the water level fits are clamped, the rest get weight
    times level, which is where the rounds end. If every source is clamped the total stays below the wish. The windows
    run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")).withColumn("fill", F.col("cap") / F.col("w"))
    by_fill = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("rest_w")).withColumn("clamped", F.col("fill") <= F.col("level"))
    level = F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything)  # that of the first; later ones have taken off more than they may
    return s.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """How often each document goes into the mix: ``doc_id, size, source_size, target, copies, taken``, one row per input row.

    A source at ``e`` epochs gives every document ``floor(e)`` times; the fraction goes to documents in seeded order
    (MD5 of ``seed:doc_id``) as long as the middle of the document lies within what is left, so that the words taken miss
    the target by half a document at most. Null text has size 0, null source is a source of its own, rows of equal id
    and size are alike, an empty table gives no rows. Two running sums (over buckets of a source, then within a bucket)
    keep a source that holds most rows from meeting in one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = docs.select("doc_id", "source", words(F.col("text")).alias("size"), h.alias("h"))
    d = materialise(d.withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS)), "sizes")
    buckets = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(run), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    plan = buckets.join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source")
    j = d.join(spread(plan), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    within = Window.partitionBy("source", "bucket").orderBy("h", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(within) - F.col("size") / 2.0
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    j = j.withColumn("base", base).withColumn("middle", middle)
    copies = F.col("base") + F.when((F.col("base") < max_epochs) & (F.col("middle") <= F.col("target") - F.col("base") * F.col("source_size")), 1).otherwise(0)
    return j.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns stay as they are, whatever their names are besides ``__id``,
    ``__source``, ``__size``, ``__copies`` and ``__copy``. Null ids, sources and texts match themselves; an empty table gives no rows."""
    names = docs.columns
    taken = materialise(mix(docs, **options).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies")).distinct(), "copies")
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (words(F.col("text")) == F.col("__size"))
    return docs.join(taken, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*names)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w, CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
f AS (SELECT *, cap / w AS fill, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS rest_w FROM w),
l AS (SELECT *, fill <= rest / rest_w AS clamped FROM f),
lv AS (SELECT max(rest / rest_w) AS level FROM l WHERE NOT clamped),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE w * (SELECT level FROM lv) END AS target FROM l),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS base,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size RANGE UNBOUNDED PRECEDING) - d.size / 2.0::DOUBLE AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (base + CASE WHEN base < 2 AND middle <= target - base * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM m
"""
