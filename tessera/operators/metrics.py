"""Sizes and errors as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.models import bit_length
from tessera.schema import QUADRATIC, SQRT


def errors(points: DataFrame, other: DataFrame, bound: int | None = None, shift: int = 0) -> DataFrame:
    """Per series: points, exact hits, mismatches, largest error, mean relative error, and violations of the bound."""
    j = points.select("series_id", "pos", "y").join(other.select("series_id", "pos", F.col("y").alias("z")), ["series_id", "pos"])
    e = F.col("y") - F.col("z")
    out = [F.count("*").alias("n"), F.count_if(e == 0).alias("exact"), F.count_if(e != 0).alias("mismatches"), F.max(F.abs(e)).alias("max_error"), F.avg(F.abs(e / (F.col("y") - shift).cast("double"))).alias("mape")]
    if bound is not None:
        out.append(F.count_if((e > bound) | (e < -(bound + 1))).alias("violations"))
    return j.groupBy("series_id").agg(*out)


def sizes(fragments: DataFrame) -> DataFrame:
    """Per series the bits of each part of the compressed form, their sum, the ratio to 64 bits a value, and bits a value."""
    n = F.count("*")
    ef = lambda last: (n * F.greatest(F.lit(1), F.round(F.log2(F.greatest(F.lit(1.0), (last + 1) * 0.6931471805599453 / n)))) + F.floor((last + 1) / F.pow(F.lit(2.0), F.greatest(F.lit(1), F.round(F.log2(F.greatest(F.lit(1.0), (last + 1) * 0.6931471805599453 / n)))))) + n + 1)
    res = F.sum(F.col("len") * F.col("bpc"))
    agg = fragments.groupBy("series_id").agg(
        n.alias("fragments"), F.sum("len").alias("n"), res.alias("residual_bits"),
        (96 * n + 32 * F.count_if(F.col("model") == SQRT) + 32 * F.count_if(F.col("model") == QUADRATIC)).alias("coefficient_bits"),
        (3 * n).alias("type_bits"), ef(F.max("start")).cast("bigint").alias("start_bits"), ef(res).cast("bigint").alias("offset_bits"),
        (n * F.greatest(F.lit(1), bit_length(F.max("bpc").cast("bigint")))).alias("bpc_bits"),
    )
    total = sum((F.col(c) for c in ("coefficient_bits", "type_bits", "start_bits", "offset_bits", "bpc_bits")), F.col("residual_bits"))
    return agg.withColumn("total_bits", total).withColumn("ratio", F.col("total_bits") / (64 * F.col("n"))).withColumn("bits_per_value", F.col("total_bits") / F.col("n"))
