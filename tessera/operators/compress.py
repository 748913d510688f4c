"""Compression: points to fragments, by grouped fits and native residuals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import pack_column
from tessera.functions.groups import map_groups
from tessera.functions.models import eps, evaluate_row, offset, width
from tessera.plans.partition import LINEAR_BITS, LOSSLESS_BITS, LOSSY_BITS, adaptive, grid, partition, single, trained_extra
from tessera.schema import LINEAR, RAW_FRAGMENTS
from tessera.sources.fragments import materialise
from tessera.sources.series import normalise

CHUNK = 8192
STORED = ("series_id", "chunk_id", "frag_id", "start", "len", "model", "bpc", "s", "t0", "t1", "t2", "shift", "residuals")


def fragments_of(points: DataFrame, fit, chunk: int = CHUNK, first_id: int = 0) -> DataFrame:
    """Fit each chunk of each series (``series_id, pos, y, shift``) by ``fit(y)`` to rows as of ``RAW_FRAGMENTS``; a group is a chunk, so groups are bounded.

    Fragments of a chunk are numbered from ``first_id`` on.
    """

    def run(key, columns):
        y, base, shift = columns["y"], int(columns["pos"][0]), int(columns["shift"][0])
        return [(key[0], int(key[1]), first_id + k, base + f[0], f[1] - f[0], f[2], f[3], int(f[4]), float(f[5]), float(f[6]), float(f[7]), shift, y[f[0] : f[1]]) for k, f in enumerate(fit(y))]

    p = points.withColumn("chunk_id", F.floor(F.col("pos") / chunk))
    return map_groups(p.select("series_id", "chunk_id", "pos", "y", "shift"), ["series_id", "chunk_id"], ["pos"], run, RAW_FRAGMENTS)


def with_residuals(raw: DataFrame) -> DataFrame:
    """Residuals by the decoder's own expression, in as many bits as they need: nothing is ever lost."""
    err = F.transform("ys", lambda y, j: y - evaluate_row(j))
    f = raw.withColumn("err", err).withColumn("bpc", width(F.array_min("err"), F.array_max("err")))
    return f.withColumn("residuals", pack_column(F.transform("err", lambda e: e + offset(F.col("bpc"))), F.col("bpc"))).select(*STORED)


def compress(points: DataFrame, max_bpc: int = 12, models: Sequence[tuple[int, int]] | None = None, chunk: int = CHUNK, step: int = 1) -> DataFrame:
    """Lossless fragments with all four families."""
    models = models or grid(max_bpc, step=step)
    p = normalise(points, eps(max_bpc))
    return with_residuals(fragments_of(p, lambda y: partition(y, models, LOSSLESS_BITS), chunk))


def compress_linear(points: DataFrame, max_bpc: int = 12, chunk: int = CHUNK, step: int = 1) -> DataFrame:
    """Lossless fragments of lines only; values need no shift."""
    models = grid(max_bpc, (LINEAR,), step)
    return with_residuals(fragments_of(points.withColumn("shift", F.lit(0).cast("bigint")), lambda y: partition(y, models, LINEAR_BITS), chunk))


def best_models(fragments: DataFrame, m: int = 5) -> DataFrame:
    """The ``m`` models that cover most points."""
    return fragments.groupBy("model", F.col("plan_bpc").alias("bpc")).agg(F.sum("len").alias("covered")).orderBy(F.desc("covered"), "model", "bpc").limit(m)


def compress_trained(points: DataFrame, max_bpc: int = 12, training: int = 512, m: int = 5, chunk: int = CHUNK) -> DataFrame:
    """Fit the first ``training`` values of each series with all models, then the rest with the ``m`` that covered most.

    A fragment costs log2 of the number of values fitted together besides. The head is fitted once and kept in a table;
    fragments of the tail are numbered from ``training`` on, above all of the head.
    """
    p = normalise(points, eps(max_bpc))
    models = grid(max_bpc)
    head = materialise(fragments_of(p.filter(F.col("pos") < training), lambda y: partition(y, models, LOSSLESS_BITS, extra=trained_extra(len(y))), chunk), "head")
    chosen = [(r["model"], r["bpc"]) for r in best_models(head, m).collect()]  # m rows
    if (LINEAR, max_bpc) not in chosen:
        chosen.append((LINEAR, max_bpc))
    tail = fragments_of(p.filter(F.col("pos") >= training), lambda y: partition(y, chosen, LOSSLESS_BITS, extra=trained_extra(len(y))), chunk, training)
    return with_residuals(head.unionByName(tail))


def compress_lossy(points: DataFrame, error: int, method: str = "all", chunk: int = CHUNK) -> DataFrame:
    """Fragments without residuals whose errors lie from -(error + 1) to error: ``all`` families by cost, ``pla`` lines
    only, ``aa`` adaptive approximation."""
    models = [(f, 0) for f in LOSSY_BITS]
    fit = {"all": lambda y: partition(y, models, LOSSY_BITS, float(error)), "pla": lambda y: single(np.asarray(y, float), LINEAR, float(error)), "aa": lambda y: adaptive(np.asarray(y, float), float(error))}[method]
    raw = fragments_of(normalise(points, error), fit, chunk)
    return raw.withColumn("bpc", F.lit(0).cast("tinyint")).withColumn("residuals", F.lit(None).cast("binary")).select(*STORED)
