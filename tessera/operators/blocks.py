"""Fixed-size blocks of a series, compressed each on its own by a codec."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.codecs import CODECS, POINT
from tessera.functions.groups import map_groups
from tessera.schema import BLOCKS

BLOCK = 1000


def encode_blocks(points: DataFrame, codec: str, block: int = BLOCK) -> DataFrame:
    """``points`` (``y`` bigint or double) to one row a block; values are coded by their 64 bits."""

    def run(key, columns):
        y = columns["y"]
        data, bits = CODECS[codec][0](np.ascontiguousarray(y).view(np.uint64).tolist())
        return [(key[0], int(key[1]), len(y), codec, data, bits)]

    p = points.select("series_id", F.floor(F.col("pos") / block).alias("block_id"), "pos", "y")
    return map_groups(p, ["series_id", "block_id"], ["pos"], run, BLOCKS)


def _rows(series: list, pos: list, y: list, kind: str) -> pa.RecordBatch:
    y = np.concatenate(y) if y else np.zeros(0, np.uint64)
    y = pa.array(y.view(np.float64 if kind == "double" else np.int64))
    return pa.RecordBatch.from_arrays([pa.array(series, pa.string()), pa.array(np.concatenate(pos) if pos else [], pa.int64()), y], names=["series_id", "pos", "y"])


def decode_blocks(blocks: DataFrame, block: int = BLOCK, kind: str = "bigint") -> DataFrame:
    """``series_id, pos, y`` of every point."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                series, pos, y = [], [], []
                for sid, k, n, codec, data in zip(*(b[c].slice(at, 64).to_pylist() for c in ("series_id", "block_id", "n", "codec", "payload")), strict=True):
                    series += [sid] * n
                    pos.append(k * block + np.arange(n))
                    y.append(np.array(CODECS[codec][1](data, n), np.uint64))
                yield _rows(series, pos, y, kind)

    return blocks.mapInArrow(run, f"series_id string, pos bigint, y {kind}")


def at_blocks(blocks: DataFrame, probes: DataFrame, block: int = BLOCK, kind: str = "bigint") -> DataFrame:
    """Points ``series_id, pos`` of ``probes``: only the blocks that hold one are opened, each once. Codecs in ``POINT`` read
    the probed places alone, the others decode the block."""
    p = probes.select("series_id", "pos").distinct().withColumn("block_id", F.floor(F.col("pos") / block))
    p = p.groupBy("series_id", "block_id").agg(F.sort_array(F.collect_list((F.col("pos") - F.col("block_id") * block).cast("bigint"))).alias("places"))  # a block has few places

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                series, pos, y = [], [], []
                for sid, k, n, codec, data, places in zip(*(b[c].slice(at, 64).to_pylist() for c in ("series_id", "block_id", "n", "codec", "payload", "places")), strict=True):
                    places = np.array([i for i in places if i < n], np.int64)
                    series += [sid] * len(places)
                    pos.append(k * block + places)
                    y.append(np.array([POINT[codec](data, n, i) for i in places.tolist()], np.uint64) if codec in POINT else np.array(CODECS[codec][1](data, n), np.uint64)[places])
                yield _rows(series, pos, y, kind)

    need = blocks.join(p, ["series_id", "block_id"]).select("series_id", "block_id", "n", "codec", "payload", "places")
    return need.mapInArrow(run, f"series_id string, pos bigint, y {kind}")


def scan_blocks(blocks: DataFrame, first: int, end: int, block: int = BLOCK, kind: str = "bigint") -> DataFrame:
    need = blocks.filter(F.col("block_id").between(first // block, max(first, end - 1) // block))
    return decode_blocks(need, block, kind).filter((F.col("pos") >= first) & (F.col("pos") < end))


def block_sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("series_id", "codec").agg(F.sum("n").alias("n"), F.sum("size_bits").alias("bits"), (F.sum("size_bits") / F.sum("n")).alias("bits_per_value"), (F.sum("size_bits") / (64 * F.sum("n"))).alias("ratio"))
