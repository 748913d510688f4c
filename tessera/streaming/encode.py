"""Online encoding of streams of points: blocks of a codec, and fragments that grow value by value."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.codecs import CODECS
from tessera.functions.fit import Online
from tessera.schema import BLOCKS, LINEAR

#: Values of an open fragment, at most; so a series' state is bounded.
MOST = 8192
FITTED = "series_id string, start bigint, len int, model tinyint, bpc tinyint, s bigint, t0 double, t1 double, t2 double"


def encode_stream(points: DataFrame, codec: str = "gorilla", block: int = 1000, idle_ms: int = 1000) -> DataFrame:
    """A stream ``series_id, pos, y`` (double or bigint) to blocks, each as soon as it is full; a series that stays idle gives
    up the rest as a short block. State is the 64-bit patterns of at most one open block a series."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    kind = np.float64 if dict(points.dtypes)["y"] == "double" else np.int64

    def run(key, frames, state):
        held, at = state.get if state.exists else ([], 0)
        held = list(held)
        for pdf in frames:
            held += pdf.sort_values("pos")["y"].to_numpy(kind).view(np.int64).tolist()
        out = []
        while len(held) >= block or (state.hasTimedOut and held):
            part, held = held[:block], held[block:]
            data, bits = CODECS[codec][0](np.array(part, np.int64).view(np.uint64).tolist())
            out.append((key[0], at, len(part), codec, data, bits))
            at += 1
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((held, at))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return points.groupBy("series_id").applyInPandasWithState(run, BLOCKS, "held array<bigint>, at bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fit_stream(points: DataFrame, model: int = LINEAR, bpc: int = 8, idle_ms: int = 1000) -> DataFrame:
    """A stream ``series_id, pos, y`` (bigint) to fragments of one family, each as soon as a value doesn't fit it any more.

    Values are taken in the order of ``pos`` within a micro-batch. A fragment is corrected by residuals of ``bpc`` bits;
    it ends after MOST values at the latest, and when its series stays idle. State is the values of the open fragment,
    which a micro-batch adds again first. Values on which the family can't start become lines.
    """
    names = [c.split()[0] for c in FITTED.split(", ")]

    def run(key, frames, state):
        held, start = state.get if state.exists else ([], 0)
        values = list(held)
        for pdf in frames:
            values += pdf.sort_values("pos")["y"].astype("int64").tolist()
        out, at, n = [], 0, len(values)
        while at < n:
            family, fit, end = model, Online(model, bpc), at
            if not fit.add(values[at]):
                family, fit = LINEAR, Online(LINEAR, bpc)
                fit.add(values[at])
            end = at + 1
            while end < n and end - at < MOST and fit.add(values[end]):
                end += 1
            if end == n and end - at < MOST and not state.hasTimedOut:
                break  # still open
            out.append((key[0], start, end - at, family, bpc, *fit.coefficients()))
            start += end - at
            at = end
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((values[at:], start))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names)

    return points.groupBy("series_id").applyInPandasWithState(run, FITTED, "held array<bigint>, start bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
