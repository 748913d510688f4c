"""Python functions over small groups of rows, without the cost that grouped maps have for each group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "tinyint": pa.int8(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
#: Rows that are looked at together, and rows of one batch of the result.
TOGETHER, OUT = 1 << 16, 4096


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (c.split() for c in schema.split(", "))])


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], run: Callable[[tuple, dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """Rows ``run(key, columns)`` of every group, whose columns come as arrays sorted by ``order``.

    One exchange by key with as many partitions as the session has, which adaptive execution doesn't merge: fits take
    time, not space. Groups follow one another in a partition, so many of them are cut from one Arrow table. A group has
    to fit a task.
    """
    names, kind = df.columns, arrow_schema(schema)
    rest = [c for c in names if c not in keys]

    def work(t: pa.Table):
        held = [t[k].to_numpy() for k in keys]
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in held:
            change[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(change).tolist()
        columns = {c: t[c].to_numpy() for c in rest}
        rows: list[tuple] = []
        for s, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            rows += run(tuple(k[s] for k in held), {c: a[s:e] for c, a in columns.items()})
            if len(rows) >= OUT:
                yield pack_rows(rows)
                rows = []
        if rows:
            yield pack_rows(rows)

    def pack_rows(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    def handle(batches):
        held, n = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            last = np.ones(n, bool)
            for k in keys:
                a = t[k].to_numpy()
                last &= a == a[-1]
            cut = int(last.argmax())  # the last group may go on
            if cut:
                yield from work(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), n - cut
        if held:
            yield from work(pa.Table.from_batches(held))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInArrow(handle, schema)
