"""Suffix-array dedup (operator 6): column-wise construction of collection BWT and common prefixes over aligned windows.

A string of LENGTH bytes that occurs twice holds, at the same place in both occurrences, the k-gram with the smallest
hash of its k-grams. So occurrences meet under these anchors, and only the WIDTH bytes around an anchor matter. The
windows of an anchor form the collection: starting from the last column, each round inserts one symbol of every window
and updates the order of the suffixes (whose preceding symbols are the BWT) and the common prefix of neighbours, by
sequential passes over both arrays. After a round, neighbours with a common prefix of LENGTH are repeated strings.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, discard, materialise, pieces, sieve, sieved, small_batches, spread, table

LENGTH = 400
GRAM = 100
#: k-grams in a string, that is possible places of an anchor in it; also the columns at which a string may begin.
PLACES = LENGTH - GRAM + 1
WIDTH = LENGTH + PLACES - 1
#: Collections of more windows than this are parted by the core that all strings of a range of places share, down to single places.
LARGE = 200
#: Places a range has at each level of that parting.
LEVELS = (PLACES, 38, 5, 1)
PAD = 0xFF  # no byte of UTF-8
_MULTIPLIER = 0x9E3779B97F4A7C15
_BLOCK = 1 << 19

ANCHORS = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("f", pa.int64()), ("at", pa.list_(pa.int32())), ("m", pa.int64())])
WINDOWS = pa.schema([("h", pa.int64()), ("f", pa.int64()), ("d", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("m", pa.int64()), ("w", pa.binary())])
SPANS = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("spans", pa.list_(pa.int32()))])
RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64))):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def anchors(b: bytes) -> np.ndarray:
    """Places of the k-grams that are the first smallest of some PLACES neighbouring ones; none in texts shorter than LENGTH."""
    n = len(b)
    if n < LENGTH:
        return np.zeros(0, np.int64)
    out = []
    for a in range(0, n - LENGTH + 1, _BLOCK):
        c = np.frombuffer(b, np.uint8, min(_BLOCK + LENGTH - 1, n - a), a)
        up, down = _power(len(c))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up, dtype=np.uint64)))
        g = (sums[GRAM:] - sums[:-GRAM]) * down[: len(c) - GRAM + 1]
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        low = (g & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype=np.uint64)  # the place decides ties
        width = 1
        while 2 * width <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if rest := PLACES - width:
            low = np.minimum(low[:-rest], low[rest:])
        low = low[np.concatenate(([True], low[1:] != low[:-1]))] & np.uint64((1 << 20) - 1)
        out.append(low.astype(np.int64) + a)
    return np.unique(np.concatenate(out))


def repeats(windows: np.ndarray, places: int, where: np.ndarray) -> np.ndarray:
    """For each row and each of the first ``places`` columns: whether the LENGTH bytes from there also stand in a row of another ``where``.

    One round a column, from the last to the first. ``order`` is the rows sorted by what is inserted so far, ``symbols``
    their preceding symbols, ``common`` the common prefix of each with the one before. Every round sorts stably by symbol;
    the common prefix of new neighbours with equal symbols is one more than the smallest of those between them.
    """
    rows, width = windows.shape
    columns = np.ascontiguousarray(windows.T)
    order = np.arange(rows)
    common = np.zeros(rows + 1, np.int32)
    found = np.zeros((places, rows), bool)
    for j in range(width - 1, -1, -1):
        symbols = columns[j][order]
        move = np.argsort(symbols, kind="stable")
        order, symbols = order[move], symbols[move]
        alike = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        new = np.zeros(rows + 1, np.int32)
        if len(alike):
            between = np.empty(2 * len(alike), np.int64)
            between[0::2], between[1::2] = move[alike - 1] + 1, move[alike] + 1
            new[alike] = np.minimum.reduceat(common, between)[0::2] + 1
        common = new
        if j < places:
            begin = np.flatnonzero(common[:-1] < LENGTH)
            if len(begin) < rows:
                at = where[order]
                several = np.minimum.reduceat(at, begin) < np.maximum.reduceat(at, begin)
                found[j, order[np.repeat(several, np.diff(begin, append=rows))]] = True
    return found.T


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _slice(b: bytes, start: int, end: int) -> bytes:
    """Bytes from start to end, padded beyond the text."""
    return b"\xff" * max(0, -start) + b[max(0, start) : end] + b"\xff" * max(0, end - max(start, len(b)))


def _anchor_rows(batches):
    h64 = xxhash.xxh3_64_intdigest
    for piece in pieces(batches):
        rows = [[] for _ in ANCHORS]
        for d, th, b in zip(*(piece[c].to_pylist() for c in ("d", "th", "b")), strict=True):
            b = b or b""
            per: dict = {}
            for p in anchors(b).tolist():
                w = _slice(b, p - PLACES + 1, p + LENGTH)
                per.setdefault((h64(b[p : p + GRAM], 1), h64(w, 2)), []).append(p)
            for (h, f), at in per.items():
                for out, x in zip(rows, (d, th, _signed(h), _signed(f), at, len(at)), strict=True):
                    out.append(x)
        yield batch(ANCHORS, rows)


def _window_rows(batches):
    for piece in pieces(batches):
        rows = [[] for _ in WINDOWS]
        for d, th, b, need in zip(*(piece[c].to_pylist() for c in ("d", "th", "b", "need")), strict=True):
            for x in need:
                row = x["h"], x["f"], d, th, x["p"], len(b), x["m"], _slice(b, x["p"] - PLACES + 1, x["p"] + LENGTH)
                for out, v in zip(rows, row, strict=True):
                    out.append(v)
        yield batch(WINDOWS, rows)


def _parted(level: int):
    """Rows of large collections, each as one row for each range of places: keyed by the core, holding what its strings cover."""
    last, now = LEVELS[level - 1], LEVELS[level]

    def run(batches):
        h64 = xxhash.xxh3_64_intdigest
        for piece in pieces(batches, rows=1024):
            rows = [[] for _ in WINDOWS]
            for h, d, th, p, n, m, w in zip(*(piece[c].to_pylist() for c in ("h", "d", "th", "p", "n", "m", "w")), strict=True):
                # w begins at place p of the text; strings begin at its columns 0 to last - 1
                for a in range(0, last, now):
                    z = min(last, a + now)
                    core = w[z - 1 : a + LENGTH]
                    if PAD in core:
                        continue
                    part = w[a : z - 1 + LENGTH]
                    key = h64(core, (h ^ (a * 0x10001 + level)) & 0xFFFFFFFFFFFFFFFF)
                    for out, v in zip(rows, (_signed(key), _signed(h64(part, 3)), d, th, p + a, n, m, part), strict=True):
                        out.append(v)
            yield batch(WINDOWS, rows)

    return run


def _compare(places: int):
    """Spans of repeated strings, from collections (equal h) that come one after the other."""

    def work(t: pa.Table):
        width = places + LENGTH - 1
        w = np.frombuffer(b"".join(x.ljust(width, b"\xff") for x in t["w"].to_pylist()), np.uint8).reshape(t.num_rows, width)
        place: dict = {}  # parts of one text that begin at the same byte are one occurrence
        where = np.fromiter((place.setdefault(x, len(place)) for x in zip(*(t[c].to_pylist() for c in ("d", "th", "p")), strict=True)), np.int64, t.num_rows)
        found = repeats(w, places, where)
        alone = t["m"].to_numpy() == 1  # the others are repeated as a whole
        p, n = t["p"].to_numpy(), t["n"].to_numpy()
        begin = p[:, None] + np.arange(places)
        length = np.fromiter(map(len, t["w"].to_pylist()), np.int64, t.num_rows)  # that of the last range of places is shorter
        found &= alone[:, None] & (begin >= 0) & (begin + LENGTH <= n[:, None]) & (np.arange(places) + LENGTH <= length[:, None])
        rows = [[], [], []]
        d, th = t["d"].to_pylist(), t["th"].to_pylist()
        for i in np.flatnonzero(found.any(axis=1)).tolist():
            at = begin[i][found[i]]
            cut = np.flatnonzero(np.diff(at) > LENGTH)
            spans = np.stack((at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + LENGTH), axis=1).ravel()
            for out, v in zip(rows, (d[i], th[i], spans.tolist()), strict=True):
                out.append(v)
        if rows[0]:
            yield batch(SPANS, rows)

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 8192:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            h = t["h"].to_numpy()
            cut = int((h == h[-1]).argmax())
            if cut:
                yield from work(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


def _apply(batches):
    for piece in pieces(batches):
        rows = [[] for _ in RESULT]
        for doc, b, spans in zip(*(piece[c].to_pylist() for c in ("doc_id", "b", "spans")), strict=True):
            b = b or b""
            cut = []
            if spans:
                s = np.array(spans, np.int64).reshape(-1, 2).clip(0, len(b))
                s = s[s[:, 1] - s[:, 0] >= LENGTH]
                for a, z in s[np.argsort(s[:, 0], kind="stable")].tolist():
                    if cut and a <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], z)
                    else:
                        cut.append([a, z])
            kept, at = hashlib.sha256(), 0
            for a, z in cut:
                kept.update(b[at:a])
                at = z
            kept.update(b[at:])
            row = doc, len(b), sum(z - a for a, z in cut), len(cut), kept.hexdigest(), [x for c in cut for x in c]
            for out, v in zip(rows, row, strict=True):
                out.append(v)
        yield batch(RESULT, rows)


_WINDOW_SQL = "h long, f long, d long, th long, p int, n int, m long, w binary"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every row; ``spans`` lists begin, end, begin, end, ...

    Every byte covered by a string of LENGTH bytes of UTF-8 that also begins elsewhere, in the same text or another, is
    removed; strings are judged on the input. Null counts as empty; rows that share an id are documents of their own;
    texts shorter than LENGTH lose nothing; very long texts are hashed in blocks; an empty table gives no rows.
    Only anchors that occur twice leave the first stage. Windows that are equal as a whole need no comparison: their
    number says that they repeat. The rest is compared in collections of at most LARGE windows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("b"))
    rows = materialise(src.select("d", "th", "b").mapInArrow(_anchor_rows, "d long, th long, h long, f long, at array<int>, m long"), "anchors")
    twice = rows.groupBy("h").agg(F.sum("m").alias("c")).filter("c > 1").select("h")
    every, rows = rows, materialise(rows.join(spread(twice), "h", "left_semi"), "shared")
    discard(every)
    same = materialise(rows.groupBy("h", "f").agg(F.sum("m").alias("m"), F.min(F.struct("d", "th", F.col("at")[0].alias("p"))).alias("rep")), "windows")
    whole = same.filter("m > 1").select("h", "f")
    found = [rows.join(spread(whole), ["h", "f"], "left_semi").select("d", "th", F.flatten(F.transform("at", lambda p: F.array(p - (PLACES - 1), p + LENGTH))).alias("spans"))]

    size = same.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1")
    need = same.join(spread(size), "h").select("rep.d", "rep.th", F.struct("h", "f", "rep.p", "m").alias("x"))
    need = materialise(need.groupBy("d", "th").agg(F.collect_list("x").alias("need")), "need")
    texts = sieve(src.select(F.col("d").alias("d0"), F.col("th").alias("th0"), "b"), need.select("d").distinct(), "d0").join(spread(need), (F.col("d0") == F.col("d")) & (F.col("th0") == F.col("th")))
    windows = texts.select("d", "th", "b", "need").mapInArrow(_window_rows, _WINDOW_SQL).dropDuplicates(["h", "f"])
    windows = materialise(windows.withColumn("p", F.col("p") - (PLACES - 1)), "collections")
    discard(need)
    written = [rows, same]
    for level, places in enumerate(LEVELS):
        size = windows.groupBy("h").agg(F.count("*").alias("c"))
        part = windows.join(spread(size.filter(f"c > 1 AND c <= {LARGE}").select("h")), "h", "left_semi")
        # by a hash of h: an exchange by h itself would be dropped for that of the join, which adaptive execution may then undo
        part = part.repartition(n, F.xxhash64("h")).sortWithinPartitions("h").mapInArrow(_compare(places), "d long, th long, spans array<int>")
        found.append(materialise(part, f"spans{level}"))
        large = size.filter(f"c > {LARGE}").select("h")
        if level + 1 == len(LEVELS) or large.isEmpty():
            break
        each = windows.join(spread(large), "h", "left_semi").mapInArrow(_parted(level + 1), _WINDOW_SQL)
        each = materialise(each, "parts")
        discard(windows)
        same = each.groupBy("h", "f").agg(F.sum("m").alias("c"))
        whole = spread(same.filter("c > 1").select("h", "f"))
        found.append(materialise(each.filter("m = 1").join(whole, ["h", "f"], "left_semi").select("d", "th", F.array("p", F.col("p") + F.octet_length("w")).alias("spans")), "parted"))
        first = each.groupBy("h", "f").agg(F.min(F.struct("d", "th", "p")).alias("rep"), F.sum("m").alias("c"))
        windows = each.drop("m").join(spread(first), ["h", "f"]).filter("rep.d = d AND rep.th = th AND rep.p = p").withColumn("m", F.col("c")).drop("rep", "c")
        windows = materialise(windows.select("h", "f", "d", "th", "p", "n", "m", "w"), "collections")
        discard(each)
    spans = found[0]
    for x in found[1:]:
        spans = spans.unionByName(x)
    spans = spans.groupBy("d", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = materialise(spans, "all_spans").select(F.col("d").alias("d0"), F.col("th").alias("th0"), "spans")
    discard(windows, *written, *found[1:])
    src = sieved(src, spans.select("d0").distinct(), "d", "hit")  # texts that surely lose nothing aren't shuffled
    out = src.filter("hit").join(spans, (F.col("d") == F.col("d0")) & (F.col("th") == F.col("th0")), "left").select("doc_id", "b", "spans")
    out = out.unionByName(src.filter("NOT hit").select("doc_id", "b", F.lit(None).cast("array<int>").alias("spans")))
    return out.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<int>")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")
