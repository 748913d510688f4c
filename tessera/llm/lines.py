"""Line dedup (operator 5): align overlapping documents by patience diff and delete common blocks from the later one."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, materialise, pieces, small_batches, spread, table

#: Lines that so few documents have are rare. Partners no longer depend on it.
RARE = 40
#: An aligned block is deleted if its lines have so many characters together.
MIN_CHARS = 40
#: A further round aligns with so many times the holders of the round before.
MORE = 16


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by rising first part, whose second parts rise as well (patience sorting)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        if p == len(tops):
            tops.append(y)
            at.append(k)
        else:
            tops[p], at[p] = y, k
        back[k] = at[p - 1] if p else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of two sequences: common ends, then lines that are unique in both, and so on between these."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        there: dict = {}
        for j in range(b0, b1):
            there[b[j]] = -1 if b[j] in there else j
        found = _increasing([(i, there[x]) for x, i in once.items() if i >= 0 and there.get(x, -1) >= 0])
        if not found:
            continue
        i0, j0 = a0, b0
        for i, j in found:
            todo.append((i0, i, j0, j))
            out.append((i, j))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    return sorted(out)


def common_lines(later: list, earlier: list, chars: list, min_chars: int = MIN_CHARS) -> list[int]:
    """Line numbers of ``later`` in aligned blocks (consecutive in both) whose lines have ``min_chars`` characters or more."""
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(later, earlier), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(chars[k] for k in block) >= min_chars:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def runs(hashes: list, chars: list, min_chars: int = MIN_CHARS) -> list[tuple[int, int, int, int]]:
    """``(key, start, end, k)`` of the shortest runs of ``min_chars`` characters from each line on and up to each line.

    ``k`` counts the runs with the same lines. Each aligned block of so many characters is covered by the runs in it,
    and all of them are in both documents.
    """
    n = len(hashes)
    spans: dict[tuple[int, int], None] = {}
    j = total = 0
    for i in range(n):
        while j < n and total < min_chars:
            total += chars[j]
            j += 1
        if total < min_chars:
            break
        spans[i, j] = None
        total -= chars[i]
    i, total = n, 0
    for j in range(n, 0, -1):
        while i > 0 and total < min_chars:
            i -= 1
            total += chars[i]
        if total < min_chars:
            break
        spans[i, j] = None
        total -= chars[j - 1]
    prefix, power = [0], [1]
    for h in hashes if spans else ():
        prefix.append((prefix[-1] * BASE + h) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    count: dict[int, int] = {}
    out = []
    for i, j in spans:
        key = (prefix[j] - prefix[i] * power[j - i]) % PRIME
        k = count[key] = count.get(key, -1) + 1
        out.append((key, i, j, k))
    return out


# Hash of a run, as a polynomial of its line hashes.
PRIME, BASE = (1 << 61) - 1, 1_173_928_571_046_893_713
RUNS = pa.schema([("sid", pa.int64()), ("id", pa.int64()), ("w", pa.int64()), ("a", pa.int32()), ("z", pa.int32()), ("k", pa.int32())])
REMOVED = pa.schema([("sid", pa.int64()), ("removed", pa.list_(pa.int32()))])


def _aligned(pairs: DataFrame, texts: DataFrame, min_chars: int) -> DataFrame:
    """``sid, removed`` of each pair ``sid, other`` by which lines of ``sid`` go."""

    def align(batches):
        for b in pieces(batches, rows=1024):
            got = [[], []]
            for sid, mine, chars, earlier in zip(*(b[c].to_pylist() for c in ("sid", "hashes", "chars", "earlier")), strict=True):
                if gone := common_lines(mine, earlier, chars, min_chars):
                    for out, x in zip(got, (sid, gone), strict=True):
                        out.append(x)
            yield batch(REMOVED, got)

    needed = pairs.select("other").distinct()
    other = texts.select(F.col("sid").alias("other"), F.col("hashes").alias("earlier")).join(spread(needed), "other", "left_semi")
    full = texts.join(pairs.join(spread(other), "other").drop("other"), "sid")
    return materialise(full.select("sid", "hashes", "chars", "earlier").mapInArrow(align, "sid long, removed array<int>"), "aligned")


def duplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, th, removed`` for documents of which lines go: ``removed`` lists line numbers, ``th`` is the text's hash.

    Lines (parted by newline, compared without outer white space by 64-bit hash) go if they are in an aligned block with
    any document of smaller id. Of documents with the same lines only that of smallest id is aligned, since the others
    lose all lines to it. Documents that share a block of ``min_chars`` characters share a run (see ``runs``). The first
    round aligns with the first holder of each shared run; a run that still has lines left is open, and further rounds
    align with more and more of its holders of smaller id, until no run is open or all of them have been tried. So the
    result is that of all pairs, while a run that all its holders align takes few. Only arrays of line hashes travel.
    """
    small_batches(docs.sparkSession)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    clean = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    d = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), clean.alias("c"))
    d = d.select("doc_id", "th", F.transform("c", lambda x: F.when(x == "", F.lit(0)).otherwise(F.xxhash64(x))).alias("hashes"), F.transform("c", lambda x: F.length(x)).alias("chars"))
    seqs = materialise(d.withColumn("sid", F.xxhash64("hashes")), "lines")
    texts = materialise(seqs.groupBy("sid").agg(F.min("doc_id").alias("id"), F.first("hashes").alias("hashes"), F.first("chars").alias("chars")), "texts")

    def cut(batches):
        for b in pieces(batches):
            got = [[] for _ in RUNS]
            for sid, doc, mine, chars in zip(*(b[c].to_pylist() for c in ("sid", "id", "hashes", "chars")), strict=True):
                for run in runs(mine, chars, min_chars):
                    for out, x in zip(got, (sid, doc, *run), strict=True):
                        out.append(x)
            yield batch(RUNS, got)

    held = materialise(texts.mapInArrow(cut, "sid long, id long, w long, a int, z int, k int"), "runs")
    holders = held.filter("k = 0").select("w", F.col("sid").alias("other"), F.col("id").alias("other_id"))
    stats = holders.groupBy("w").agg(F.count("*").alias("df"), F.min(F.struct("other_id", "other")).alias("first")).filter("df > 1")
    shared = held.join(spread(stats), "w").filter("id > first.other_id")
    left = materialise(shared.select("sid", "id", "w", "a", "z", "df", F.col("first.other").alias("other")), "shared")
    pairs = materialise(left.select("sid", "other").distinct(), "pairs")
    removed, tried = _aligned(pairs, texts, min_chars), 1
    while True:
        gone = removed.select("sid", F.explode("removed").alias("line")).groupBy("sid").agg(F.collect_set("line").alias("gone"))
        kept = F.size(F.array_except(F.sequence("a", F.col("z") - 1), "gone")) > 0
        left = left.select("sid", "id", "w", "a", "z", "df").join(spread(gone), "sid", "left").filter(F.col("gone").isNull() | kept).drop("gone")
        left = materialise(left, "open")
        most = left.agg(F.max("df")).first()[0]
        if most is None or most <= tried:
            break
        # of each open run the holders whose hash falls into the next share
        part = F.pmod(F.xxhash64("other"), F.lit(1 << 20)) * F.col("df")
        last, tried = tried if tried > 1 else 0, tried * MORE
        some = holders.join(spread(left.select("w", "df").distinct()), "w").filter((part >= last << 20) & (part < tried << 20))
        some = materialise(some.drop("df"), "some")
        pairs = left.select("sid", "id", "w").join(spread(some), "w").filter("other_id < id")
        pairs = materialise(pairs.select("sid", "other").distinct(), "pairs")
        removed = removed.unionByName(_aligned(pairs, texts, min_chars))
    rows = seqs.select("doc_id", "th", "sid", F.size("hashes").alias("n"), F.aggregate("chars", F.lit(0), lambda s, x: s + x).alias("total"))
    rows = rows.join(spread(texts.select("sid", "id")), "sid").filter("total >= " + str(int(min_chars)))
    copies = rows.filter("doc_id > id").select("doc_id", "th", F.sequence(F.lit(0), F.col("n") - 1).alias("removed"))
    gone = gone.select("sid", F.array_sort("gone").alias("removed"))
    firsts = rows.filter("doc_id = id").join(spread(gone), "sid").select("doc_id", "th", "removed")
    return copies.unionByName(firsts).groupBy("doc_id", "th").agg(F.first("removed").alias("removed"))


def _without(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers, in one pass over its lines."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    held = F.transform(F.array(F.struct(lines.alias("lines"), kept.alias("kept"))), lambda s: F.transform(s["kept"], lambda i: s["lines"][i]))
    return F.array_join(held[0], "\n")


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, removed: str | None = None) -> DataFrame:
    """``docs`` with the duplicate lines cut from ``text``; other columns stay as they are.

    With ``removed`` a column of that name lists the line numbers that went (null: none). Null texts stay null, rows
    without id are left alone, rows that share an id are neither earlier nor later than each other. A text all of whose
    lines go becomes empty. An empty table gives an empty table.
    """
    gone = materialise(duplicate_lines(docs.select("doc_id", "text"), min_chars), "removed")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("removed").alias("__removed"))
    j = docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left")
    j = j.withColumn("text", F.when(F.col("__removed").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("__removed"))))
    return j.select(*docs.columns, *([F.col("__removed").alias(removed)] if removed else []))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup(d.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")), removed="gone")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
