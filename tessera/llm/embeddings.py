"""Embedding near-dedup (operator 10): random-hyperplane sign hashing, exact cosine, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, connected_components, materialise, pieces, small_batches, spread, table

SIMILARITY = 0.9
#: Share of the pairs at just that similarity which some table is to bring together; more similar pairs do better.
RECALL = 0.985
#: Vectors a bucket should hold on average, and at most in one block; buckets beyond are compared block by block.
BUCKET, BLOCK = 256, 512
SEED = 20

OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def plan(vectors: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits a table and number of tables: bits grow with the number of vectors, tables so that the recall holds."""
    bits = min(30, max(8, math.ceil(math.log2(max(1, vectors) / BUCKET))))
    same = (1 - math.acos(min(1.0, max(-1.0, similarity))) / math.pi) ** bits
    return bits, 1 if same >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _codes(v: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Sign bits of every table as one number: (vectors, tables). Planes depend on seed and dimension alone."""
    planes = np.random.default_rng([seed, v.shape[1]]).standard_normal((v.shape[1], bits * tables))
    on = (v @ planes > 0).reshape(len(v), tables, bits)
    return on @ (1 << np.arange(bits, dtype=np.int64))


def _by_dimension(values: list):
    dims = np.fromiter(map(len, values), np.int64, len(values))
    for d in np.unique(dims).tolist():
        yield d, np.flatnonzero(dims == d)


def usable(c):
    """Neither null nor zero, and all components finite numbers."""
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)


def _compare(ids, mult, v, codes, t, i, j, side, similarity):
    """Links within one block, or between two, of table ``t`` that no earlier table brings together."""
    left, right = (side, side) if i == j else (side == i, side == j)
    x, y = np.flatnonzero(left), np.flatnonzero(right)
    if i == j:
        x = y = np.arange(len(ids))
    near = v[x] @ v[y].T >= similarity
    if i == j:
        near = np.triu(near, 1)
    p, q = np.nonzero(near)
    p, q = x[p], y[q]
    new = np.ones(len(p), bool)
    for at in range(0, len(p), 1 << 16):
        s = slice(at, at + (1 << 16))
        new[s] = (codes[p[s]] == codes[q[s]]).argmax(axis=1) == t
    p, q = p[new], q[new]
    if not len(p):
        return [], []
    counts = np.zeros(len(ids), np.int64)
    np.add.at(counts, p, mult[q])
    np.add.at(counts, q, mult[p])
    joined = np.zeros((len(ids), len(ids)), bool)
    joined[p, q] = joined[q, p] = True
    edges, open_ = [], np.zeros(len(ids), bool)
    open_[p] = open_[q] = True
    while open_.any():
        tree = np.zeros(len(ids), bool)
        front = np.flatnonzero(open_)[:1]
        while len(front):
            tree[front] = True
            front = np.flatnonzero(joined[front].any(axis=0) & ~tree)
        open_ &= ~tree
        members = ids[tree]
        low = int(members.min())
        edges += [(int(m), low) for m in members if m != low]
    return edges, [(int(ids[k]), int(counts[k])) for k in np.flatnonzero(counts)]


def links(vectors: DataFrame, bits: int, tables: int, similarity: float, seed: int = SEED) -> DataFrame:
    """``a, b, n`` for distinct vectors (``rep, mult, embedding``): edges ``a, b`` of spanning forests, and rows with null
    ``b`` that add ``n`` links to ``a``. Each link counts in the first table that brings its ends together."""
    spark = vectors.sparkSession
    small_batches(spark)

    def sign(batches):
        for b in pieces(batches, rows=4096):
            values = b["embedding"].to_pylist()
            codes = np.zeros((len(values), tables), np.int64)
            for d, at in _by_dimension(values):
                codes[at] = _codes(_unit([values[k] for k in at]), bits, tables, seed) ^ ((d & 0xFFF) << 44)
            keys = codes | (np.arange(tables, dtype=np.int64) << 32)
            yield pa.RecordBatch.from_arrays([b["rep"], pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "keys"])

    signed = materialise(vectors.mapInArrow(sign, "rep long, keys array<long>"), "signs")
    each = signed.select(F.col("rep").alias("r"), F.explode("keys").alias("key"))
    counts = materialise(each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("key").alias("k"), F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "buckets")
    met = each.join(counts, F.col("key") == F.col("k"))
    own = F.pmod(F.xxhash64("r"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("r", "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = met.join(vectors, F.col("r") == F.col("rep")).select("rep", "mult", "embedding", "key", "own", "i", "j")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches):
        def work(t: pa.Table):
            key, i, j, own, ids, mult = (t[c].to_numpy() for c in ("key", "i", "j", "own", "rep", "mult"))
            values = t["embedding"].to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            edges, counts = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if e - s < 2:
                    continue
                for _, at in _by_dimension(values[s:e]):
                    at = at + s
                    v = _unit([values[k] for k in at])
                    x, y = _compare(ids[at], mult[at], v, _codes(v, bits, tables, seed), (int(key[s]) >> 32) & 0xFFF, int(i[s]), int(j[s]), own[at], similarity)
                    edges += x
                    counts += y
            if edges or counts:
                yield batch(OUT, [[x[0] for x in edges] + [x[0] for x in counts], [x[1] for x in edges] + [None] * len(counts), [0] * len(edges) + [x[1] for x in counts]])

        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 8192:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t[c][-1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([t[c].to_numpy() == x for c, x in zip(("key", "i", "j"), last, strict=True)])
            cut = int(same.argmax())  # a block pair has about 2 * BLOCK rows and may go on
            if cut:
                yield from work(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(compare, "a long, b long, n long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Equal vectors are compared once and count with their number. Vectors that are null, zero, or hold null or non-finite
    components link with nothing, and so do rows without id; vectors of different dimension don't link. Every link
    reported has a cosine of ``similarity`` or more in double precision; of the links at just that cosine a share of
    ``recall`` is expected to be found. Rows that share an id are members each, of the class of their own vector. No rows give no rows.
    """
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("embedding"))
    good = usable(F.col("embedding")) & F.col("id").isNotNull()
    v = v.withColumn("k1", F.when(good, F.xxhash64("embedding"))).withColumn("k2", F.when(good, F.xxhash64(F.lit(1), "embedding")))
    rows = v.select("id", "k1", "k2")
    reps = rows.filter("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("low"), F.count("*").alias("mult"))
    reps = materialise(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # ids may repeat, so classes get their own
    first = v.join(reps.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), "low", "rep", "mult"), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("id") == F.col("low")))
    distinct = materialise(first.select("rep", "mult", "embedding").dropDuplicates(["rep"]), "vectors")
    bits, tables = plan(distinct.count(), similarity, recall)
    found = materialise(links(distinct, bits, tables, similarity), "links")
    comp = materialise(connected_components(found.filter("b IS NOT NULL")).join(reps.select("rep", "low"), F.col("node") == F.col("rep")).select("node", "component", "low"), "members")
    least = comp.groupBy(F.col("component").alias("whole")).agg(F.min("low").alias("component_id"))
    comp = comp.drop("low").join(spread(least), F.col("component") == F.col("whole")).select("node", "component_id")
    counts = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    reps = reps.join(spread(comp), F.col("rep") == F.col("node"), "left").join(spread(counts), F.col("rep") == F.col("a"), "left")
    reps = materialise(reps.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")), "classes")
    out = rows.join(reps, (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")), "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.col("id").eqNullSafe(comp_id).alias("kept"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
