"""SimHash near-dedup (operator 3) with pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, connected_components, materialise, pieces, sieve, small_batches, spread, table

SHINGLE = 3
SEED = 42
#: Fingerprints link at this many differing bits or fewer.
REACH = 2
#: Segments of the ring, of eight bits each. A chain of k of them may differ in at most k * REACH / SEGMENTS bits.
SEGMENTS = 8

SIGNS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; the whole sequence if it is shorter, none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    h = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is set if more than half of the hashes have it; 0 without hashes."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in pieces(batches):
            fp = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
            yield batch(SIGNS, [b["doc_id"], fp])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _rotated(fp, k: int):
    return fp if not k else F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k))


def _keys(fp):
    """Bucket keys of a fingerprint, two for each start of a chain.

    Two bits or fewer that differ leave a start from which the first three segments are equal and the next four hold
    one difference at most; so of those four, the first two or the last two are equal as well. 40 equal bits each.
    """
    out = []
    for start in range(SEGMENTS):
        r = _rotated(fp, 8 * start)
        head = F.shiftrightunsigned(r, 40)
        for half, cut in enumerate((24, 8)):
            tail = F.shiftrightunsigned(r, cut).bitwiseAND(F.lit(0xFFFF))
            out.append(F.shiftleft(head, 16).bitwiseOR(tail).bitwiseOR(F.lit((2 * start + half) << 40)))
    return F.array(*out)


def _chain_ok(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the cumulative differences of the chain from each segment ``start`` stay within their budgets, then in all."""
    k = (8 * start).astype(np.uint64)
    r = (x << k) | np.where(k > 0, x >> ((np.uint64(64) - k) % np.uint64(64)), np.uint64(0))
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        ok &= np.bitwise_count(r >> np.uint64(64 - 8 * length)) <= length * REACH // SEGMENTS
    return ok


#: Runs of more fingerprints than this are linked by probing the neighbours of each, shorter ones by comparing pairs.
PAIRWISE = 48


def _forest(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest (each node to the smallest id of its tree) of pairs of positions."""
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            lo, hi = (rx, ry) if ids[rx] <= ids[ry] else (ry, rx)
            up[hi] = lo
            up.setdefault(lo, lo)
    return [(int(ids[x]), int(ids[root(x)])) for x in list(up) if root(x) != x]


def _link_run(fps: np.ndarray, ids: np.ndarray, table_no: int) -> list[tuple[int, int]]:
    """A forest over one large bucket: every fingerprint looks up the 300 values that differ in up to two of its 24 free bits."""
    start, half = divmod(table_no, 2)
    low = (8, 8) if half == 0 else (24, 8)
    free = list(range(0, low[1])) + (list(range(8, 24)) if half == 0 else list(range(24, 40)))
    turn = lambda b: np.uint64(1) << np.uint64((b - 8 * start) % 64)  # noqa: E731  back from the rotated position
    masks = [turn(b) for b in free]
    flips = masks + [p | q for i, p in enumerate(masks) for q in masks[i + 1 :]]
    order = np.argsort(fps)
    known = fps[order]
    left, right = [], []
    for m in flips:
        at = np.searchsorted(known, fps ^ m)
        at[at == len(known)] = 0
        hit = np.flatnonzero((known[at] == (fps ^ m)) & (fps < (fps ^ m)))
        left.append(hit)
        right.append(order[at[hit]])
    return _forest(np.concatenate(left), np.concatenate(right), ids)


def _link(batches):
    """Links within runs of equal keys; the rows come sorted by key. A run has at most 2**24 fingerprints."""
    held: list[pa.RecordBatch] = []

    def work(t: pa.Table):
        key, fp, rep = (t[c].to_numpy() for c in ("key", "fp", "rep"))
        fp = fp.view(np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        pairs: list[tuple[int, int]] = []
        big = sizes > PAIRWISE
        for s, n in zip(starts[big].tolist(), sizes[big].tolist(), strict=True):
            pairs += _link_run(fp[s : s + n], rep[s : s + n], int(key[s]) >> 40)
        run = np.repeat(np.arange(len(starts)), sizes)
        small = ~big[run]
        lefts, rights = [], []
        for lag in range(1, min(PAIRWISE, int(sizes[~big].max(initial=0)))):
            i = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
            x = fp[i] ^ fp[i + lag]
            hit = i[_chain_ok(x, (key[i] >> 41)) & (np.bitwise_count(x) <= REACH)]
            lefts.append(hit)
            rights.append(hit + lag)
        if lefts:
            pairs += _forest(np.concatenate(lefts), np.concatenate(rights), rep)
        if pairs:
            yield batch(LINKS, list(map(list, zip(*set(pairs), strict=True))))

    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < 50_000:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        key = t["key"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if cut:
            yield from work(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id, fp`` of every row of ``docs`` (``doc_id, text``).

    Equal fingerprints form one class, represented by its smallest id; classes link at two differing bits or fewer, and
    components span such links. Null and empty texts have fingerprint 0 and form a class as any other. Rows of one id
    each get a row. A null id is a member but never a representative unless its class has no other id; such a class
    links with nothing and its component is null. Very long texts are hashed in blocks; an empty table gives no rows.
    """
    signs = materialise(fingerprints(docs, shingle), "fingerprints")
    classes, links = _fingerprint_links(signs)
    found = connected_components(links)
    classes = materialise(classes.join(found, classes["rep"] == found["node"], "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("component_id")), "components")
    out = signs.join(spread(classes), F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def _fingerprint_links(signs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (``fp, rep``) of equal fingerprints of ``signs`` (``doc_id, fp``), and links ``a, b`` between their representatives."""
    classes = materialise(signs.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    keyed = classes.filter("rep IS NOT NULL").select("fp", "rep", F.explode(_keys(F.col("fp"))).alias("key"))
    n = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes, keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_link, "a long, b long")


#: Documents of a stage are near copies from this Jaccard similarity of their shingle sets on.
SIMILARITY = 0.8
#: Minima of so many permutations make a band's key. At SIMILARITY exactly, a pair shares one of the bands with probability 0.9995.
BANDS, ROWS = 25, 6
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_MULTIPLY |= np.uint32(1)

#: Lowest bits of so many minima, and how many of them agree at least in two sets of SIMILARITY: 115 are expected there
#: with a deviation of 3.4, so that one pair in 10**10 is lost; sets that share little agree in 64 to 77.
SKETCH, AGREE = 128, 92
#: Buckets of more classes than this don't compare sketches in pairs.
SMALL = 64

PROFILES = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("bands", pa.list_(pa.int64()))])
SETS = pa.schema([("id", pa.int64()), ("hs", pa.list_(pa.int32()))])


def _minima(u: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a set of 32-bit hashes."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(u), 2048):  # bounded memory for very long texts
        np.minimum(low, (u[None, at : at + 2048] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return low


def _band_keys(low: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(low[ROWS * i : ROWS * (i + 1)].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sketch(low: np.ndarray) -> list[int]:
    return np.packbits((low[:SKETCH] & np.uint32(1)).astype(np.uint8)).view(np.int64).tolist()


def _folded(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _profiles(docs: DataFrame, shingle: int) -> DataFrame:
    """Fingerprint, digest and size of the shingle set, sketch and band keys of every row."""

    def run(batches):
        for b in pieces(batches):
            rows = [[] for _ in PROFILES.names[1:]]
            for t in b["text"].to_pylist():
                h = shingle_hashes(t, shingle)
                u = _folded(h)
                low = _minima(u)
                both = np.array([majority(h), xxhash.xxh64_intdigest(np.unique(h).tobytes())], np.uint64).view(np.int64).tolist()
                for out, x in zip(rows, (*both, len(u), *_sketch(low), _band_keys(low) if len(u) else []), strict=True):
                    out.append(x)
            yield batch(PROFILES, [b["doc_id"], *rows])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long, cls long, n long, s0 long, s1 long, bands array<long>")


def _shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``row, id, hs``: the sorted set of 32-bit shingle hashes of every row of ``docs`` whose id is in ``ids`` (one column, distinct),
    and of some others. The texts aren't shuffled."""

    def run(batches):
        for b in pieces(batches):
            yield batch(SETS, [b["doc_id"], [_folded(shingle_hashes(t, shingle)).view(np.int32) for t in b["text"].to_pylist()]])

    sets = sieve(docs.select("doc_id", "text"), ids).mapInArrow(run, "id long, hs array<int>")
    return materialise(sets.select(F.monotonically_increasing_id().alias("row"), "id", "hs"), "sets")


def _alike(n, m, s0, t0, s1, t1, similarity: float):
    """Whether sizes and sketches leave the similarity possible."""
    differ = F.bit_count(F.col(s0).bitwiseXOR(F.col(t0))) + F.bit_count(F.col(s1).bitwiseXOR(F.col(t1)))
    return (F.least(n, m) >= F.lit(similarity) * F.greatest(n, m) - _SLACK) & (differ <= SKETCH - AGREE)


def _in_buckets(similarity: float):
    """``a, b, ca, cb`` of those pairs in a bucket that are in different components and that sizes and sketches let pass;
    the rows come sorted by key, a bucket has SMALL rows at most."""

    def work(t: pa.Table):
        key, rep, c, n, s0, s1 = (t[x].to_numpy() for x in ("key", "rep", "c", "n", "s0", "s1"))
        found = [[], [], [], []]
        for lag in range(1, SMALL):
            i = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(i):
                break
            j = i + lag
            differ = np.bitwise_count(s0[i] ^ s0[j]).astype(int) + np.bitwise_count(s1[i] ^ s1[j])
            ok = (c[i] != c[j]) & (differ <= SKETCH - AGREE) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - _SLACK)
            i, j = i[ok], j[ok]
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for out, x in zip(found, (rep[i], rep[j], c[i], c[j]), strict=True):
                out.append(x)
        if found[0]:
            p = np.unique(np.stack([np.concatenate(x) for x in found], axis=1), axis=0)
            if len(p):
                yield batch(CROSS, list(p.T))

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < 50_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = int((t["key"].to_numpy() == t["key"][-1].as_py()).argmax())  # the last bucket may go on
            if cut:
                yield from work(t.slice(0, cut))
                held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return run


CROSS = pa.schema([(x, pa.int64()) for x in ("a", "b", "ca", "cb")])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those rows of ``pairs`` (ids ``a, b``) whose shingle sets are similar enough, by the exact Jaccard similarity of 32-bit hashes."""
    j = pairs.join(sets.select(F.col("id").alias("a"), F.col("hs").alias("x")), "a")
    j = spread(j).join(spread(sets.select(F.col("id").alias("b"), F.col("hs").alias("y"))), "b")
    common = F.size(F.array_intersect("x", "y"))
    return j.filter(common >= F.lit(similarity) * (F.size("x") + F.size("y") - common) - _SLACK).drop("x", "y").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``_verified`` with sets made for the ids in ``pairs`` alone."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return _verified(pairs, _shingle_sets(docs, ids, shingle), similarity)


#: Lengths that come from a similarity are rounded so that an error of the last bit only lets more candidates through.
_SLACK = 1e-9


def _sharing_prefix(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b, ca, cb``: pairs of ids of ``sets`` (``row, id, c, hs``) in different components ``c`` that may be similar enough.

    Prefix filtering, which loses no pair: with all sets in one order, rarest shingles first, two sets of the similarity
    share one of the first ``n - ceil(similarity * n) + 1`` shingles of each, and behind the first one that they share
    both have enough left. Shingles of one set alone fill its prefix without naming a candidate, so a text of a large
    group that differs from all others by many shingles of its own meets few of them.
    """
    each = sets.select("row", "id", "c", F.size("hs").alias("n"), F.explode("hs").alias("h"))
    counts = each.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1")
    held = each.join(spread(counts), "h").groupBy("row", "id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("t"))
    alone = F.col("n") - F.size("t")
    length = F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - _SLACK).cast("int") + 1 - alone
    prefix = held.filter(length > 0).select("id", "c", "n", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), length)).alias("at", "s"))
    prefix = materialise(prefix.select("id", "c", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), F.col("s.h").alias("h")), "prefixes")
    x = prefix.select("h", F.col("id").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("left").alias("la"))
    y = prefix.select("h", F.col("id").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    enough = F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")) - _SLACK
    j = x.join(y, (x["h"] == y["h"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("la", "lb") >= enough))
    return j.select("a", "b", "ca", "cb").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, component_id`` of every row with an id: components over near copies of whole texts.

    Two documents link if their fingerprints differ in two bits or fewer, or if their sets of word shingles have at least
    ``similarity``. At 64 bits a similarity of 0.8 is a distance of about ten, where the chains prune almost nothing;
    candidates for the second kind of link therefore share a band of minima, agree in size and in a sketch, and are then
    checked exactly. Texts of one shingle set are one class. In each bucket, classes are first held against the one of
    smallest id. Of what is still in different components, all pairs of a bucket of SMALL classes or fewer are tried; the
    classes of larger buckets are held against those of other components by prefix filtering. So no link between
    components is left out, and neither copies of one text nor all members of a large bucket meet in pairs. Null and empty
    texts are copies of each other. Rows that share an id count as one document that has all their texts. An empty table
    gives no rows. Texts travel only to Python workers; shuffled are profiles, band keys, and the sets of candidates.
    """
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    signs = materialise(_profiles(d, shingle), "profiles")
    fingerprints, links = _fingerprint_links(signs.select("doc_id", "fp"))
    one = F.min(F.struct("doc_id", "n", "s0", "s1", "bands")).alias("one")  # all of a class have the same set
    reps = signs.groupBy("cls").agg(one).select("cls", F.col("one.doc_id").alias("rep"), "one.n", "one.s0", "one.s1", "one.bands")
    reps = materialise(reps, "reps")
    alike = signs.select("cls", "fp").distinct().join(fingerprints.withColumnRenamed("rep", "b"), "fp").select("cls", "b")
    alike = alike.join(reps.select("cls", F.col("rep").alias("a")), "cls").filter("a <> b").select("a", "b")

    each = reps.select("cls", "rep", F.explode("bands").alias("key"))
    first = each.groupBy("key").agg(F.count("*").alias("k"), F.min(F.struct("rep", "cls")).alias("first")).filter("k > 1")
    shared = materialise(each.join(spread(first), "key"), "buckets")
    about = reps.select(F.col("cls").alias("cls_"), "n", "s0", "s1")
    star = shared.filter(F.col("cls") != F.col("first.cls")).select("cls", "rep", F.col("first.cls").alias("c0"), F.col("first.rep").alias("r0")).distinct()
    star = star.join(about.toDF("c0", "m", "t0", "t1"), "c0").join(about.toDF("cls", "n", "s0", "s1"), "cls").filter(_alike(F.col("n"), F.col("m"), "s0", "t0", "s1", "t1", similarity))
    star = materialise(star.select(F.col("r0").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    found = connected_components(links.unionByName(alike).unionByName(_checked(star, d, shingle, similarity)))

    known = reps.drop("bands").join(found, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component")
    known = materialise(known, "known")
    m = materialise(shared.select("cls", "key", "k").join(spread(known), "cls").select("key", "k", "rep", "c", "n", "s0", "s1"), "members")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = m.filter(F.col("k") <= SMALL).drop("k").repartition(n, "key").sortWithinPartitions("key")
    cross = few.mapInArrow(_in_buckets(similarity), "a long, b long, ca long, cb long")
    many = m.filter(F.col("k") > SMALL)
    mixed = many.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = materialise(many.join(spread(mixed), "key").select(F.col("rep").alias("id"), "c").distinct(), "open")
    if not open_.isEmpty():
        sets = _shingle_sets(d, open_.select("id").distinct(), shingle)
        cross = cross.unionByName(_sharing_prefix(sets.join(open_, "id"), similarity))
    cross = materialise(cross.distinct(), "cross")
    late = materialise(_checked(cross, d, shingle, similarity).select("ca", "cb").distinct(), "late")
    if not late.isEmpty():
        more = connected_components(late, "ca", "cb")
        known = known.join(more, F.col("c") == F.col("node"), "left").withColumn("c", F.coalesce("component", "c"))
    known = known.select("cls", F.col("c").alias("component_id"))
    return signs.select("doc_id", "cls").join(spread(known), "cls").select("doc_id", "component_id")


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``near_copies`` the document with the smallest id, and rows without id. Columns stay as they are."""
    gone = near_copies(docs, shingle, similarity).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("fp")
