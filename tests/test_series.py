import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.functions import bits, codecs
from tessera.functions.fit import Online, greedy, segment, stab
from tessera.functions.models import bits_of, eps
from tessera.operators import access, blocks, compress, index, metrics
from tessera.plans.partition import ALL, grid, partition
from tessera.sources import fragments as store
from tessera.sources.series import read_binary, read_rows, to_series, to_series_large, uniform_keys


def edge_series():
    x = np.arange(300)
    return {
        "one": np.array([7]), "two": np.array([3, -9]), "const": 0 * x + 5, "line": 3 * x - 7, "parabola": x * x // 3, "exp": np.round(9 * np.exp(0.02 * x)),
        "sqrt": np.round(90 * np.sqrt(x + 1)), "alternating": 1000 * (-1) ** x, "step": np.where(x < 150, 0, 99), "negative": -5 * x * x - 1, "zero": 0 * x,
        "large": 2**53 + x * 7919 % 1000, "c-1": x[:63], "c": x[:64] ** 2, "c+1": np.random.default_rng(1).integers(-50, 50, 65),
    }


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(pd.concat([pd.DataFrame({"series_id": k, "pos": np.arange(len(v)), "y": v.astype(np.int64)}) for k, v in edge_series().items()])).cache()


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("kind", ["all", "linear", "trained"])
def test_roundtrip_and_access(points, kind, tmp_path, spark):
    f = {"all": lambda: compress.compress(points, 9, chunk=64), "linear": lambda: compress.compress_linear(points, 9, chunk=64), "trained": lambda: compress.compress_trained(points, 9, training=32, chunk=64)}[kind]()
    store.write(f, str(tmp_path / "f"))
    f = store.read(spark, str(tmp_path / "f"))
    p = points.select("series_id", "pos", "y")
    assert same(access.decompress(f), p)
    assert same(access.at(f, p, 64), p)
    for a, z in ((0, 1), (10, 10), (60, 70), (0, 300), (64, 128)):
        assert same(access.scan(f, a, z, 64), p.filter(f"pos >= {a} AND pos < {z}"))
    assert same(access.at_position(f, 63, 64), p.filter("pos = 63"))
    assert metrics.sizes(f).filter("total_bits IS NULL OR total_bits <= 0").count() == 0


@pytest.mark.parametrize("method", ["all", "pla", "aa"])
def test_lossy_bound(points, method):
    f = compress.compress_lossy(points.filter("series_id <> 'large'"), 20, method, chunk=64)
    m = metrics.errors(points, access.approximate(f), 20)
    assert m.agg(F.sum("violations")).first()[0] == 0 and m.count() == len(edge_series()) - 1


def test_stab_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 12))
        x, y = np.arange(1.0, n + 1), rng.integers(0, 12, n).astype(float)
        low, high = y - 1.5, y + 1.5

        def fits(k):
            lo = max([(low[j] - high[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(k), 2)], default=-1e9)
            hi = min([(high[j] - low[i]) / (x[j] - x[i]) for i, j in itertools.combinations(range(k), 2)], default=1e9)
            return lo <= hi

        k, a, b = stab(x, low, high)
        assert k == max(q for q in range(1, n + 1) if all(fits(r) for r in range(1, q + 1)))
        assert (a * x[:k] + b >= low[:k] - 1e-9).all() and (a * x[:k] + b <= high[:k] + 1e-9).all()


def test_partition_is_cheapest():
    rng = np.random.default_rng(5)
    models = grid(4)
    weights = {0: 20, 1: 21, 2: 30, 3: 31}
    for _ in range(15):
        y = rng.integers(20, 60, int(rng.integers(1, 9)))
        fits = [greedy(f, b, y) for f, b in models]
        edge = {}
        for (f, b), frags in zip(models, fits, strict=True):
            for a, z, c in frags:
                for i, j in itertools.combinations(range(a, z + 1), 2):
                    if c:
                        edge[i, j] = min(edge.get((i, j), 1e9), weights[f] + b * (j - i))
        best = [0.0]
        for k in range(1, len(y) + 1):
            best.append(min(best[i] + edge[i, k] for i in range(k) if (i, k) in edge))
        out = partition(y, models, weights)
        assert sum(weights[r[2]] + r[3] * (r[1] - r[0]) for r in out) == pytest.approx(best[-1])
        assert [r[0] for r in out] == [0, *[r[1] for r in out[:-1]]] and out[-1][1] == len(y)


def test_families_and_bits():
    assert [eps(b) for b in range(5)] == [0, 0, 1, 3, 7] and all(bits_of(eps(b)) == b for b in range(2, 20))
    y = np.array([0.0, 5.0])
    assert segment(1, y, y - 1, y + 1)[0] == 0 and set(ALL) == {0, 1, 2, 3}


def test_codecs():
    rnd = random.Random(4)
    data = [[0], [codecs.MASK, 0, codecs.MASK], [1, 1 << 63 | 1, 0], [rnd.getrandbits(64) for _ in range(500)], [rnd.choice([5, 1 << 40]) for _ in range(500)], np.array([np.nan, np.inf, -0.0, 0.0, 1.5]).view(np.uint64).tolist()]
    for encode, decode in codecs.CODECS.values():
        for v in data:
            payload, size = encode(v)
            assert decode(payload, len(v)) == v and size <= 8 * len(payload)


def test_dac_levels_and_points():
    rnd = random.Random(6)
    for _ in range(20):
        v = [rnd.getrandbits(rnd.randint(1, 6)) for _ in range(60)]
        lengths = [x.bit_length() for x in v]
        top = max(lengths)

        def cost(widths):
            total, rest = 0, lengths
            for w in widths:
                over = [x for x in rest if x > w]
                total, rest = total + 8 + w * (len(rest) - len(over)) + (len(rest) if over else 0), over
            return total

        payload, size = codecs.dac_encode(v)
        assert size - 8 == min(cost((*some, top)) for r in range(top) for some in itertools.combinations(range(1, top), r))
        assert [codecs.dac_at(payload, len(v), i) for i in range(len(v))] == v
    x = [1 << 63, 0, 5, codecs.MASK]
    assert [codecs.dac_at(codecs.dac_encode(x)[0], 4, i) for i in range(4)] == x


def test_packed_fields(spark):
    rnd = random.Random(7)
    rows = []
    for w in (1, 3, 8, 13, 57, 58, 63, 64):
        v = [rnd.getrandbits(w) for _ in range(40)]
        data = bits.pack(np.array(v, np.uint64), w)
        assert bits.unpack(data, w, 40).tolist() == v == [bits.field(data, w * i, w) for i in range(40)] and len(data) == 5 * w
        rows += [(w, data, i, int(np.array(x, np.uint64).view(np.int64))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "w int, data binary, i int, x long").select("x", bits.field_column(F.col("data"), F.col("i"), F.col("w")).alias("y"))
    assert df.filter("x <> y OR y IS NULL").count() == 0


def test_online_fit_is_the_greedy_one():
    y = np.cumsum(np.random.default_rng(9).integers(-30, 31, 600)) + 5000
    for model in ALL:
        o, k = Online(model, 6), 0
        while k < len(y) and o.add(int(y[k])):
            k += 1
        a, z, c = greedy(model, 6, y)[0]
        assert k == z and o.coefficients() == pytest.approx(c)
    assert not Online(1, 4).add(2)


def test_blocks(points):
    b = blocks.encode_blocks(points, "chimp128", 64)
    p = points.select("series_id", "pos", "y")
    assert same(blocks.decode_blocks(b, 64), p)
    assert same(blocks.at_blocks(b, p.filter("pos % 50 = 0"), 64), p.filter("pos % 50 = 0"))
    assert same(blocks.scan_blocks(b, 60, 70, 64), p.filter("pos >= 60 AND pos < 70"))
    assert blocks.block_sizes(b).count() == len(edge_series())
    d = blocks.encode_blocks(points.withColumn("y", F.col("y").bitwiseAND(F.lit(0xFFFFF))), "dac", 64)
    probe = p.filter("pos % 7 = 0").withColumn("y", F.col("y").bitwiseAND(F.lit(0xFFFFF)))
    assert same(blocks.at_blocks(d, probe, 64), probe)


def test_verify_and_offsets(points):
    f = compress.compress(points, 9, chunk=64)
    assert store.verify(f, points).agg(F.sum("mismatches"), F.sum("n")).first()[:] == (0, points.count())
    wrong = points.withColumn("y", F.when((F.col("series_id") == "line") & (F.col("pos") == 70), 0).otherwise(F.col("y"))).filter("series_id <> 'one'")
    assert {r["series_id"] for r in store.verify(f, wrong).filter("mismatches = 1").collect()} == {"line", "one"}
    got = access.ends(f).orderBy("series_id", "start").toPandas()
    for _, g in got.groupby("series_id"):
        used = (g["len"] * g["bpc"]).cumsum()
        assert g["offset_bits"].tolist() == [0, *used[:-1]] and g["next_start"].tolist()[:-1] == g["start"].tolist()[1:] and np.isnan(g["next_start"].tolist()[-1])
        assert g["quadratic_rank"].tolist() == [0, *(g["model"] == 2).cumsum()[:-1]] and g["sqrt_rank"].tolist() == [0, *(g["model"] == 3).cumsum()[:-1]]


def test_positions_of_a_large_series(spark):
    rng = np.random.default_rng(8)
    rows = [(rng.choice(["a", "a", "a", "b"]), int(o), int(i)) for i, o in enumerate(rng.integers(0, 300, 2000))] + [("c", 1, None)]
    df = spark.createDataFrame([(str(a), b, c) for a, b, c in rows], "k string, o long, v long")
    assert same(to_series_large(df, F.col("k"), [F.col("o")], F.col("v")), to_series(df, F.col("k"), [F.col("o")], F.col("v")))


def test_index(spark):
    keys = sorted({int(x) for x in np.random.default_rng(2).integers(0, 1 << 40, 3000)})
    k = spark.createDataFrame([(x,) for x in keys], "key long")
    r = index.ranked(k).cache()
    assert [tuple(x) for x in r.orderBy("key").collect()] == [(x, i) for i, x in enumerate(keys)]
    probes = [*keys[::97], keys[0] - 1, keys[-1] + 1, *(x + 1 for x in keys[::53])]
    p = spark.createDataFrame([(x,) for x in set(probes)], "probe long")
    a = np.array(keys)
    want = {x: int(np.searchsorted(a, x)) for x in probes}
    found = index.lower_bound(r, index.pgm_search(index.pgm_build(r, chunk=1000), p, len(keys)), len(keys))
    assert {x["probe"]: x["rank"] for x in found.collect()} == want
    tower = index.pgm_tower(index.pgm_build(r, 1, 500), 1)
    assert len(tower) > 2 and tower[-1].count() == 1
    found = index.lower_bound(r, index.pgm_descend(tower, p, len(keys), 1, 1), len(keys))
    assert {x["probe"]: x["rank"] for x in found.collect()} == want
    sizes = index.pgm_levels(index.pgm_build(r)).orderBy("level").collect()
    assert sizes[-1]["segments"] == 1 and all(x["bytes"] == index.SEGMENT_BYTES * x["segments"] for x in sizes)
    ef = index.elias_fano(r, index.low_width(len(keys), keys[-1] + 1)).cache()
    assert same(index.elias_fano_keys(ef), r)
    around = {x["rank"]: tuple(x)[1:] for x in index.elias_fano_around(ef, r.filter("rank % 100 = 0 OR rank > 2990")).collect()}
    assert all(v == (keys[i], keys[i - 1] if i else None, keys[i + 1] if i + 1 < len(keys) else None) for i, v in around.items()) and len(keys) - 1 in around
    below = {x["probe"]: x["predecessor"] for x in index.predecessor(k, p).collect()}
    assert below == {x: (keys[i - 1] if (i := int(np.searchsorted(a, x, "right"))) else None) for x in probes}


def test_binary_files(spark, tmp_path):
    y = np.array([1, -5, 2**62], "<i8")
    (tmp_path / "a.bin").write_bytes(np.array([3], "<i8").tobytes() + y.tobytes())
    assert [r["y"] for r in read_binary(spark, str(tmp_path)).orderBy("pos").collect()] == y.tolist()
    assert read_binary(spark, str(tmp_path), header=False, max_size=2).count() == 2
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.bin").write_bytes(np.array([0.5, -1e300], "<f8").tobytes())
    assert [r["y"] for r in read_binary(spark, str(tmp_path / "d"), "<f8", header=False).orderBy("pos").collect()] == [0.5, -1e300]
    (tmp_path / "rows.txt").write_text('1 a"b\n2 c\n')
    assert [tuple(r) for r in read_rows(spark, str(tmp_path / "rows.txt"), "n int, s string").orderBy("n").collect()] == [(1, 'a"b'), (2, "c")]
    keys = [r["key"] for r in uniform_keys(spark, 1000).collect()]
    assert len(set(keys)) == 1000 and min(keys) >= 0 and max(keys) < 1 << 62


def test_dump(points, spark, tmp_path):
    f = compress.compress_linear(points.filter("series_id = 'c+1'"), 9, chunk=64)
    store.write_csv(store.as_rows(f), str(tmp_path / "dump"))
    rows = spark.read.option("header", True).csv(str(tmp_path / "dump")).collect()
    assert rows and all(len(r["residuals"].strip("[]").split(":")) == int(r["len"]) for r in rows if r["bpc"] != "0")
    store.write_csv(metrics.sizes(f), str(tmp_path / "sizes"))
    assert spark.read.option("header", True).csv(str(tmp_path / "sizes")).count() == 1


def drained(stream, tmp_path, name, done):
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    for _ in range(90):
        if done(spark.table(name)):
            break
        time.sleep(1)
    q.stop()
    return spark.table(name)


def test_stream(spark, tmp_path):
    """All blocks come, the last, short one when the series stays idle; doubles and integers, which no double could hold."""
    from tessera.streaming.encode import encode_stream, fit_stream

    y = [2**60 + 3 * i + i % 3 for i in range(250)]
    spark.createDataFrame(pd.DataFrame({"series_id": "a", "pos": np.arange(250), "y": y, "z": np.arange(250) * 0.5})).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("series_id string, pos long, y long, z double").parquet(str(tmp_path / "in"))
    got = drained(encode_stream(s.select("series_id", "pos", "y"), block=100), tmp_path, "ints", lambda t: t.count() == 3)
    assert [r["y"] for r in blocks.decode_blocks(got, 100).orderBy("pos").collect()] == y
    got = drained(encode_stream(s.select("series_id", "pos", F.col("z").alias("y")), block=100), tmp_path, "doubles", lambda t: t.count() == 3)
    assert [r["y"] for r in blocks.decode_blocks(got, 100, "double").orderBy("pos").collect()] == [i * 0.5 for i in range(250)]
    small = s.select("series_id", "pos", (F.col("pos") * 3 + F.when(F.col("pos") < 120, 0).otherwise(5000)).alias("y"))
    got = drained(fit_stream(small, bpc=4), tmp_path, "fits", lambda t: t.agg(F.sum("len")).first()[0] == 250).orderBy("start").collect()
    assert [(r["start"], r["len"]) for r in got] == [(0, 120), (120, 130)] and all(abs(r["t1"] - 3) < 0.2 for r in got)


def test_queries_search_all_widths(spark, tmp_path):
    rnd = np.random.default_rng(4)
    rows = [(i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}", 1, float(v) / 100) for i, v in enumerate(rnd.integers(5000, 5008, 700))]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").selectExpr("event_id", "CAST(ts AS timestamp) AS ts", "user_id", "value").write.parquet(str(tmp_path / "events.parquet"))
    assert {r["bpc"] for r in queries.QUERIES["best_models"](spark, str(tmp_path)).collect()} == {3}
    p = queries.events(spark, str(tmp_path))
    want = [r["total_bits"] for r in metrics.sizes(compress.compress(p, queries.BPC)).collect()]
    for name in ("size_breakdown", "flagship"):
        assert [r["total_bits"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == want


def test_queries_probe_every_row(spark):
    d = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{d}/events.parquet").selectExpr("unix_micros(CAST(ts AS timestamp)) AS key", "event_id").collect()
    keys = np.unique([r["key"] for r in e])
    probes = sorted({r["key"] + 1234567 * (r["event_id"] % 3 - 1) for r in e})
    q = queries.QUERIES
    assert sorted((r["probe"], r["rank"]) for r in q["pgm_lookup_all"](spark, d).collect()) == [(p, int(np.searchsorted(keys, p))) for p in probes]
    before = [int(np.searchsorted(keys, p, "right")) - 1 for p in probes]
    assert sorted((r["probe"], r["predecessor"]) for r in q["ef_predecessor_all"](spark, d).collect()) == [(p, int(keys[i]) if i >= 0 else None) for p, i in zip(probes, before, strict=True)]
    for name, points in (("point_access_all", queries.events), ("block_point_access_all", queries.prices)):
        assert sorted(map(tuple, q[name](spark, d).select("series_id", "pos", "y").collect())) == sorted(map(tuple, points(spark, d).select("series_id", "pos", "y").collect()))
