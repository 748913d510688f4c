"""Registered queries of the series engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.models import bit_length, eps, leading_zeros, trailing_zeros, unzigzag, zigzag
from tessera.operators import access, blocks, compress, index, metrics
from tessera.plans.partition import grid, partition
from tessera.sources import fragments as store
from tessera.sources.series import cents, denormalise, normalise, to_series, to_series_large

BPC = 12
ERROR = 500


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    return to_series(e, F.col("user_id"), [F.col("ts"), F.col("event_id")], cents(F.col("value")))


def doubles(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value")
    return to_series(e, F.col("user_id"), [F.col("ts"), F.col("event_id")], F.col("value"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """One series a part, in the order of its lines."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return to_series(li, F.col("l_suppkey"), [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")], cents(F.col("l_extendedprice")))


def times(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("key")).distinct()


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The fragments of ``events``, compressed and written once per application and input, and read from there by all access queries."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stored:
        path = store.scratch(spark) + "-fragments"
        store.write(compress.compress_linear(events(spark, sf), BPC), path)
        _stored[key] = path
    return store.read(spark, _stored[key])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Per user: points, errors after decoding, and compressed size."""
    p = events(spark, sf)
    f = store.materialise(compress.compress(p, BPC), "fragments")
    return metrics.errors(p, access.decompress(f)).select("series_id", "n", "mismatches", "max_error").join(metrics.sizes(f).select("series_id", "fragments", "total_bits", "ratio"), "series_id")


_SERIES = """SELECT CAST(user_id AS VARCHAR) AS series_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, {y} AS y FROM events WHERE value IS NOT NULL"""
_CENTS = _SERIES.format(y="CAST(round(value * 100) AS BIGINT)")
_VALUES = _SERIES.format(y="value")
_PRICES = """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT)) - 1 AS BIGINT) AS pos, CAST(round(l_extendedprice * 100) AS BIGINT) AS y FROM lineitem WHERE l_extendedprice IS NOT NULL"""
_TIMES = "SELECT DISTINCT epoch_us(ts) AS key FROM events"

Q, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _shift(e: int) -> str:
    return f"(CASE WHEN min(y) OVER (PARTITION BY series_id) < 0 THEN min(y) OVER (PARTITION BY series_id) - 1 ELSE -1 END - {e})"


@query("series_scan_normalize", f"SELECT series_id, pos, y - {_shift(eps(BPC))} AS y FROM ({_CENTS})")
def _(s, d):
    return normalise(events(s, d), eps(BPC)).select("series_id", "pos", "y")


@query("global_series", "SELECT 'all' AS series_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, CAST(round(value * 100) AS BIGINT) AS y FROM events WHERE value IS NOT NULL")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts", "value")
    return to_series_large(e, F.lit("all"), [F.col("ts"), F.col("event_id")], cents(F.col("value")))


_ACCT = "SELECT 'all' AS series_id, CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS pos, CAST(round(c_acctbal * 100) AS BIGINT) AS y FROM customer"


def _acct(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    return to_series(c, F.lit("all"), [F.col("c_custkey")], cents(F.col("c_acctbal")), F.col("c_custkey"))


@query("normalize_negative", f"SELECT series_id, pos, y - {_shift(7)} AS y FROM ({_ACCT})")
def _(s, d):
    return normalise(_acct(s, d), 7).select("series_id", "pos", "y")


@query("normalize_roundtrip", _ACCT)
def _(s, d):
    return denormalise(normalise(_acct(s, d), 7)).select("series_id", "pos", "y")


@query("lossless_roundtrip", _CENTS)
def _(s, d):
    return access.decompress(compress.compress(events(s, d), BPC))


@query("linear_roundtrip", _PRICES)
def _(s, d):
    return access.decompress(compress.compress_linear(prices(s, d), BPC))


@query("trained_roundtrip", _CENTS)
def _(s, d):
    return access.decompress(compress.compress_trained(events(s, d), BPC))


@query("load_and_verify", f"SELECT series_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches FROM ({_CENTS}) GROUP BY series_id")
def _(s, d):
    return store.verify(stored(s, d), events(s, d))


@query("point_access", f"SELECT series_id, pos, y FROM ({_CENTS}) WHERE pos % 7 = 3")
def _(s, d):
    return access.at(stored(s, d), events(s, d).filter("pos % 7 = 3"))


@query("point_access_all", _CENTS)
def _(s, d):
    return access.at(stored(s, d), events(s, d))


@query("position_access", f"SELECT series_id, pos, y FROM ({_CENTS}) WHERE pos = 17")
def _(s, d):
    return access.at_position(stored(s, d), 17)


@query("range_scan", f"SELECT series_id, pos, y FROM ({_CENTS}) WHERE pos >= 11 AND pos < 40")
def _(s, d):
    return access.scan(stored(s, d), 11, 40)


@query("checksum", f"SELECT series_id, CAST(sum(y) AS BIGINT) AS total, count(*) AS n FROM ({_CENTS}) GROUP BY series_id")
def _(s, d):
    return access.decompress(stored(s, d)).groupBy("series_id").agg(F.sum("y").alias("total"), F.count("*").alias("n"))


def _bound(method):
    def run(s, d):
        p = events(s, d)
        f = compress.compress_lossy(p, ERROR, method)
        return metrics.errors(p, access.approximate(f), ERROR).select("series_id", "n", "violations")

    return run


for _m in ("all", "pla", "aa"):
    query({"all": "lossy_bound_check", "pla": "pla_bound_check", "aa": "aa_bound_check"}[_m], f"SELECT series_id, count(*) AS n, CAST(0 AS BIGINT) AS violations FROM ({_CENTS}) GROUP BY series_id")(_bound(_m))


@query("fragment_invariants", f"SELECT series_id, count(*) AS n, CAST(0 AS BIGINT) AS gaps FROM ({_CENTS}) GROUP BY series_id")
def _(s, d):
    f = access.ends(stored(s, d))
    gap = (F.col("next_start").isNotNull() & (F.col("next_start") != F.col("start") + F.col("len"))) | (F.octet_length("residuals") != F.ceil(F.col("len") * F.col("bpc") / 8))
    return f.groupBy("series_id").agg(F.sum("len").alias("n"), F.count_if(gap).alias("gaps"))


@query("residual_offsets")
def _(s, d):
    return access.ends(compress.compress(events(s, d), BPC)).select("series_id", "start", "len", "model", "bpc", "next_start", "offset_bits", "quadratic_rank", "sqrt_rank")


@query("slope_cone", f"""WITH p AS (SELECT *, first(y) OVER (PARTITION BY series_id ORDER BY pos) AS y0 FROM ({_CENTS}))
SELECT series_id, pos, max(CASE WHEN pos > 0 THEN (y - y0 - {ERROR}.0::DOUBLE) / pos END) OVER w AS low, min(CASE WHEN pos > 0 THEN (y - y0 + {ERROR}.0::DOUBLE) / pos END) OVER w AS high
FROM p WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def _(s, d):
    return access.slope_cone(events(s, d), ERROR)


def _blocks(codec, points, kind):
    return lambda s, d: blocks.decode_blocks(blocks.encode_blocks(points(s, d), codec), kind=kind)


for _c in ("gorilla", "chimp", "chimp128", "tsxor"):
    query(f"{_c}_roundtrip", _VALUES)(_blocks(_c, doubles, "double"))
for _c in ("zstd", "lz4", "snappy", "brotli", "xz", "dac"):
    query({"dac": "dac_roundtrip"}.get(_c, f"block_{_c}_roundtrip"), _CENTS)(_blocks(_c, events, "bigint"))


@query("block_point_access", f"SELECT series_id, pos, y FROM ({_PRICES}) WHERE pos % 101 = 0")
def _(s, d):
    p = prices(s, d)
    return blocks.at_blocks(blocks.encode_blocks(p, "gorilla", 256), p.filter("pos % 101 = 0"), 256)


@query("block_point_access_all", _PRICES)
def _(s, d):
    p = prices(s, d)
    return blocks.at_blocks(blocks.encode_blocks(p, "gorilla", 256), p, 256)


@query("dac_point_access", f"SELECT series_id, pos, y FROM ({_PRICES}) WHERE pos % 50 = 0")
def _(s, d):
    p = prices(s, d)
    return blocks.at_blocks(blocks.encode_blocks(p, "dac", 256), p.filter("pos % 50 = 0"), 256)


@query("dac_range_scan", f"SELECT series_id, pos, y FROM ({_PRICES}) WHERE pos >= 100 AND pos < 400")
def _(s, d):
    return blocks.scan_blocks(blocks.encode_blocks(prices(s, d), "dac", 256), 100, 400, 256)


@query("block_range_scan", f"SELECT series_id, pos, y FROM ({_PRICES}) WHERE pos >= 100 AND pos < 400")
def _(s, d):
    return blocks.scan_blocks(blocks.encode_blocks(prices(s, d), "lz4", 256), 100, 400, 256)


@query("block_size_sweep")
def _(s, d):
    out = None
    for b in (512, 1024, 2048, 4096, 8192, 16384):
        r = blocks.block_sizes(blocks.encode_blocks(prices(s, d), "zstd", b)).groupBy("codec").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits")).withColumn("block", F.lit(b))
        out = r if out is None else out.unionByName(r)
    return out


@query("block_sweep_invariants", f"SELECT CAST(block AS INT) AS block, codec, n, TRUE AS smaller FROM (SELECT count(*) AS n FROM ({_PRICES})), (SELECT unnest([512, 4096, 16384]) AS block), (SELECT unnest(['dac', 'zstd']) AS codec)")
def _(s, d):
    out = None
    for codec in ("dac", "zstd"):
        for b in (512, 4096, 16384):
            r = blocks.encode_blocks(prices(s, d), codec, b).agg(F.sum("n").alias("n"), (F.sum("size_bits") < 40 * F.sum("n")).alias("smaller")).select(F.lit(b).alias("block"), F.lit(codec).alias("codec"), "n", "smaller")
            out = r if out is None else out.unionByName(r)
    return out


_XOR = f"""WITH p AS (SELECT series_id, pos, y FROM ({_CENTS})), x AS (SELECT xor(y, lag(y) OVER (PARTITION BY series_id ORDER BY pos)) AS x FROM p)
SELECT CASE WHEN x = 0 THEN 64 ELSE 64 - length(bin(x)) END AS clz, CASE WHEN x = 0 THEN 64 ELSE length(bin(x & -x)) - 1 END AS ctz, count(*) AS n FROM x WHERE x IS NOT NULL GROUP BY ALL"""


@query("xor_stats", f"SELECT CAST(clz AS BIGINT) AS clz, CAST(ctz AS BIGINT) AS ctz, n FROM ({_XOR})")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("pos")
    x = events(s, d).select(F.col("y").bitwiseXOR(F.lag("y").over(w)).alias("x")).filter("x IS NOT NULL")
    return x.groupBy(leading_zeros(F.col("x")).cast("bigint").alias("clz"), trailing_zeros(F.col("x")).cast("bigint").alias("ctz")).agg(F.count("*").alias("n"))


@query("window_hits", f"""WITH p AS (SELECT series_id, pos, y FROM ({_CENTS})), w AS (SELECT *, list(y) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 127 PRECEDING AND 1 PRECEDING) AS l FROM p)
SELECT series_id, count(*) FILTER (list_contains(l, y) OR (y = 0 AND pos < 127)) AS hits FROM w GROUP BY series_id""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(-127, -1)
    p = events(s, d).withColumn("l", F.collect_list("y").over(w))
    return p.groupBy("series_id").agg(F.count_if(F.array_contains("l", F.col("y")) | ((F.col("y") == 0) & (F.col("pos") < 127))).alias("hits"))


@query("zigzag_roundtrip", f"SELECT series_id, pos, CASE WHEN d < 0 THEN -2 * d - 1 ELSE 2 * d END AS u, d AS y FROM (SELECT series_id, pos, y - 5000 AS d FROM ({_CENTS}))")
def _(s, d):
    u = zigzag(F.col("y") - 5000)
    return events(s, d).select("series_id", "pos", u.alias("u"), unzigzag(u).alias("y"))


@query("dac_msb_histogram", f"SELECT CAST(b AS BIGINT) AS bits, CAST(sum(n) OVER (ORDER BY b DESC) AS BIGINT) AS at_least FROM (SELECT CASE WHEN y = 0 THEN 0 ELSE length(bin(y)) END AS b, count(*) AS n FROM ({_CENTS}) GROUP BY 1)")
def _(s, d):
    from pyspark.sql import Window

    h = events(s, d).groupBy(bit_length(F.col("y")).cast("bigint").alias("bits")).agg(F.count("*").alias("c"))  # 65 rows at most
    return h.select("bits", F.sum("c").over(Window.orderBy(F.desc("bits"))).alias("at_least"))


EF_WIDTH = 20


@query("ef_split", f"SELECT key, key >> {EF_WIDTH} AS high, key & {(1 << EF_WIDTH) - 1} AS low FROM ({_TIMES})")
def _(s, d):
    h, low = index.split(F.col("key"), EF_WIDTH)
    return times(s, d).select("key", h.alias("high"), low.alias("low"))


_PROBES = "SELECT DISTINCT key + 1234567 * (event_id % 3 - 1) AS probe FROM (SELECT epoch_us(ts) AS key, event_id FROM events WHERE event_id % 5 = 0)"


def _probes(s, d):
    e = s.read.parquet(f"{d}/events.parquet").filter("event_id % 5 = 0")
    return e.select((F.unix_micros(F.col("ts").cast("timestamp")) + 1234567 * (F.col("event_id") % 3 - 1)).alias("probe")).distinct()


_ALL_PROBES = "SELECT DISTINCT key + 1234567 * (event_id % 3 - 1) AS probe FROM (SELECT epoch_us(ts) AS key, event_id FROM events)"


def _all_probes(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((F.unix_micros(F.col("ts").cast("timestamp")) + 1234567 * (F.col("event_id") % 3 - 1)).alias("probe")).distinct()


@query("ef_predecessor_all", f"SELECT p.probe, k.key AS predecessor FROM ({_ALL_PROBES}) p ASOF LEFT JOIN ({_TIMES}) k ON p.probe >= k.key")
def _(s, d):
    return index.predecessor(times(s, d), _all_probes(s, d))


@query("ef_predecessor", f"SELECT p.probe, k.key AS predecessor FROM ({_PROBES}) p ASOF LEFT JOIN ({_TIMES}) k ON p.probe >= k.key")
def _(s, d):
    return index.predecessor(times(s, d), _probes(s, d))


@query("key_ranks", f"SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank FROM ({_TIMES})")
def _(s, d):
    return index.ranked(times(s, d))


@query("elias_fano_roundtrip", f"SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank FROM ({_TIMES})")
def _(s, d):
    path = store.scratch(s) + "-elias-fano"
    index.elias_fano(index.ranked(times(s, d)), EF_WIDTH).write.parquet(path)
    return index.elias_fano_keys(s.read.parquet(path))


@query("elias_fano_rank_access", f"SELECT CAST(row_number() OVER w - 1 AS BIGINT) AS rank, key, lag(key) OVER w AS before, lead(key) OVER w AS after FROM ({_TIMES}) WINDOW w AS (ORDER BY key)")
def _(s, d):
    r = index.ranked(times(s, d))
    return index.elias_fano_around(store.materialise(index.elias_fano(r, EF_WIDTH), "elias-fano"), r)


@query("pgm_lookup", f"SELECT p.probe, CAST(coalesce((SELECT min(r) FROM (SELECT key, row_number() OVER (ORDER BY key) - 1 AS r FROM ({_TIMES})) k WHERE k.key >= p.probe), (SELECT count(*) FROM ({_TIMES}))) AS BIGINT) AS rank FROM ({_PROBES}) p")
def _(s, d):
    r = store.materialise(index.ranked(times(s, d)), "ranks")
    n = r.count()
    return index.lower_bound(r, index.pgm_search(index.pgm_build(r), _probes(s, d), n), n)


@query("pgm_lookup_all", f"""WITH k AS (SELECT key, CAST(row_number() OVER (ORDER BY key) - 1 AS BIGINT) AS rank FROM ({_TIMES}))
SELECT p.probe, coalesce(k.rank, (SELECT count(*) FROM k)) AS rank FROM ({_ALL_PROBES}) p ASOF LEFT JOIN k ON p.probe <= k.key""")
def _(s, d):
    r = store.materialise(index.ranked(times(s, d)), "ranks")
    n = r.count()
    return index.lower_bound(r, index.pgm_search(index.pgm_build(r), _all_probes(s, d), n), n)


@query("pgm_descend", SQL["pgm_lookup"])
def _(s, d):
    r = store.materialise(index.ranked(times(s, d)), "ranks")
    n = r.count()
    return index.lower_bound(r, index.pgm_descend(index.pgm_tower(index.pgm_build(r)), _probes(s, d), n), n)


@query("pgm_metadata")
def _(s, d):
    return index.pgm_levels(index.pgm_build(index.ranked(times(s, d))))


@query("mape_block_midrange", f"""WITH p AS (SELECT series_id, pos // 16 AS b, y FROM ({_CENTS})), m AS (SELECT *, (min(y) OVER (PARTITION BY series_id, b) + max(y) OVER (PARTITION BY series_id, b)) // 2 AS f, max(y) OVER (PARTITION BY series_id) - min(y) OVER (PARTITION BY series_id) AS r FROM p)
SELECT series_id, round(avg(abs((y - f) / CAST(y + 1 AS DOUBLE))), 9) AS mape, max(r) AS value_range FROM m GROUP BY series_id""")
def _(s, d):
    p = events(s, d).withColumn("b", F.floor(F.col("pos") / 16))
    m = p.groupBy("series_id", "b").agg(F.expr("(min(y) + max(y)) div 2").alias("f"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    j = p.join(m, ["series_id", "b"])
    return j.groupBy("series_id").agg(F.round(F.avg(F.abs((F.col("y") - F.col("f")) / (F.col("y") + 1).cast("double"))), 9).alias("mape"), (F.max("hi") - F.min("lo")).alias("value_range"))


@query("size_breakdown")
def _(s, d):
    return metrics.sizes(compress.compress(events(s, d), BPC))


@query("size_invariants", f"SELECT series_id, count(*) AS n, CAST(0 AS BIGINT) AS mismatches, TRUE AS compressed, TRUE AS few_fragments, TRUE AS sums FROM ({_CENTS}) GROUP BY series_id")
def _(s, d):
    """An encoder that stores points as they are, or a fragment for every second one, fails here."""
    p = events(s, d)
    f = store.materialise(compress.compress(p, BPC), "fragments")
    parts = sum((F.col(c) for c in ("coefficient_bits", "type_bits", "start_bits", "offset_bits", "bpc_bits")), F.col("residual_bits"))
    size = metrics.sizes(f).select("series_id", (F.col("total_bits") < 64 * F.col("n")).alias("compressed"), (F.col("fragments") * 2 < F.col("n")).alias("few_fragments"), (parts == F.col("total_bits")).alias("sums"))
    return store.verify(f, p).join(size, "series_id")


@query("model_coverage", f"SELECT count(*) AS covered, TRUE AS five FROM ({_CENTS})")
def _(s, d):
    """Each point is covered by one model, and the five best of them cover most."""
    models = grid(BPC)
    f = store.materialise(compress.fragments_of(normalise(events(s, d), eps(BPC)), lambda y: partition(y, models)), "raw")
    best = compress.best_models(f).agg(F.sum("covered").alias("best"))
    return f.agg(F.sum("len").alias("covered")).join(F.broadcast(best)).select("covered", (2 * F.col("best") > F.col("covered")).alias("five"))


@query("best_models")
def _(s, d):
    models = grid(BPC)
    return compress.best_models(compress.fragments_of(normalise(events(s, d), eps(BPC)), lambda y: partition(y, models)))


@query("fragment_rows")
def _(s, d):
    return store.as_rows(stored(s, d))


@query("flagship")
def _(s, d):
    return flagship(s, d)


QUERIES, ORACLES = Q, SQL
