"""Registered queries of the range engine, each with the SQL that checks it.

Two kinds of results.  Exact ones are compared value by value.  Contract ones
(`within` columns) give the exact answer from SQL and state that the approximate one keeps
its promise; SQL supplies TRUE.  Query sets come from workload.py: bounds at fixed ranks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources, streaming
from .functions.columns import area, certified, cover, horner, leaky_forward, normal_quantile_of, overlap_share, round_area, shift_unsigned, united
from .operators import blocks, ensemble, exact, histogram, sampling, segments, staged, surface
from .operators.keyspace import asof, clean, cumulative, spread
from .operators.workload import boxes, boxes_by_selectivity, ranges, ranges_by_selectivity
from .plans import answers
from .tables import keep, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

T_ABS, T_REL = 100.0, 0.01


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _price(spark: SparkSession, d: str) -> DataFrame:
    return keep(cumulative(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), "cdf")


def _keys(table: str, key: str, name: str = "keys") -> str:
    return f"{name} AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS rank FROM (SELECT DISTINCT CAST({key} AS DOUBLE) AS key FROM {table} WHERE {key} IS NOT NULL))"


def _ranges(queries: int = 200, keys: str = "keys", name: str = "q") -> str:
    return (
        f"{name} AS (SELECT i AS qid, l.key AS lo, h.key AS hi FROM (SELECT i, least(i * 7919 % n, (i * 104729 + 13) % n) AS a, greatest(i * 7919 % n, (i * 104729 + 13) % n) AS b "
        f"FROM range({queries}) t(i), (SELECT count(*) AS n FROM {keys})) JOIN {keys} l ON l.rank = a JOIN {keys} h ON h.rank = b)"
    )


_PRICE = f"WITH {_keys('lineitem', 'l_extendedprice')}, {_ranges()} "
_TS = "epoch_us(ts) / 1e6"
_OPEN = "l_extendedprice > lo AND l_extendedprice <= hi"
_CLOSED = "l_extendedprice BETWEEN lo AND hi"


def _agg(columns: str, on: str, table: str = "lineitem") -> str:
    return f"SELECT qid, {columns} FROM q LEFT JOIN {table} ON {on} GROUP BY qid"


# ---- cumulative functions, order, lookups

@_query("w01_cumulative", "SELECT key, n, sum(n) OVER (ORDER BY key)::BIGINT AS f, sum(total) OVER (ORDER BY key) AS s FROM (SELECT l_extendedprice AS key, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1)")
def _(spark, d):
    return _price(spark, d).select("key", "n", "f", "s")


@_query("w06_rank", "SELECT o_totalprice AS key, row_number() OVER (ORDER BY o_totalprice) - 1 AS rank FROM (SELECT DISTINCT o_totalprice FROM orders)")
def _(spark, d):
    return cumulative(_read(spark, d, "orders"), "o_totalprice").select("key", F.col("rank").cast("long").alias("rank"))


@_query("w03_spread", "SELECT key, n, coalesce(lead(key) OVER (ORDER BY key) - key, 1) AS spread FROM (SELECT l_quantity AS key, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, d):
    return spread(keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")).select("key", "n", "spread")


@_query("a32_frequencies", "SELECT key, n, n * coalesce(lead(key) OVER (ORDER BY key) - key, 1) AS area FROM (SELECT l_quantity AS key, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, d):
    return histogram.frequencies(keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")).select("key", "n", "area")


@_query("j01_asof", f"WITH {_keys('lineitem', 'l_extendedprice')} SELECT o_orderkey, max(key) AS hit FROM orders LEFT JOIN keys ON key <= o_totalprice GROUP BY 1")
def _(spark, d):
    probes = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("at"))
    return asof(probes, _price(spark, d).select("key", "rank")).select("o_orderkey", F.col("hit.key").alias("hit"))


@_query("j03_lower_bound", f"WITH {_keys('lineitem', 'l_extendedprice')} SELECT o_orderkey, min(key) AS hit FROM orders LEFT JOIN keys ON key >= o_totalprice GROUP BY 1")
def _(spark, d):
    probes = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("at"))
    return asof(probes, _price(spark, d).select("key", "rank"), forward=True).select("o_orderkey", F.col("hit.key").alias("hit"))


@_query("j02_equi_lookup", f"WITH {_keys('lineitem', 'l_extendedprice')}, c AS (SELECT l_extendedprice AS key, count(*) AS n FROM lineitem GROUP BY 1) SELECT keys.key, rank, n FROM keys JOIN c ON c.key = keys.key")
def _(spark, d):
    t = _price(spark, d)
    return t.select("key").join(t.select("key", F.col("rank").cast("long").alias("rank"), "n"), "key")


@_query("w02_surface", """
WITH g AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS e FROM lineitem),
cells AS (SELECT least(greatest(floor((l_extendedprice - a) / ((b - a) / 16)), 0), 15)::INT AS x, least(greatest(floor((l_quantity - c) / ((e - c) / 16)), 0), 15)::INT AS y, count(*) AS n FROM lineitem, g GROUP BY 1, 2)
SELECT i::INT AS i, j::INT AS j, coalesce(sum(n), 0)::BIGINT AS f FROM range(17) t(i), range(17) s(j) LEFT JOIN cells ON x < i AND y < j GROUP BY 1, 2""")
def _(spark, d):
    return surface.surface(surface.points(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), 16).select("i", "j", F.col("f").cast("long").alias("f"))


# ---- exact answers

@_query("a09_count1d_exact", _PRICE + _agg("count(l_orderkey) AS count", _OPEN))
def _(spark, d):
    t = _price(spark, d)
    return exact.by_cumulative(ranges(t), t).select("qid", F.col("count").cast("long").alias("count"))


@_query("a09_count1d_closed", _PRICE + _agg("count(l_orderkey) AS count", _CLOSED))
def _(spark, d):
    t = _price(spark, d)
    return exact.by_cumulative(ranges(t), t, closed=True).select("qid", F.col("count").cast("long").alias("count"))


@_query("a01_range_count", _PRICE + _agg("count(l_orderkey) AS count", _CLOSED))
def _(spark, d):
    return exact.range_scan(_read(spark, d, "lineitem"), ranges(_price(spark, d)), "l_extendedprice").select("qid", "count")


@_query("a02_range_max", _PRICE + _agg("max(l_quantity) AS max", _CLOSED))
def _(spark, d):
    return exact.range_scan(_read(spark, d, "lineitem"), ranges(_price(spark, d)), "l_extendedprice", "l_quantity").select("qid", "max")


@_query("a30_range_min_avg", _PRICE + _agg("min(l_quantity) AS min, round(avg(l_quantity), 6) AS avg", _CLOSED))
def _(spark, d):
    return exact.range_scan(_read(spark, d, "lineitem"), ranges(_price(spark, d)), "l_extendedprice", "l_quantity").select("qid", "min", F.round("avg", 6).alias("avg"))


@_query("a31_range_sum", _PRICE + _agg("coalesce(sum(l_quantity), 0) AS sum", _OPEN))
def _(spark, d):
    t = _price(spark, d)
    return exact.by_cumulative(ranges(t), t).select("qid", "sum")


@_query("a30_negative_max", f"WITH {_keys('customer', 'c_custkey')}, {_ranges(100)} " + _agg("max(c_acctbal) AS max, min(c_acctbal) AS min", "c_custkey BETWEEN lo AND hi", "customer"))
def _(spark, d):
    c = _read(spark, d, "customer")
    return exact.range_scan(c, ranges(cumulative(c, "c_custkey"), 100), "c_custkey", "c_acctbal").select("qid", "max", "min")


@_query("a02_time_max", f"WITH {_keys('events', _TS)}, {_ranges(100)} " + _agg("max(value) AS max", f"{_TS} BETWEEN lo AND hi", "events"))
def _(spark, d):
    e = _read(spark, d, "events")
    return exact.range_scan(e, ranges(cumulative(e, "ts"), 100), "ts", "value").select("qid", "max")


_BOXES = (
    f"WITH {_keys('lineitem', 'l_extendedprice', 'k1')}, {_keys('lineitem', 'l_quantity', 'k2')}, {_ranges(100, 'k1', 'r')}, "
    "q AS (SELECT r.qid, r.lo AS lo1, r.hi AS hi1, l.key AS lo2, h.key AS hi2 FROM (SELECT i, least((i * 31 + 5) % n, (i * 17 + 1) % n) AS a, greatest((i * 31 + 5) % n, (i * 17 + 1) % n) AS b "
    "FROM range(100) t(i), (SELECT count(*) AS n FROM k2)) JOIN k2 l ON l.rank = a JOIN k2 h ON h.rank = b JOIN r ON r.qid = i) "
)


@_query("j07_box_count", _BOXES + _agg("count(l_orderkey) AS count", "l_extendedprice BETWEEN lo1 AND hi1 AND l_quantity BETWEEN lo2 AND hi2"))
def _(spark, d):
    rows = _read(spark, d, "lineitem")
    q = boxes(_price(spark, d), keep(cumulative(rows, "l_quantity"), "cdf"))
    return exact.box_count(q, surface.points(rows, "l_extendedprice", "l_quantity")).select("qid", "count")


@_query("a15_box_max", _BOXES + _agg("max(l_discount) AS max", "l_extendedprice BETWEEN lo1 AND hi1 AND l_quantity BETWEEN lo2 AND hi2"))
def _(spark, d):
    rows = _read(spark, d, "lineitem")
    q = boxes(_price(spark, d), keep(cumulative(rows, "l_quantity"), "cdf"))
    return exact.box_count(q, surface.points(rows, "l_extendedprice", "l_quantity", "l_discount")).select("qid", "max")


@_query("g01_count_by_group", _PRICE + f"SELECT qid, l_returnflag AS grp, count(*) AS count FROM q JOIN lineitem ON {_CLOSED} GROUP BY 1, 2")
def _(spark, d):
    return exact.ranges_per_group(_read(spark, d, "lineitem"), ranges(_price(spark, d)), "l_extendedprice", None, "l_returnflag").select("qid", "grp", "count")


_SELECTIVE = (
    f"WITH {_keys('lineitem', 'l_extendedprice')}, q AS (SELECT p * 50 + i AS qid, l.key AS lo, h.key AS hi FROM "
    "(SELECT i, p, (i * 7919) % greatest(1, n - floor(s * n))::BIGINT AS a, least((i * 7919) % greatest(1, n - floor(s * n))::BIGINT + floor(s * n)::BIGINT, n - 1) AS b "
    "FROM range(50) t(i), (VALUES (0, 0.0001::DOUBLE), (1, 0.001::DOUBLE), (2, 0.01::DOUBLE), (3, 0.1::DOUBLE)) v(p, s), (SELECT count(*) AS n FROM keys)) JOIN keys l ON l.rank = a JOIN keys h ON h.rank = b) "
)


@_query("s12_count_by_selectivity", _SELECTIVE + _agg("count(l_orderkey) AS count", _OPEN))
def _(spark, d):
    t = _price(spark, d)
    return exact.by_cumulative(ranges_by_selectivity(t), t).select(F.col("qid").cast("long").alias("qid"), F.col("count").cast("long").alias("count"))


# ---- synopses with a promise

_EXACT_WITHIN = _PRICE + _agg("count(l_orderkey) AS exact, TRUE AS within", _OPEN)


def _synopsis(method: str, degree: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = _price(spark, d)
        q = ranges(t)
        segs = keep(segments.build(t, method, T_ABS, degree), "segments")
        rough = answers.cumulative_answers(q, segs, degree)
        truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
        within = (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6) & (F.col("bound") <= 2 * T_ABS + 1e-6)
        return rough.join(truth, "qid").select("qid", "exact", within.alias("within"))

    return run


for _name, _method, _degree in (
    ("b01_poly_degree1", "poly", 1), ("b01_poly_degree2", "poly", 2), ("b01_poly_degree3", "poly", 3), ("b01_poly_degree4", "poly", 4),
    ("b09_cone", "cone", 1), ("b10_pla", "pla", 1), ("b11_spline", "spline", 1), ("b16_sliding", "sliding", 1),
):
    _query(_name, _EXACT_WITHIN)(_synopsis(_method, _degree))


@_query("b14_bottom_up", _PRICE + "SELECT qid, exact, TRUE AS within, TRUE AS least_squares FROM (" + _agg("count(l_orderkey) AS exact", _OPEN) + ")")
def _(spark, d):
    """Every segment is the least-squares line of its own keys, and its measured error bounds the answers."""
    t = _price(spark, d)
    q = ranges(t)
    segs = keep(segments.build(t, "bottom_up", degree=1, block=512), "segments")
    truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
    rough = answers.cumulative_answers(q, segs, 1)
    own = asof(t.select(F.col("key").alias("at"), F.col("f").cast("double").alias("f")), segs).groupBy("hit.key", "hit.n", F.col("hit.coef")[1].alias("slope"))
    off = own.agg(F.count("*").alias("rows"), F.regr_slope("f", "at").alias("wanted"))
    fine = off.agg(F.bool_and((F.col("rows") == F.col("n")) & (F.col("wanted").isNull() | (F.abs(F.col("wanted") - F.col("slope")) <= 1e-6 * F.abs("wanted")))).alias("least_squares"))
    kept = (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6).alias("within")
    return rough.join(truth, "qid").select("qid", "exact", kept).crossJoin(fine)


@_query("a09_count1d_refined", _PRICE + _agg("count(l_orderkey) AS exact, TRUE AS within", _OPEN))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Counts over ranges from a degree-2 synopsis; what isn't certified to T_REL is refined to the exact count."""
    t = _price(spark, d)
    q = ranges(t)
    segs = keep(segments.build(t, "poly", T_ABS, 2), "segments")
    done = answers.count_with_refinement(q, segs, t, 2, T_REL)
    truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
    off = F.abs(F.col("answer") - F.col("exact"))
    kept = F.when(F.col("certified"), off <= T_REL * F.col("exact") + 1e-6).otherwise(off == 0)
    return done.join(truth, "qid").select("qid", "exact", kept.alias("within"))


@_query("a31_sum1d_refined", _PRICE + _agg("coalesce(sum(l_quantity), 0) AS exact, TRUE AS within", _OPEN))
def _(spark, d):
    t = _price(spark, d)
    q = ranges(t)
    segs = keep(segments.build(t, "poly", 2500.0, 2, measure="s"), "segments")
    done = answers.count_with_refinement(q, segs, t, 2, T_REL, measure="sum")
    truth = exact.by_cumulative(q, t).select("qid", F.col("sum").alias("exact"))
    off = F.abs(F.col("answer") - F.col("exact"))
    kept = F.when(F.col("certified"), off <= T_REL * F.col("exact") + 1e-6).otherwise(off == 0)
    return done.join(truth, "qid").select("qid", "exact", kept.alias("within"))


@_query("k05_segment_contract", "SELECT count(DISTINCT l_extendedprice) AS keys, TRUE AS covered, TRUE AS within FROM lineitem")
def _(spark, d):
    t = _price(spark, d)
    segs = keep(segments.build(t, "cone", T_ABS), "segments")
    off = segments.refit_errors(segs, t, 1).agg(F.max("max_error").alias("e"))
    return segs.agg(F.sum("n").alias("keys"), (F.sum(F.col("idx_hi") - F.col("idx_lo")) == F.sum("n")).alias("covered")).crossJoin(off).select("keys", "covered", (F.col("e") <= T_ABS + 1e-6).alias("within"))


def _max_rows(spark: SparkSession, d: str, table: str, key: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _read(spark, d, table)
    t = keep(cumulative(rows, key, value), "cdf")
    pairs = clean(rows, key, value)
    return t, pairs, blocks.keyed(pairs, t)


def _max_query(degree: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t, pairs, per_key = _max_rows(spark, d, "events", "ts", "value")
        q = ranges(t, 100)
        segs = keep(segments.build_max(per_key.select("key", "rank", F.col("most").alias("v")), 50.0, degree, 1024), "segments")
        rough = answers.max_answers(q, segs, degree)
        truth = exact.by_scan(q, pairs).select("qid", F.col("max").alias("exact"))
        return rough.join(truth, "qid").select("qid", "exact", ((F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6) & (F.col("bound") <= 50.0 + 1e-6)).alias("within"))

    return run


_TIME_MAX = f"WITH {_keys('events', _TS)}, {_ranges(100)} " + _agg("max(value) AS exact, TRUE AS within", f"{_TS} BETWEEN lo AND hi", "events")
for _degree in (1, 2, 3, 4):
    _query(f"a06_max1d_degree{_degree}", _TIME_MAX)(_max_query(_degree))


@_query("a13_max1d_refined", _TIME_MAX)
def _(spark, d):
    t, pairs, per_key = _max_rows(spark, d, "events", "ts", "value")
    q = ranges(t, 100)
    segs = keep(segments.build_max(per_key.select("key", "rank", F.col("most").alias("v")), 50.0, 1, 1024), "segments")
    done = answers.max_with_refinement(q, segs, pairs, 1, T_REL)
    truth = exact.by_scan(q, pairs).select("qid", F.col("max").alias("exact"))
    off = F.abs(F.col("answer") - F.col("exact"))
    return done.join(truth, "qid").select("qid", "exact", F.when(F.col("certified"), off <= T_REL * F.abs("exact") + 1e-6).otherwise(off == 0).alias("within"))


@_query("a29_segment_max", "SELECT max(value) AS top, TRUE AS within FROM events")
def _(spark, d):
    _, pairs, per_key = _max_rows(spark, d, "events", "ts", "value")
    segs = keep(segments.build_max(per_key.select("key", "rank", F.col("most").alias("v")), 50.0, 1, 1024), "segments")
    truth = exact.by_scan(segs.select(F.monotonically_increasing_id().alias("qid"), F.col("key").alias("lo"), F.col("key_hi").alias("hi")), pairs).agg(F.max("max").alias("m"))
    return segs.agg(F.max("seg_max").alias("top")).crossJoin(truth).select("top", (F.col("top") == F.col("m")).alias("within"))


# ---- staged models, ensembles

_FANOUTS = (1, 10, 100)


def _staged(fanouts: tuple[int, ...]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        """The errors of the two leaves asked bound each answer."""
        t = _price(spark, d)
        q = ranges(t)
        models = keep(staged.train(t, fanouts), "staged")
        truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
        return staged.count_answers(q, models, t, fanouts).join(truth, "qid").select("qid", "exact", (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6).alias("within"))

    return run


_query("a17_staged_count", _EXACT_WITHIN)(_staged(_FANOUTS))
_query("b12_four_stages", _EXACT_WITHIN)(_staged((1, 10, 100, 1000)))


@_query("b12_staged_replaced", _PRICE + "SELECT qid, exact, TRUE AS within, TRUE AS mixed FROM (" + _agg("count(l_orderkey) AS exact", _OPEN) + ")")
def _(spark, d):
    """Leaves above the median error are replaced: such ends are exact, the others keep their leaf's error."""
    t = _price(spark, d)
    q = ranges(t)
    models = keep(staged.train(t, _FANOUTS), "staged")
    middle = models.where(F.col("stage") == len(_FANOUTS) - 1).agg(F.median("max_error")).first()[0] or 0.0
    found = keep(staged.count_answers(q, models, t, _FANOUTS, replace_above=middle), "answers")
    truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
    mixed = found.agg((F.max("replaced") == 2).alias("some"), (F.min("replaced") == 0).alias("none")).select((F.col("some") & F.col("none")).alias("mixed"))
    kept = (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6) & (F.col("bound") <= 2 * middle + 1e-6) & ((F.col("replaced") < 2) | (F.col("approx") == F.col("exact")))
    return found.join(truth, "qid").select("qid", "exact", kept.alias("within")).crossJoin(mixed)


_STAGE = "SELECT {m} AS m, avg(key) AS shift, coalesce(regr_slope(f, key), 0) AS a, avg(f) AS b FROM {t} GROUP BY 1"
_NEXT = "least(greatest(floor(round(a * (key - shift) + b, 6) / greatest(total, 1)::DOUBLE * {models}), 0), {models} - 1)::INT"


@_query("j11_bucket_map", f"""
WITH c AS (SELECT key, (sum(n) OVER (ORDER BY key))::DOUBLE AS f, (SELECT count(*) FROM lineitem) AS total FROM (SELECT l_extendedprice AS key, count(*) AS n FROM lineitem GROUP BY 1)),
s0 AS ({_STAGE.format(m='0', t='c')}), r1 AS (SELECT key, f, total, {_NEXT.format(models=10)} AS m1 FROM c, s0),
s1 AS ({_STAGE.format(m='m1', t='r1')}), r2 AS (SELECT key, {_NEXT.format(models=100)} AS bucket FROM r1 JOIN s1 ON m = m1)
SELECT bucket, count(*) AS keys, min(key) AS lo, max(key) AS hi FROM r2 GROUP BY 1""")
def _(spark, d):
    t = _price(spark, d)
    return staged.bucket_map(t, keep(staged.train(t, _FANOUTS), "staged"), _FANOUTS).groupBy("bucket").agg(F.count("*").alias("keys"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@_query("b17_tree_ensemble", _EXACT_WITHIN)
def _(spark, d):
    """Learnt, saved, loaded: no bound is promised, five hundredths of all rows are expected."""
    t = _price(spark, d)
    q = ranges(t)
    path = f"{shared_folder(spark)}/ensemble-{uuid.uuid4().hex}"
    ensemble.save(ensemble.train(t, ["key"], "f"), path)
    truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
    n = t.agg(F.sum("n")).first()[0] or 0
    return ensemble.count_answers(q, ensemble.load(path)).join(truth, "qid").select("qid", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.05 * n).alias("within"))


@_query("a33_regression", "SELECT l_returnflag AS grp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(stddev_samp(l_extendedprice), 3) AS spread FROM lineitem GROUP BY 1")
def _(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return _read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("grp")).agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 3).alias("intercept"), F.round(F.stddev_samp(y), 3).alias("spread"))


# ---- two keys

_GRID = 32


def _cells(queries: int) -> str:
    """Boxes of lattice cells, in SQL that both engines read."""
    low = lambda a, b: f"least({a} % {_GRID}, {b} % {_GRID})"
    high = lambda a, b: f"greatest({a} % {_GRID}, {b} % {_GRID}) + 1"
    i, j = ("id * 7", "(id * 13 + 5)"), ("id * 11", "(id * 3 + 2)")
    return f"SELECT id AS qid, {low(*i)} AS i_lo, {high(*i)} AS i_hi, {low(*j)} AS j_lo, {high(*j)} AS j_hi FROM range({queries}) t(id)"


def _cell_queries(spark: SparkSession, queries: int = 100) -> DataFrame:
    return spark.sql(_cells(queries))


_CELL_SQL = f"""
WITH g AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_quantity) AS c, max(l_quantity) AS e FROM lineitem),
cells AS (SELECT least(greatest(floor((l_extendedprice - a) / ((b - a) / {_GRID})), 0), {_GRID - 1}) AS x, least(greatest(floor((l_quantity - c) / ((e - c) / {_GRID})), 0), {_GRID - 1}) AS y FROM lineitem, g),
q AS ({_cells(100)})
SELECT qid, count(x) AS exact{{more}} FROM q LEFT JOIN cells ON x >= i_lo AND x < i_hi AND y >= j_lo AND y < j_hi GROUP BY qid"""


def _lattice(spark: SparkSession, d: str) -> DataFrame:
    return keep(surface.surface(surface.points(_read(spark, d, "lineitem"), "l_extendedprice", "l_quantity"), _GRID), "lattice")


@_query("a10_count2d_exact", _CELL_SQL.format(more=""))
def _(spark, d):
    return surface.exact_boxes(_cell_queries(spark), _lattice(spark, d)).select("qid", F.col("count").alias("exact"))


def _quad(degree: int, kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        lattice, q = _lattice(spark, d), _cell_queries(spark)
        models = keep(surface.quadrants(lattice, T_ABS, degree, _GRID, 1, kind), "models")
        rough = surface.box_answers(q, models, degree, _GRID, kind)
        truth = surface.exact_boxes(q, lattice).select("qid", F.col("count").alias("exact"))
        return rough.join(truth, "qid").select("qid", "exact", (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6).alias("within"))

    return run


_query("b07_count2d_tensor", _CELL_SQL.format(more=", TRUE AS within"))(_quad(2, "tensor"))
_query("b08_count2d_quadratic", _CELL_SQL.format(more=", TRUE AS within"))(_quad(2, "quadratic"))


@_query("k07_prediction_surface", f"SELECT ({_GRID} + 1) * ({_GRID} + 1) AS n, count(*) AS top, TRUE AS within FROM lineitem")
def _(spark, d):
    lattice = _lattice(spark, d)
    models = keep(surface.quadrants(lattice, T_ABS, 2, _GRID), "models")
    off = F.abs(F.col("value") - F.col("f")) <= T_ABS + 1e-6
    flat = surface.prediction_surface(lattice, models, 2, _GRID)
    return flat.agg(F.count("*").cast("int").alias("n"), F.max("f").cast("long").alias("top"), F.bool_and(off).alias("within"))


def _raw(spark: SparkSession, d: str):
    """Points, their domain, boxes of keys between lattice points, and the lattice's models."""
    rows = _read(spark, d, "lineitem")
    pts = surface.points(rows, "l_extendedprice", "l_quantity")
    box = surface.domain(pts)
    lattice = keep(surface.surface(pts, _GRID, box), "lattice")
    models = keep(surface.quadrants(lattice, T_ABS, 2, _GRID), "models")
    q = boxes(_price(spark, d), keep(cumulative(rows, "l_quantity"), "cdf"))
    return pts, q, surface.raw_box_answers(q, models, 2, _GRID, box)


_OPEN_BOX = "l_extendedprice > lo1 AND l_extendedprice <= hi1 AND l_quantity > lo2 AND l_quantity <= hi2"
_CLOSED_BOX = "l_extendedprice BETWEEN lo1 AND hi1 AND l_quantity BETWEEN lo2 AND hi2"


@_query("a10_raw_boxes", _BOXES + _agg("count(l_orderkey) AS exact, TRUE AS within", _OPEN_BOX))
def _(spark, d):
    pts, q, rough = _raw(spark, d)
    truth = exact.box_count(q, pts, closed=False).select("qid", F.col("count").alias("exact"))
    return rough.join(truth, "qid").select("qid", "exact", (F.abs(F.col("approx") - F.col("exact")) <= F.col("bound") + 1e-6).alias("within"))


@_query("a14_count2d_refined", _BOXES + _agg("count(l_orderkey) AS exact, TRUE AS within", _OPEN_BOX))
def _(spark, d):
    """What isn't certified to a tenth is refined to the exact count."""
    pts, q, rough = _raw(spark, d)
    truth = exact.box_count(q, pts, closed=False).select("qid", F.col("count").alias("exact"))
    done = surface.boxes_with_refinement(q, rough, pts, 0.1)
    off = F.abs(F.col("answer") - F.col("exact"))
    return done.join(truth, "qid").select("qid", "exact", F.when(F.col("certified"), off <= 0.1 * F.col("exact") + 1e-6).otherwise(off == 0).alias("within"))


def _box_tree(spark: SparkSession, d: str):
    rows = _read(spark, d, "lineitem")
    held = keep(blocks.box_leaves(surface.points(rows, "l_extendedprice", "l_quantity", "l_discount")), "leaves")
    return boxes(_price(spark, d), keep(cumulative(rows, "l_quantity"), "cdf")), held, keep(blocks.box_summary(held), "tree")


@_query("a25_box_aggregate", _BOXES + _agg("count(l_orderkey) AS count, round(coalesce(sum(l_discount), 0), 6) AS sum, min(l_discount) AS min, max(l_discount) AS max", _CLOSED_BOX))
def _(spark, d):
    q, held, tree = _box_tree(spark, d)
    return blocks.box_aggregate(q, tree, held).select("qid", "count", F.round(F.coalesce("sum", F.lit(0.0)), 6).alias("sum"), "min", "max")


@_query("a26_box_progressive", _BOXES + _agg("count(l_orderkey) AS exact, TRUE AS within", _CLOSED_BOX))
def _(spark, d):
    q, held, tree = _box_tree(spark, d)
    truth = blocks.box_aggregate(q, tree, held).select("qid", F.col("count").alias("exact"))
    done = blocks.box_progressive(q, tree, held, 0.2)
    kept = (F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high")) & (F.col("high") <= 1.2 * F.col("low")) & F.col("estimate").between(F.col("low"), F.col("high"))
    return done.join(truth, "qid").select("qid", "exact", kept.alias("within"))


_SELECTIVE_BOXES = f"""
WITH {_keys('lineitem', 'l_extendedprice', 'k1')}, {_keys('lineitem', 'l_quantity', 'k2')}, p AS (SELECT * FROM (VALUES (0, 0.0001::DOUBLE), (1, 0.001::DOUBLE), (2, 0.01::DOUBLE), (3, 0.1::DOUBLE)) v(p, s)),
""" + ", ".join(f"""r{k} AS (SELECT p * 20 + i AS qid, l.key AS lo{k}, h.key AS hi{k} FROM (SELECT i, p, (i * 7919) % greatest(1, n - floor(sqrt(s) * n))::BIGINT AS a, least((i * 7919) % greatest(1, n - floor(sqrt(s) * n))::BIGINT + floor(sqrt(s) * n)::BIGINT, n - 1) AS b
  FROM range(20) t(i), p, (SELECT count(*) AS n FROM k{k})) JOIN k{k} l ON l.rank = a JOIN k{k} h ON h.rank = b)""" for k in (1, 2)) + ", q AS (SELECT * FROM r1 JOIN r2 USING (qid)) "


@_query("s13_boxes_by_selectivity", _SELECTIVE_BOXES + _agg("count(l_orderkey) AS count", _CLOSED_BOX))
def _(spark, d):
    rows = _read(spark, d, "lineitem")
    q = boxes_by_selectivity(_price(spark, d), keep(cumulative(rows, "l_quantity"), "cdf"), 20)
    return exact.box_count(q, surface.points(rows, "l_extendedprice", "l_quantity")).select(F.col("qid").cast("long").alias("qid"), "count")


@_query("b17_ensemble_boxes", _CELL_SQL.format(more=", TRUE AS within"))
def _(spark, d):
    lattice, q = _lattice(spark, d), _cell_queries(spark)
    model = ensemble.train(lattice, ["i", "j"], "f", trees=30)
    truth = surface.exact_boxes(q, lattice).select("qid", F.col("count").alias("exact"))
    n = lattice.agg(F.max("f")).first()[0] or 0
    return ensemble.box_answers(q, model).join(truth, "qid").select("qid", "exact", (F.abs(F.col("approx") - F.col("exact")) <= 0.1 * n).alias("within"))


# ---- summaries

def _tree(spark: SparkSession, d: str):
    t, pairs, per_key = _max_rows(spark, d, "lineitem", "l_extendedprice", "l_quantity")
    per_key = keep(per_key, "keys")
    return t, pairs, per_key, keep(blocks.summary(per_key), "tree")


@_query("a25_tree_aggregate", _PRICE + _agg("count(l_orderkey) AS count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max", _CLOSED))
def _(spark, d):
    t, _, per_key, tree = _tree(spark, d)
    return blocks.range_aggregate(ranges(t), tree, per_key).select("qid", F.col("count").cast("long").alias("count"), "sum", "min", "max")


@_query("a27_tree_levels", f"WITH {_keys('lineitem', 'l_extendedprice')} SELECT rank // 64 AS node, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS cnt, max(l_quantity) AS most FROM lineitem JOIN keys ON key = l_extendedprice GROUP BY 1")
def _(spark, d):
    tree = _tree(spark, d)[3]
    return tree.where("level = 0").select(F.col("node").cast("long").alias("node"), "lo", "hi", F.col("cnt").cast("long").alias("cnt"), "most")


@_query("a04_progressive_count", _PRICE + _agg("count(l_orderkey) AS exact, TRUE AS within", _CLOSED))
def _(spark, d):
    t, pairs, per_key, tree = _tree(spark, d)
    q = ranges(t)
    truth = exact.by_scan(q, pairs).select("qid", F.col("count").alias("exact"))
    done = blocks.progressive(q, tree, per_key, T_REL)
    return done.join(truth, "qid").select("qid", "exact", ((F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high")) & (F.col("high") <= (1 + T_REL) * F.col("low"))).alias("within"))


@_query("a04_progressive_absolute", _PRICE + _agg("count(l_orderkey) AS exact, TRUE AS within", _CLOSED))
def _(spark, d):
    t, pairs, per_key, tree = _tree(spark, d)
    q = ranges(t)
    truth = exact.by_scan(q, pairs).select("qid", F.col("count").alias("exact"))
    done = blocks.progressive(q, tree, per_key, 0.0, absolute=500.0)
    return done.join(truth, "qid").select("qid", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 500).alias("within"))


@_query("a05_progressive_max", _PRICE + _agg("max(l_quantity) AS exact, TRUE AS within", _CLOSED))
def _(spark, d):
    t, pairs, per_key, tree = _tree(spark, d)
    q = ranges(t)
    truth = exact.by_scan(q, pairs).select("qid", F.col("max").alias("exact"))
    return blocks.progressive_max(q, tree, per_key, T_REL).join(truth, "qid").select("qid", "exact", ((F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high")) & (F.col("high") <= (1 + T_REL) * F.col("low"))).alias("within"))


@_query("a37_entropy", "SELECT round(log2(sum(a)) - sum(a * log2(a)) / sum(a), 6) AS entropy FROM (SELECT count(*)::DOUBLE AS a FROM lineitem GROUP BY l_quantity)")
def _(spark, d):
    t = keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")
    return histogram.entropy(t, "n").select(F.round("entropy", 6).alias("entropy"))


def _splits(buckets: int) -> str:
    """The greedy splits of an entropy histogram over l_quantity, round by round."""
    h = lambda a, b: f"(CASE WHEN {a} > 0 THEN ({a}) * log2({a}) - ({b}) ELSE 0 END)"
    gain = f"{h('a1 - a0', 'b1 - b0')} - {h('p.a - a0', 'p.b - b0')} - {h('a1 - p.a', 'b1 - p.b')}"
    sql = """WITH areas AS (SELECT row_number() OVER (ORDER BY key) - 1 AS rank, n * coalesce(lead(key) OVER (ORDER BY key) - key, 1)::DOUBLE AS area FROM (SELECT l_quantity AS key, count(*) AS n FROM lineitem GROUP BY 1)),
p AS (SELECT rank, sum(area) OVER (ORDER BY rank) AS a, sum(CASE WHEN area > 0 THEN area * log2(area) ELSE 0 END) OVER (ORDER BY rank) AS b FROM areas),
e0 AS (SELECT -1::BIGINT AS rank, 0::DOUBLE AS a, 0::DOUBLE AS b UNION ALL SELECT rank, a, b FROM p WHERE rank = (SELECT max(rank) FROM p))"""
    for i in range(buckets - 1):
        sql += f""",
o{i} AS (SELECT rank AS r0, a AS a0, b AS b0, lead(rank) OVER (ORDER BY rank) AS r1, lead(a) OVER (ORDER BY rank) AS a1, lead(b) OVER (ORDER BY rank) AS b1 FROM e{i}),
e{i + 1} AS (SELECT * FROM e{i} UNION ALL SELECT rank, a, b FROM (SELECT p.rank, p.a, p.b, round(-({gain}), 6) AS g FROM p JOIN o{i} ON p.rank > r0 AND p.rank < r1 ORDER BY g, p.rank LIMIT 1))"""
    return sql + f" SELECT rank + 1 AS rank FROM e{buckets - 1} WHERE rank >= 0 AND rank < (SELECT max(rank) FROM p)"


@_query("b15_entropy_histogram", _splits(8))
def _(spark, d):
    t = keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")
    path = f"{shared_folder(spark)}/splits-{uuid.uuid4().hex}"
    sources.write(histogram.entropy_splits(t, 8), path)
    return sources.read(spark, path)


@_query("b15_histogram_count", f"WITH {_keys('lineitem', 'l_quantity')}, {_ranges(100)} SELECT qid, exact, TRUE AS within, TRUE AS globally FROM (" + _agg("count(l_orderkey) AS exact", "l_quantity > lo AND l_quantity <= hi") + ")")
def _(spark, d):
    """Counts from one line for each histogram bucket: bounded by the two buckets' errors, and by twice the worst."""
    t = keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")
    q = ranges(t, 100)
    segs = keep(segments.on_splits(t, histogram.entropy_splits(t, 8), 1), "segments")
    worst = segs.agg(F.max("loss").alias("worst"))
    truth = exact.by_cumulative(q, t).select("qid", F.col("count").cast("long").alias("exact"))
    off = F.abs(F.col("approx") - F.col("exact"))
    rough = answers.cumulative_answers(q, segs, 1).join(truth, "qid").crossJoin(F.broadcast(worst))
    return rough.select("qid", "exact", (off <= F.col("bound") + 1e-6).alias("within"), ((off <= 2 * F.col("worst") + 1e-6) & (F.col("bound") <= 2 * F.col("worst") + 1e-6)).alias("globally"))


@_query("a32_equal_width", "SELECT floor(l_extendedprice / 2000)::BIGINT AS bin, count(*) AS rows, count(DISTINCT l_extendedprice) AS keys FROM lineitem GROUP BY 1")
def _(spark, d):
    return histogram.equal_width(_price(spark, d), 2000.0).select("bin", F.col("rows").cast("long").alias("rows"), "keys")


# ---- samples

_UNIT = "(CAST(('0x' || substr(md5('{salt}:' || CAST({id} AS VARCHAR)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496::DOUBLE)"


@_query("f11_bernoulli", f"SELECT o_orderkey FROM orders WHERE {_UNIT.format(salt='s', id='o_orderkey')} < 0.1")
def _(spark, d):
    return sampling.bernoulli(_read(spark, d, "orders"), "o_orderkey", 0.1).select("o_orderkey")


_ORDERS = f"WITH {_keys('orders', 'o_totalprice')}, {_ranges(50)}"


@_query("a22_subsampled_count", _ORDERS + f""", s AS (SELECT o_totalprice AS key, floor({_UNIT.format(salt='sid', id='o_orderkey')} * 20) AS sid FROM orders WHERE {_UNIT.format(salt='s', id='o_orderkey')} < 0.5),
c AS (SELECT q.qid, t.sid, count(s.key) * 40.0::DOUBLE AS c FROM q CROSS JOIN range(20) t(sid) LEFT JOIN s ON s.sid = t.sid AND key BETWEEN lo AND hi GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c) - 1 AS r FROM c)
SELECT qid, round(avg(c) FILTER (WHERE r >= 1 AND r < 19), 6) AS estimate FROM r GROUP BY qid""")
def _(spark, d):
    o = _read(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("key"))
    q = ranges(cumulative(o, "o_totalprice"), 50)
    return sampling.subsampled_count(q, rows, "o_orderkey", 0.5, 20).select("qid", F.round("estimate", 6).alias("estimate"))


def _sequential(rows: str, inside: str, absolute: float, relative: float, most: int) -> str:
    """Sequential sampling: `rows` selects id and keys, queries are in q."""
    return f""", n AS (SELECT count(*) AS total FROM ({rows})), drawn AS (
  SELECT *, row_number() OVER (ORDER BY u, id) AS n FROM (SELECT *, {_UNIT.format(salt='seq', id='id')} AS u FROM ({rows})) WHERE u < least(1.0::DOUBLE, 2.0 * {most} / greatest((SELECT total FROM n), 1)) ORDER BY u, id LIMIT {most}
), run AS (
  SELECT qid, n, sum(CASE WHEN {inside} THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY qid ORDER BY n ROWS UNBOUNDED PRECEDING) AS hits FROM drawn, q
), tested AS (
  SELECT *, n >= 30 AND {relative} * greatest(hits, n * ({absolute}::DOUBLE / (SELECT total FROM n))) >= {NormalDist().inv_cdf(0.95)!r} * sqrt(n * CASE WHEN n > 1 THEN hits / n * (1 - hits / n) * n / (n - 1) ELSE 0 END) AS enough FROM run
), last AS (SELECT qid, coalesce(min(n) FILTER (WHERE enough), max(n)) AS n, coalesce(bool_or(enough), FALSE) AS stopped FROM tested GROUP BY qid)
SELECT qid, l.n AS drawn, round(hits / l.n * (SELECT total FROM n), 6) AS estimate, stopped FROM last l JOIN tested USING (qid, n)"""


@_query("a24_sequential_count", _ORDERS + _sequential("SELECT o_orderkey AS id, o_totalprice AS key FROM orders", "key BETWEEN lo AND hi", 100.0, 0.2, 2000))
def _(spark, d):
    o = _read(spark, d, "orders")
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("key"))
    q = ranges(cumulative(o, "o_totalprice"), 50)
    done = sampling.sequential_count(q, rows, "o_orderkey", 100.0, 0.2, most=2000)
    return done.select("qid", F.col("drawn").cast("long").alias("drawn"), F.round("estimate", 6).alias("estimate"), "stopped")


def _boxes(table: str, one: str, two: str, queries: int) -> str:
    return (
        f"WITH {_keys(table, one, 'k1')}, {_keys(table, two, 'k2')}, {_ranges(queries, 'k1', 'r')}, "
        "q AS (SELECT r.qid, r.lo AS lo1, r.hi AS hi1, l.key AS lo2, h.key AS hi2 FROM (SELECT i, least((i * 31 + 5) % n, (i * 17 + 1) % n) AS a, greatest((i * 31 + 5) % n, (i * 17 + 1) % n) AS b "
        f"FROM range({queries}) t(i), (SELECT count(*) AS n FROM k2)) JOIN k2 l ON l.rank = a JOIN k2 h ON h.rank = b JOIN r ON r.qid = i)"
    )


def _order_boxes(spark: SparkSession, d: str, queries: int = 50) -> tuple[DataFrame, DataFrame]:
    o = _read(spark, d, "orders")
    q = boxes(cumulative(o, "o_totalprice"), cumulative(o, "o_custkey"), queries)
    return q, o.select("o_orderkey", F.col("o_totalprice").alias("k1"), F.col("o_custkey").cast("double").alias("k2"))


@_query("a22_subsampled_boxes", _boxes("orders", "o_totalprice", "o_custkey", 50) + f""", s AS (SELECT o_totalprice AS k1, o_custkey AS k2, floor({_UNIT.format(salt='sid', id='o_orderkey')} * 10) AS sid FROM orders WHERE {_UNIT.format(salt='s', id='o_orderkey')} < 0.5),
c AS (SELECT q.qid, t.sid, count(s.k1) * 20.0::DOUBLE AS c FROM q CROSS JOIN range(10) t(sid) LEFT JOIN s ON s.sid = t.sid AND s.k1 BETWEEN lo1 AND hi1 AND s.k2 BETWEEN lo2 AND hi2 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c) - 1 AS r FROM c)
SELECT qid, round(avg(c) FILTER (WHERE r >= 0 AND r < 10), 6) AS estimate, round({NormalDist().inv_cdf(0.95)!r} * stddev_samp(c) / sqrt(10.0::DOUBLE), 5) AS half FROM ranked GROUP BY qid""")
def _(spark, d):
    q, rows = _order_boxes(spark, d)
    return sampling.subsampled_count(q, rows, "o_orderkey", 0.5, 10).select("qid", F.round("estimate", 6).alias("estimate"), F.round((F.col("high") - F.col("low")) / 2, 5).alias("half"))


@_query("a24_sequential_boxes", _boxes("orders", "o_totalprice", "o_custkey", 50) + _sequential("SELECT o_orderkey AS id, o_totalprice AS k1, o_custkey AS k2 FROM orders", "k1 BETWEEN lo1 AND hi1 AND k2 BETWEEN lo2 AND hi2", 200.0, 0.3, 1500))
def _(spark, d):
    q, rows = _order_boxes(spark, d)
    done = sampling.sequential_count(q, rows, "o_orderkey", 200.0, 0.3, most=1500)
    return done.select("qid", F.col("drawn").cast("long").alias("drawn"), F.round("estimate", 6).alias("estimate"), "stopped")


# ---- metrics

@_query("a39_accuracy", _ORDERS + f""", e AS ({_agg("count(o_orderkey) AS exact", "o_totalprice BETWEEN lo AND hi", "orders")}),
a AS ({_agg("count(o_orderkey) * 10 AS answer", f"o_totalprice BETWEEN lo AND hi AND {_UNIT.format(salt='s', id='o_orderkey')} < 0.1", "orders")})
SELECT count(*) AS queries, round(avg(abs(answer - exact)), 6) AS abs_error, round(avg(abs(answer - exact)::DOUBLE / exact) FILTER (WHERE exact <> 0), 9) AS rel_error FROM e JOIN a USING (qid)""")
def _(spark, d):
    o = _read(spark, d, "orders")
    q = ranges(cumulative(o, "o_totalprice"), 50)
    truth = exact.by_scan(q, clean(o, "o_totalprice")).select("qid", F.col("count").alias("exact"))
    rough = exact.by_scan(q, clean(sampling.bernoulli(o, "o_orderkey", 0.1), "o_totalprice")).select("qid", (F.col("count") * 10).alias("answer"))
    return answers.accuracy(rough, truth).select("queries", F.round("abs_error", 6).alias("abs_error"), F.round("rel_error", 9).alias("rel_error"))


@_query("a38_tree_size", f"WITH {_keys('lineitem', 'l_extendedprice')}, l0 AS (SELECT DISTINCT rank // 64 AS n FROM keys), l1 AS (SELECT DISTINCT n // 64 AS n FROM l0), l2 AS (SELECT DISTINCT n // 64 AS n FROM l1 WHERE (SELECT count(*) FROM l1) > 64), "
        "c AS (SELECT count(*) AS c FROM l0 UNION ALL SELECT count(*) FROM l1 WHERE (SELECT count(*) FROM l0) > 64 UNION ALL SELECT count(*) FROM l2) SELECT sum(c)::BIGINT AS nodes, (SELECT count(*) FROM l0) AS leaves, (sum(c) * 6)::BIGINT AS parameters FROM c")
def _(spark, d):
    return blocks.size(_tree(spark, d)[3])


@_query("a40_size", "SELECT 8 AS models, 24 AS parameters, 96 AS bytes FROM lineitem LIMIT 1")
def _(spark, d):
    t = keep(cumulative(_read(spark, d, "lineitem"), "l_quantity"), "cdf")
    return answers.size_of(segments.on_splits(t, histogram.entropy_splits(t, 8), 1), 1).select(*[F.col(c).cast("int").alias(c) for c in ("models", "parameters", "bytes")])


@_query("p05_horner", "SELECT l_orderkey, l_linenumber, round(1 + 2 * l_discount + 3 * l_discount * l_discount, 9) AS y FROM lineitem")
def _(spark, d):
    y = horner(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("l_discount"), 2)
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(y, 9).alias("y"))


# ---- scalar functions, streams, sources and sinks

@_query("x09_overlap_share", _PRICE + "SELECT qid, round(CASE WHEN hi > lo THEN greatest(0, least(hi, 60000) - greatest(lo, 20000)) / (hi - lo) WHEN lo <= 60000 AND hi >= 20000 THEN 1 ELSE 0 END, 9) AS share FROM q")
def _(spark, d):
    share = overlap_share(F.col("lo"), F.col("hi"), F.lit(20000.0), F.lit(60000.0))
    return ranges(_price(spark, d)).select("qid", F.round(share, 9).alias("share"))


@_query("x10_leaky_network", "SELECT o_orderkey, round(0.5 + 2 * (CASE WHEN x - 1 > 0 THEN x - 1 ELSE (x - 1) * 0.03 END) - 3 * (CASE WHEN 1 - x > 0 THEN 1 - x ELSE (1 - x) * 0.03 END), 6) AS y FROM (SELECT o_orderkey, o_totalprice / 100000 AS x FROM orders)")
def _(spark, d):
    x = F.col("o_totalprice") / 100000
    y = leaky_forward(x, [(1.0, -1.0), (-1.0, 1.0)], [2.0, -3.0], 0.5)
    return _read(spark, d, "orders").select("o_orderkey", F.round(y, 6).alias("y"))


@_query("p02_unsigned_keys", "SELECT c_custkey, floor(c_acctbal - (SELECT min(c_acctbal) FROM customer) + 1)::BIGINT AS k FROM customer")
def _(spark, d):
    c = _read(spark, d, "customer")
    least = c.agg(F.min("c_acctbal").alias("least"))
    return c.crossJoin(F.broadcast(least)).select("c_custkey", shift_unsigned(F.col("c_acctbal"), F.col("least")).alias("k"))


@_query("f07_certificates", _PRICE + ", c AS (" + _agg("count(l_orderkey) AS n", _OPEN) + ") SELECT qid, n > 200 AND 200.0 / (n - 200) <= 0.05 AS certified FROM c")
def _(spark, d):
    t = _price(spark, d)
    found = exact.by_cumulative(ranges(t), t)
    return found.select("qid", F.coalesce(certified(F.col("count").cast("double"), F.lit(200.0), 0.05), F.lit(False)).alias("certified"))


@_query("st01_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(spark, d):
    return streaming.windowed(_read(spark, d, "events"), "ts", "value", "1 day", "1 hour").select("start", "n", "least", "most")


@_query("k01_round_trip", "SELECT DISTINCT l_quantity AS key, dense_rank() OVER (ORDER BY l_quantity) - 1 AS rank FROM lineitem")
def _(spark, d):
    t = cumulative(_read(spark, d, "lineitem"), "l_quantity").select("key", F.col("rank").cast("long").alias("rank"))
    path = f"{shared_folder(spark)}/round-trip-{uuid.uuid4().hex}"
    sources.write(t, path, "csv")
    return spark.read.schema("key double, rank long").option("header", True).csv(path)


@_query("x07_normal_quantile", "SELECT o_orderkey, round(CASE WHEN p > 0.5 THEN z ELSE -z END, 9) AS z FROM (SELECT *, t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t) AS z FROM (SELECT o_orderkey, p, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM (SELECT o_orderkey, (o_orderkey % 999 + 0.5::DOUBLE) / 1000 AS p FROM orders)))")
def _(spark, d):
    p = (F.col("o_orderkey") % 999 + 0.5) / 1000
    return _read(spark, d, "orders").select("o_orderkey", F.round(normal_quantile_of(p), 9).alias("z"))


@_query("x08_rectangles", """
SELECT o_orderpriority AS grp, min(o_custkey) AS lo1, max(o_custkey) AS hi1, min(o_totalprice) AS lo2, max(o_totalprice) AS hi2, round((max(o_custkey) - min(o_custkey)) * (max(o_totalprice) - min(o_totalprice)), 3) AS area,
       round(pi() * (power(max(o_custkey) - min(o_custkey), 2) + power(max(o_totalprice) - min(o_totalprice), 2)) / 4, 1) AS round, round((greatest(max(o_custkey), 500) - least(min(o_custkey), 100)) * (greatest(max(o_totalprice), 9000) - least(min(o_totalprice), 0)), 3) AS joined
FROM orders GROUP BY 1""")
def _(spark, d):
    rect = [F.col(c) for c in ("lo1", "hi1", "lo2", "hi2")]
    o = _read(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), *[F.col(k).cast("double").alias(c) for c, k in (("lo1", "o_custkey"), ("hi1", "o_custkey"), ("lo2", "o_totalprice"), ("hi2", "o_totalprice"))])
    other = tuple(F.lit(float(x)) for x in (100, 500, 0, 9000))
    found = o.groupBy("grp").agg(*cover("lo1", "hi1", "lo2", "hi2"))
    return found.select("grp", *[F.col(c).cast("long").alias(c) for c in ("lo1", "hi1")], "lo2", "hi2", F.round(area(*rect), 3).alias("area"), F.round(round_area(*rect), 1).alias("round"), F.round(area(*united(tuple(rect), other)), 3).alias("joined"))


@_query("s01_readers", """
SELECT role, rows, round(total, 2) AS total FROM (
  SELECT 'keys' AS role, count(*) AS rows, sum(l_extendedprice)::DOUBLE AS total FROM lineitem UNION ALL SELECT 'measures', count(*), sum(l_quantity)::DOUBLE FROM lineitem
  UNION ALL SELECT 'points', count(*), sum(l_extendedprice + l_quantity)::DOUBLE FROM lineitem UNION ALL SELECT 'ranges', count(*), sum(l_tax)::DOUBLE FROM lineitem
  UNION ALL SELECT 'boxes', count(*), sum(4 * l_quantity)::DOUBLE FROM lineitem UNION ALL SELECT 'surface', count(*), sum(l_quantity)::DOUBLE FROM lineitem
  UNION ALL SELECT 'ranges_by_selectivity', count(*), sum(l_discount)::DOUBLE FROM lineitem UNION ALL SELECT 'truth', count(*), sum(l_quantity)::DOUBLE FROM lineitem UNION ALL SELECT 'buckets', count(*), sum(l_quantity)::DOUBLE FROM lineitem)""")
def _(spark, d):
    """Each input role, written as delimited text without a header and read by its typed reader."""
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.col("l_tax").alias("t"), F.col("l_discount").alias("s"))
    roles = {
        "keys": (["p", "q"], "key"), "measures": (["p", "id", "q"], "value"), "points": (["p", "q"], "k1 + k2"), "ranges": (["id", "t", "p"], "lo"), "boxes": (["id", "q", "q", "q", "q"], "lo1 + lo2 + hi1 + hi2"),
        "surface": (["p", "p", "q"], "f"), "ranges_by_selectivity": (["id", "s", "p", "p"], "selectivity"), "truth": (["id", "q"], "exact"), "buckets": (["p", "cast(q AS int)"], "bucket"),
    }
    base, out = f"{shared_folder(spark)}/roles-{uuid.uuid4().hex}", None
    for role, (columns, total) in roles.items():
        rows.selectExpr(*[f"{c} AS c{i}" for i, c in enumerate(columns)]).write.csv(f"{base}/{role}")
        one = sources.read(spark, f"{base}/{role}", role, "csv").agg(F.lit(role).alias("role"), F.count("*").alias("rows"), F.round(F.sum(F.expr(total)), 2).alias("total"))
        out = one if out is None else out.union(one)
    return out


@_query("k01_metrics", "SELECT tag, queries, abs_error FROM (VALUES ('a', 200::BIGINT, 1.5::DOUBLE), ('b', 100::BIGINT, 0.25::DOUBLE)) v(tag, queries, abs_error)")
def _(spark, d):
    """Two runs' metrics, appended one after the other."""
    path = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    for row in (("a", 200, 1.5, 0.1, 3, 2, 7, 21, 84), ("b", 100, 0.25, 0.1, 3, 2, 7, 21, 84)):
        sources.append_metrics(spark.createDataFrame([row], sources.SCHEMAS["metrics"]), path)
    return sources.read(spark, path, "metrics", "csv", header=True).select("tag", "queries", "abs_error")


@_query("k04_tree_file", f"WITH {_keys('lineitem', 'l_extendedprice')} SELECT count(DISTINCT rank // 64) AS blocks, (SELECT count(*) FROM lineitem) AS rows FROM keys")
def _(spark, d):
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    blocks.save(_tree(spark, d)[3], path)
    return blocks.load(spark, path).where("level = 0").agg(F.count("*").alias("blocks"), F.sum("cnt").cast("long").alias("rows"))


@_query("k05_segment_file", "SELECT count(DISTINCT l_extendedprice) AS keys, TRUE AS within FROM lineitem")
def _(spark, d):
    """Segments as delimited text, arrays flattened; read back they still answer for every key."""
    t = _price(spark, d)
    path = f"{shared_folder(spark)}/segments-{uuid.uuid4().hex}"
    sources.write(segments.build(t, "pla", T_ABS), path, "csv")
    kinds = "key double, key_hi double, idx_lo long, idx_hi long, coef string, centre double, scale double, loss double, seg_max double, n long"
    back = keep(spark.read.schema(kinds).option("header", True).csv(path).withColumn("coef", F.split("coef", " ").cast("array<double>")), "segments")
    off = segments.refit_errors(back, t, 1).agg((F.max("max_error") <= T_ABS + 1e-6).alias("within"))
    return back.agg(F.sum("n").alias("keys")).crossJoin(off)
