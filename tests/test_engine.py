"""Small fixtures for the engine's edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import columns
from rangeloom.operators import blocks, exact, histogram, keyspace, segments, staged, surface
from rangeloom.operators.keyspace import asof, clean, cumulative, spread
from rangeloom.operators.workload import ranges
from rangeloom.plans import answers
from rangeloom.tables import keep

ROWS = [(None, 1.0), (float("nan"), 2.0), *[(float(random.Random(7 + i).randint(-50, 400)), float(i % 13) - 6) for i in range(900)]]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k double, v double")


@pytest.fixture(scope="module")
def table(rows):
    return keep(cumulative(rows, "k", "v"), "cdf")


QUERIES = [(0, -1000.0, 1000.0), (1, -1000.0, -900.0), (2, 10.0, 10.0), (3, 20.5, 77.25), (4, 300.0, 100.0), (5, 399.0, 5000.0), (6, -50.0, 400.0), (7, 900.0, 1000.0)]


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "qid long, lo double, hi double")


def inside(lo, hi, closed):
    return [v for k, v in ROWS if k is not None and not math.isnan(k) and (lo <= k if closed else lo < k) and k <= hi]


def test_cumulative_is_exact(table):
    n = 0
    for r in sorted(table.collect(), key=lambda r: r.key):
        n += r.n
        assert r.f == n
    assert n == 900


def test_empty_table(spark, queries):
    empty = keep(cumulative(spark.createDataFrame([], "k double, v double"), "k", "v"), "cdf")
    assert empty.count() == 0 and ranges(empty).count() == 0
    assert {r["count"] for r in exact.by_cumulative(queries, empty).collect()} == {0}
    assert segments.build(empty).count() == 0


@pytest.mark.parametrize("closed", [False, True])
def test_exact_ways_agree(rows, table, queries, closed):
    one = {r.qid: r["count"] for r in exact.by_cumulative(queries.where("lo <= hi"), table, closed).collect()}
    two = {r.qid: r for r in exact.range_scan(rows, queries, "k", "v", closed).collect()}
    for q, lo, hi in QUERIES:
        want = inside(lo, hi, closed)
        assert two[q]["count"] == len(want)
        assert two[q]["max"] == (max(want) if want else None)
        assert two[q]["min"] == (min(want) if want else None)
        if lo <= hi:
            assert one[q] == len(want)


@pytest.mark.parametrize("few", [0, 10_000])  # merged with the table, or sent to it
def test_asof_has_one_match_at_most(spark, table, monkeypatch, few):
    monkeypatch.setattr(keyspace, "FEW_PROBES", few)
    probes = spark.createDataFrame([(i, float(i * 7 - 100)) for i in range(90)] + [(999, None), (998, float("nan"))], "id long, at double")
    keys = sorted(r.key for r in table.collect())
    for inclusive in (True, False):
        for forward in (True, False):
            found = {r.id: r.hit.key if r.hit else None for r in asof(probes, table, inclusive=inclusive, forward=forward).collect()}
            assert len(found) == 92 and found.pop(999) is None and found.pop(998) == (None if forward else keys[-1])
            for i, hit in found.items():
                at = i * 7 - 100
                ok = [k for k in keys if ((k >= at if inclusive else k > at) if forward else (k <= at if inclusive else k < at))]
                assert hit == ((min(ok) if forward else max(ok)) if ok else None)


@pytest.mark.parametrize("forward", [False, True])
def test_no_lookup_goes_through_the_rest_of_a_bucket_for_every_row(spark, table, monkeypatch, forward):
    monkeypatch.setattr(keyspace, "FEW_PROBES", 0)
    plan = asof(spark.range(50).selectExpr("id", "id * 1.0D AS at"), table, forward=forward)._jdf.queryExecution().toString()
    assert "unboundedpreceding$()" in plan and "unboundedfollowing$()" not in plan


@pytest.mark.parametrize("forward", [False, True])
def test_no_bucket_of_a_lookup_holds_most_probes(spark, monkeypatch, forward):
    monkeypatch.setattr(keyspace, "FEW_PROBES", 1000)
    sizes, merged = [], keyspace._merged

    def watched(probes, table, at, key, inclusive, forward, bounds):
        sizes.extend(r["count"] for r in probes.groupBy(keyspace.bucket_of(at, bounds).alias("b")).count().collect())
        return merged(probes, table, at, key, inclusive, forward, bounds)

    monkeypatch.setattr(keyspace, "_merged", watched)
    keys = spark.range(0, 2000, 2).selectExpr("double(id) AS key", "id AS rank")
    # most probes are beyond all keys, many of the others are alike, null or NaN
    at = "CASE WHEN id < 12000 THEN 5000D + id WHEN id < 15000 THEN 777D WHEN id < 17000 THEN NULL WHEN id < 17500 THEN double('NaN') WHEN id < 18000 THEN -3D - id ELSE id - 18000D END"
    probes = spark.range(20_000).selectExpr("id", f"{at} AS at")
    got = {r.id: r.hit.key if r.hit else None for r in asof(probes, keys, forward=forward).collect()}
    assert len(got) == 20_000 and max(sizes) <= 20_000 // 8
    for r in probes.collect():
        if r.at is None or (forward and not r.at <= 1998) or (not forward and r.at < 0):
            assert got[r.id] is None
        elif forward:
            assert got[r.id] == max(0.0, 2.0 * math.ceil(r.at / 2))
        else:
            assert got[r.id] == (2.0 * math.floor(r.at / 2) if r.at <= 1998 else 1998.0)


@pytest.mark.parametrize("method,degree", [("poly", 2), ("cone", 1), ("spline", 1), ("sliding", 1), ("bottom_up", 1)])
def test_answers_keep_their_bound_everywhere(table, queries, method, degree):
    segs = keep(segments.build(table, method, 15.0, degree, block=64), "segments")
    q = answers.clamp_to_domain(queries.where("lo <= hi"), table)
    got = {r.qid: r for r in answers.cumulative_answers(q, segs, degree).collect()}
    for k, lo, hi in QUERIES:
        if lo <= hi:
            assert abs(got[k].approx - len(inside(lo, hi, False))) <= got[k].bound + 1e-6
            assert method == "bottom_up" or got[k].bound <= 30 + 1e-6


def test_refined_answers_are_exact(table, queries):
    segs = keep(segments.build(table, "poly", 15.0, 1, block=64), "segments")
    for r in answers.count_with_refinement(queries.where("lo <= hi"), segs, table, 1, 0.05).collect():
        want = len(inside(*QUERIES[r.qid][1:], False))
        assert abs(r.answer - want) <= 0.05 * want + 1e-6 if r.certified else r.answer == want


@pytest.mark.parametrize("degree", [1, 2, 3])
def test_max_of_negative_measures(rows, table, queries, degree):
    pairs = clean(rows, "k", "v")
    per_key = blocks.keyed(pairs, table)
    segs = keep(segments.build_max(per_key.select("key", "rank", F.col("most").alias("v")), 2.0, degree, 64), "segments")
    got = {r.qid: r for r in answers.max_with_refinement(queries, segs, pairs, degree, 0.01).collect()}
    for k, lo, hi in QUERIES:
        want = inside(lo, hi, True)
        assert (got[k].answer is None) == (not want)
        if want:
            assert abs(got[k].answer - max(want)) <= 0.01 * abs(max(want)) + 1e-6


def test_tree_and_progressive(rows, table, queries):
    per_key = keep(blocks.keyed(clean(rows, "k", "v"), table), "keys")
    tree = keep(blocks.summary(per_key), "tree")
    got = {r.qid: r for r in blocks.range_aggregate(queries, tree, per_key).collect()}
    steps = {r.qid: r for r in blocks.progressive(queries, tree, per_key, 0.1).collect()}
    for k, lo, hi in QUERIES:
        want = inside(lo, hi, True)
        assert got[k]["count"] == len(want) and got[k]["max"] == (max(want) if want else None)
        assert steps[k].low <= len(want) <= steps[k].high


def test_rows_can_be_added_and_removed(rows):
    more = blocks.append(rows, rows.limit(1))
    assert more.count() == rows.count() + 1
    assert blocks.remove(rows.where("k = 10"), rows.where("k = 10")).count() == 0


def test_staged_and_histogram(table):
    models = keep(staged.train(table, (1, 4)), "staged")
    assert models.where("stage = 1").agg(F.sum("n")).first()[0] == table.count()
    assert staged.bucket_map(table, models, (1, 4)).count() == table.count()
    splits = histogram.entropy_splits(table, 4)
    assert splits.count() == 3
    assert segments.on_splits(table, splits, 2).agg(F.sum("n")).first()[0] == table.count()
    last = max(spread(table).collect(), key=lambda r: r.key)
    assert last.spread == 1.0


def test_surface_covers_the_upper_border(spark):
    pts = surface.points(spark.createDataFrame([(x / 7, y / 3) for x in range(8) for y in range(4)], "a double, b double"), "a", "b")
    lattice = keep(surface.surface(pts, 8), "lattice")
    assert lattice.where("i = 8 and j = 8").first().f == 32
    models = surface.quadrants(lattice, 1.0, 1, 8)
    assert surface.located(lattice, models, 8).count() == 81


def test_certificates(spark):
    df = spark.createDataFrame([(100.0, 0.5), (100.0, 60.0), (0.0, 1.0), (1.0, 1.0)], "a double, e double")
    got = [r.c for r in df.select(columns.certified(F.col("a"), F.col("e"), 0.01).alias("c")).collect()]
    assert [bool(x) for x in got] == [True, False, False, False]


def test_region_max_matches_a_grid(spark):
    for coef in ([1.0, 2.0, -3.0, 0.0], [0.0, 1.0, 0.5, -2.0], [1.0, 0.0, 0.0, 0.0], [0.0, -1.0, 2.0, 1.0]):
        df = spark.createDataFrame([(coef, -1.0, 1.5)], "c array<double>, lo double, hi double")
        got = df.select(columns.region_max(F.col("c"), F.col("lo"), F.col("hi"), 3).alias("m")).first().m
        xs = [-1 + 2.5 * i / 5000 for i in range(5001)]
        assert got == pytest.approx(max(sum(c * x**p for p, c in enumerate(coef)) for x in xs), abs=1e-5)


def test_overlap_of_points_and_intervals(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0, 20.0), (3.0, 3.0, 0.0, 5.0), (3.0, 3.0, 4.0, 5.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(columns.overlap_share(*map(F.col, "abcd"))).collect()]
    assert got == [0.5, 1.0, 0.0]


def test_normal_quantile():
    assert columns.normal_quantile(0.975) == pytest.approx(1.96, abs=1e-3)
    assert columns.normal_quantile(0.1) == pytest.approx(-1.2816, abs=1e-3)


def test_equi_lookup_probes_every_key(spark, tmp_path):
    from rangeloom.queries import QUERIES

    spark.createDataFrame([(float(i % 40), 1.0) for i in range(100)], "l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(tuple(r) for r in QUERIES["j02_equi_lookup"](spark, str(tmp_path)).select("key", "rank", "n").collect())
    assert got == [(float(i), i, 3 if i < 20 else 2) for i in range(40)]


def test_boxes_agree_with_brute_force(spark):
    rng = random.Random(9)
    pts = [(float(rng.randrange(40)), float(rng.randrange(60)), float(rng.randrange(-5, 5))) for _ in range(700)] + [(5.0, 5.0, 1.0)] * 300
    asked = [(i, *sorted((float(rng.randrange(-5, 45)), float(rng.randrange(-5, 45)))), *sorted((float(rng.randrange(-5, 65)), float(rng.randrange(-5, 65))))) for i in range(40)] + [(90, 5.0, 5.0, 5.0, 5.0), (91, 9.0, 3.0, 0.0, 50.0), (92, -9.0, 99.0, -9.0, 99.0)]
    points = spark.createDataFrame(pts, "k1 double, k2 double, value double")
    queries = spark.createDataFrame(asked, "qid long, lo1 double, hi1 double, lo2 double, hi2 double")
    inside = {q: [v for a, b, v in pts if l1 <= a <= h1 and l2 <= b <= h2] for q, l1, h1, l2, h2 in asked}
    want = {q: (len(v), max(v, default=None)) for q, v in inside.items()}
    assert {r.qid: (r["count"], r["max"]) for r in exact.box_count(queries, points, 8).collect()} == want
    half_open = {q: sum(l1 < a <= h1 and l2 < b <= h2 for a, b, _ in pts) for q, l1, h1, l2, h2 in asked}
    assert {r.qid: r["count"] for r in exact.box_count(queries, points, 8, closed=False).collect()} == half_open
    held = keep(blocks.box_leaves(points, 8), "leaves")
    tree = keep(blocks.box_summary(held, 8), "tree")
    assert {r.qid: (r["count"], r["max"]) for r in blocks.box_aggregate(queries, tree, held).collect()} == want
    levels = set()
    for r in blocks.box_progressive(queries, tree, held, 0.3).collect():
        levels.add(r.level)
        assert r.low <= want[r.qid][0] <= r.high and r.low <= r.estimate <= r.high and (r.high <= 1.3 * r.low or r.low == r.high)
    assert len(levels) > 1
    box = surface.domain(points)
    models = keep(surface.quadrants(surface.surface(points, 16, box), 5.0, 2, 16), "models")
    rough = surface.raw_box_answers(queries, models, 2, 16, box)
    for r in surface.boxes_with_refinement(queries, rough, points, 0.2).collect():
        assert abs(r.approx - half_open[r.qid]) <= r.bound + 1e-6
        assert abs(r.answer - half_open[r.qid]) <= (0.2 * half_open[r.qid] + 1e-6 if r.certified else 0)


def test_removed_rows_go_once_each_and_nulls_match(spark):
    rows = spark.createDataFrame([(1.0, None), (1.0, None), (2.0, 3.0), (2.0, 3.0), (4.0, 5.0)], "k double, v double")
    gone = spark.createDataFrame([(None, 1.0), (3.0, 2.0), (9.0, 9.0)], "v double, k double")
    assert sorted((r.k, r.v or 0) for r in blocks.remove(rows, gone).collect()) == [(1.0, 0), (2.0, 3.0), (4.0, 5.0)]


def test_trees_are_checked_when_they_are_read(spark, table, rows, tmp_path):
    tree = blocks.summary(blocks.keyed(clean(rows, "k", "v"), table), fanout=8)
    blocks.save(tree, f"{tmp_path}/tree")
    assert blocks.load(spark, f"{tmp_path}/tree").count() == tree.count() == blocks.size(tree).first().nodes
    spark.range(3).write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        blocks.load(spark, f"{tmp_path}/other")


def test_maxima_of_any_degree(spark):
    import numpy as np

    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3, 3) for _ in range(d + 1)], -1.0, rng.uniform(-0.5, 1), d) for d in (1, 2, 3, 4, 5) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, coef array<double>, lo double, hi double, d int")
    for d in (1, 2, 3, 4, 5):
        got = {r.id: r.m for r in df.where(F.col("d") == d).select("id", columns.region_max(F.col("coef"), F.col("lo"), F.col("hi"), d).alias("m")).collect()}
        for i, c, lo, hi, k in rows:
            if k == d:
                assert got[i] == pytest.approx(np.polynomial.polynomial.polyval(np.linspace(lo, hi, 20_001), c).max(), abs=1e-4)
