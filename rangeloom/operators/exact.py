"""Exact answers for batches of ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import keep, small
from .keyspace import COARSE, FINE, asof, bucket_of, clean, coded, cuts

#: Cells along each axis of the grid that boxes are looked up in.
CELLS = 64


def by_cumulative(queries: DataFrame, table: DataFrame, closed: bool = False) -> DataFrame:
    """(qid, count, sum) over (lo, hi], or [lo, hi] if closed, by two as-of lookups a query."""
    table = table.select("key", "f", "s")
    low = queries.select("qid", F.col("lo").alias("at"), F.lit(-1).alias("sign"))
    high = queries.select("qid", F.col("hi").alias("at"), F.lit(1).alias("sign"))
    if closed:
        found = asof(high, table).union(asof(low, table, inclusive=False))
    else:
        found = asof(high.union(low), table)
    part = lambda c: F.sum(F.col("sign") * F.coalesce(F.col(f"hit.{c}"), F.lit(0)))
    return found.groupBy("qid").agg(part("f").alias("count"), part("s").alias("sum"))


def _parts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c"), F.sum("value").alias("s"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


def _merged(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def by_scan(queries: DataFrame, rows: DataFrame, closed: bool = True, open_end: bool = False) -> DataFrame:
    """(qid, count, sum, min, max, avg) of value over rows (key, value), in [lo, hi], (lo, hi] or without either end.

    Whole coarse buckets of a range are answered from one summary row each, whole parts of its first and last
    bucket as well; only the rows of the two parts at its ends are joined, on the part's number.  A range
    without rows has count 0 and null elsewhere."""
    code = coded(rows, "key")
    rows = rows.withColumn("part", code("key"))
    asked = queries.where("lo <= hi").select("qid", "lo", "hi", code("lo").alias("a"), code("hi").alias("b"))
    fine = keep(_parts(rows, ["part"]), "parts")  # COARSE * FINE rows at most
    coarse = _merged(fine.withColumn("bucket", F.floor(F.col("part") / FINE)), ["bucket"])
    between = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    first, last = F.floor(F.col("a") / FINE), F.floor(F.col("b") / FINE)
    whole = asked.select("qid", F.explode(between(first + 1, last - 1)).alias("bucket")).join(F.broadcast(coarse), "bucket").drop("bucket")
    head = between(F.col("a").cast("long") + 1, F.least(F.col("b").cast("long") - 1, (first + 1) * FINE - 1))
    tail = between(F.greatest(last * FINE, F.col("a").cast("long") + 1), F.col("b").cast("long") - 1)
    rest = F.when(first == last, head).otherwise(F.concat(head, tail))
    near = asked.select("qid", F.explode(rest).alias("p")).join(F.broadcast(fine), F.col("p") == F.col("part")).drop("p", "part")
    edges = asked.select("qid", "lo", "hi", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    inside = (F.col("key") >= F.col("lo")) if closed else (F.col("key") > F.col("lo"))
    inside = inside & (F.col("key") < F.col("hi") if open_end else F.col("key") <= F.col("hi"))
    outer = _parts(rows.join(small(edges), "part").where(inside), ["qid"])
    total = _merged(whole.unionByName(near).unionByName(outer), ["qid"])
    return queries.select("qid").join(total, "qid", "left").select(
        "qid", F.coalesce("c", F.lit(0)).alias("count"), F.col("s").alias("sum"), F.col("lowest").alias("min"), F.col("highest").alias("max"), (F.col("s") / F.col("c")).alias("avg")
    )


def range_scan(df: DataFrame, queries: DataFrame, key: str, value: str | None = None, closed: bool = True) -> DataFrame:
    return by_scan(queries, clean(df, key, value), closed)


def box_count(queries: DataFrame, points: DataFrame, cells: int = CELLS, closed: bool = True, group: str | None = None) -> DataFrame:
    """(qid, count, max) over boxes of points (k1, k2, value), closed or without their lower borders; with `group`
    (qid, group, count, max) for each group that has points in a box.  Cells of a grid of approximate quantiles
    that a box covers are answered from one summary row each, only points in the cells of its border are joined."""
    bounds = {k: cuts(points, k, cells) for k in ("k1", "k2")}
    cell = lambda c, k: bucket_of(c, bounds[k])
    by = [group] if group else []
    points = points.withColumn("x", cell("k1", "k1")).withColumn("y", cell("k2", "k2"))
    grid = points.groupBy("x", "y", *by).agg(F.count("*").alias("c"), F.max("value").alias("m"))  # cells * cells rows at most, for each group
    asked = queries.where("lo1 <= hi1 AND lo2 <= hi2").select("qid", "lo1", "hi1", "lo2", "hi2", cell("lo1", "k1").alias("x0"), cell("hi1", "k1").alias("x1"), cell("lo2", "k2").alias("y0"), cell("hi2", "k2").alias("y1"))
    met = asked.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    covered = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    whole = met.where(covered).select("qid", "x", "y").join(grid if group else F.broadcast(grid), ["x", "y"]).select("qid", *by, "c", "m")
    edge = met.where(~covered).select("qid", "lo1", "hi1", "lo2", "hi2", "x", "y")
    above = lambda k, lo: F.col(k) >= F.col(lo) if closed else F.col(k) > F.col(lo)
    hit = points.join(small(edge), ["x", "y"]).where(above("k1", "lo1") & above("k2", "lo2") & (F.col("k1") <= F.col("hi1")) & (F.col("k2") <= F.col("hi2")))
    border = hit.groupBy("qid", *by).agg(F.count("*").alias("c"), F.max("value").alias("m"))
    found = whole.union(border).groupBy("qid", *by).agg(F.sum("c").alias("c"), F.max("m").alias("m"))
    if group:
        return found.select("qid", group, F.col("c").alias("count"), F.col("m").alias("max"))
    return queries.select("qid").join(found, "qid", "left").select("qid", F.coalesce("c", F.lit(0)).alias("count"), F.col("m").alias("max"))


def ranges_per_group(df: DataFrame, queries: DataFrame, key: str, value: str | None, group: str) -> DataFrame:
    """(qid, grp, count, sum): every range for every group that has rows in it.  As by_scan(): whole parts of a range
    are answered from one summary row for each part and group, rows are joined at its two ends alone."""
    name = F.col(group).alias("grp")
    keyed = df.select(F.col(key).cast("double").alias("key"), (F.col(value) if value else F.lit(1.0)).cast("double").alias("value"), name)
    keyed = keyed.where(F.col("key").isNotNull() & ~F.isnan("key"))
    code = coded(keyed, "key", COARSE, 1)
    keyed = keyed.withColumn("part", code("key"))
    asked = queries.where("lo <= hi").select("qid", "lo", "hi", code("lo").alias("a"), code("hi").alias("b"))
    whole = asked.where("b - a > 1").select("qid", F.explode(F.sequence(F.col("a") + 1, F.col("b") - 1)).alias("part"))
    whole = whole.join(keyed.groupBy("part", "grp").agg(F.count("*").alias("c"), F.sum("value").alias("s")), "part").drop("part")
    edges = asked.select("qid", "lo", "hi", F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    outer = keyed.join(small(edges), "part").where(F.col("key").between(F.col("lo"), F.col("hi"))).groupBy("qid", "grp").agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    return whole.unionByName(outer).groupBy("qid", "grp").agg(F.sum("c").alias("count"), F.sum("s").alias("sum"))
