"""Deterministic query sets: bounds at fixed ranks of the distinct keys, never random."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SELECTIVITIES = (0.0001, 0.001, 0.01, 0.1)
STEP, OTHER = 7919, 104729


def _at_ranks(table: DataFrame, wanted: DataFrame) -> DataFrame:
    keys = table.select(F.col("rank").alias("r"), F.col("key"))
    low = keys.select(F.col("r").alias("a"), F.col("key").alias("lo"))
    high = keys.select(F.col("r").alias("b"), F.col("key").alias("hi"))
    # the query set is the small side, its size is a parameter
    return low.join(F.broadcast(wanted), "a").join(high, "b").drop("a", "b")


def ranges(table: DataFrame, queries: int = 200) -> DataFrame:
    """(qid, lo, hi) from a cumulative table (key, rank)."""
    n = table.count()
    ids = table.sparkSession.range(queries if n else 0)
    a, b = (F.col("id") * STEP) % max(n, 1), (F.col("id") * OTHER + 13) % max(n, 1)
    return _at_ranks(table, ids.select(F.col("id").alias("qid"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))).select("qid", "lo", "hi")


def ranges_by_selectivity(table: DataFrame, queries: int = 50, selectivities: tuple[float, ...] = SELECTIVITIES) -> DataFrame:
    """(qid, selectivity, lo, hi): ranges over a fixed share of the distinct keys."""
    n = table.count()
    ids = table.sparkSession.range(queries if n else 0)
    each = ids.select("id", F.posexplode(F.array(*[F.lit(s) for s in selectivities])).alias("at", "selectivity"))
    width = F.floor(F.col("selectivity") * n)
    a = (F.col("id") * STEP) % F.greatest(F.lit(1), n - width)
    wanted = each.select((F.col("at") * queries + F.col("id")).alias("qid"), "selectivity", a.alias("a"), F.least(a + width, F.lit(n - 1)).alias("b"))
    return _at_ranks(table, wanted).select("qid", "selectivity", "lo", "hi")


def boxes(first: DataFrame, second: DataFrame, queries: int = 100) -> DataFrame:
    """(qid, lo1, hi1, lo2, hi2) from the cumulative tables of two keys."""
    one = ranges(first, queries).select("qid", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    n = second.count()
    ids = second.sparkSession.range(queries if n else 0)
    a, b = (F.col("id") * 31 + 5) % max(n, 1), (F.col("id") * 17 + 1) % max(n, 1)
    two = _at_ranks(second, ids.select(F.col("id").alias("qid"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return one.join(two.select("qid", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "qid")


def boxes_by_selectivity(first: DataFrame, second: DataFrame, queries: int = 50, selectivities: tuple[float, ...] = SELECTIVITIES) -> DataFrame:
    """(qid, selectivity, lo1, hi1, lo2, hi2): boxes over a fixed share of the distinct keys of both axes together,
    the root of it on each."""
    sides = tuple(s**0.5 for s in selectivities)
    one = ranges_by_selectivity(first, queries, sides).select("qid", (F.col("selectivity") * F.col("selectivity")).alias("selectivity"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    two = ranges_by_selectivity(second, queries, sides).select("qid", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    return one.join(two, "qid")
