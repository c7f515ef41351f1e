"""Entropy histograms over distinct keys.

A key's area is its number of rows times the way to the next key.  Buckets are split where the
entropy that is left, weighted by area, is least.  Prefix sums of a and a log2 a give the
entropy of any stretch in closed form, so each round is one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entropy_terms
from ..tables import keep
from .keyspace import spread


def frequencies(table: DataFrame) -> DataFrame:
    """(key, rank, n, spread, area, bucket) of a cumulative table."""
    return spread(table).select("key", "rank", "n", "spread", (F.col("n") * F.col("spread")).alias("area"), "bucket")


def entropy(values: DataFrame, weight: str = "area") -> DataFrame:
    a, b = entropy_terms(F.col(weight))
    return values.agg((F.log2(F.sum(a)) - F.sum(b) / F.sum(a)).alias("entropy"))


def entropy_splits(table: DataFrame, buckets: int) -> DataFrame:
    """(rank): the first rank of each bucket but the first, of a histogram of `buckets` buckets."""
    from pyspark.sql import Window as W

    base = frequencies(table)
    a, b = entropy_terms(F.col("area"))
    order = W.partitionBy("bucket").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    heads = base.groupBy("bucket").agg(F.sum(a).alias("sa"), F.sum(b).alias("sb"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select("bucket", F.coalesce(F.sum("sa").over(before), F.lit(0.0)).alias("a0"), F.coalesce(F.sum("sb").over(before), F.lit(0.0)).alias("b0"))
    sums = base.join(F.broadcast(heads), "bucket").select("rank", (F.col("a0") + F.sum(a).over(order)).alias("a"), (F.col("b0") + F.sum(b).over(order)).alias("b"))
    sums = keep(sums, "prefix")
    spark = table.sparkSession
    last = sums.agg(F.max_by(F.struct("rank", "a", "b"), "rank")).first()[0]
    if last is None:
        return spark.range(0).select(F.col("id").alias("rank"))
    # the driver holds the bucket ends alone: at most `buckets` of them
    ends = [(-1, 0.0, 0.0), (last["rank"], last["a"], last["b"])]
    h = lambda da, db: F.when(da > 0, da * F.log2(da) - db).otherwise(0.0)
    while len(ends) - 1 < buckets:
        rows = [(*x, *y) for x, y in zip(ends, ends[1:])]
        open_ = spark.createDataFrame(rows, "r0 long, a0 double, b0 double, r1 long, a1 double, b1 double")
        cut = sums.join(F.broadcast(open_), (F.col("rank") > F.col("r0")) & (F.col("rank") < F.col("r1")))
        left = h(F.col("a") - F.col("a0"), F.col("b") - F.col("b0")) + h(F.col("a1") - F.col("a"), F.col("b1") - F.col("b"))
        gain = h(F.col("a1") - F.col("a0"), F.col("b1") - F.col("b0")) - left
        best = cut.agg(F.min(F.struct(F.round(-gain, 6).alias("g"), "rank", "a", "b"))).first()[0]
        if best is None:
            break
        ends = sorted([*ends, (best["rank"], best["a"], best["b"])])
    return spark.createDataFrame([(e[0] + 1,) for e in ends[1:-1]], "rank long")


def equal_width(table: DataFrame, width: float) -> DataFrame:
    """(bin, rows, keys): rows and distinct keys by bins of fixed width."""
    return table.groupBy(F.floor(F.col("key") / width).alias("bin")).agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))


