"""Counts from reproducible samples: membership is a hash of the row's id, never rand()."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import small
from .exact import box_count, ranges_per_group


def unit_hash(row_id: Column, salt: str = "") -> Column:
    """A number in [0, 1) from 13 hex digits of md5: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), row_id.cast("string"))), 1, 13), 16, 10).cast("double") / 2.0**52


def bernoulli(rows: DataFrame, row_id: str, share: float, salt: str = "s") -> DataFrame:
    return rows.where(unit_hash(F.col(row_id), salt) < share)


def subsampled_count(queries: DataFrame, rows: DataFrame, row_id: str, share: float, subsamples: int = 100, confidence: float = 0.9) -> DataFrame:
    """(qid, estimate, low, high) of COUNT by variational subsampling, over closed ranges of rows (key) or closed
    boxes of points (k1, k2): each sampled row falls into one subsample; subsample counts are scaled up, their
    trimmed mean is the estimate and their spread, shrunk by the subsample's share of the sample, the interval."""
    sample = bernoulli(rows, row_id, share).withColumn("sid", F.floor(unit_hash(F.col(row_id), "sid") * subsamples).cast("int"))
    if "k1" in rows.columns:
        hit = box_count(queries, sample.withColumn("value", F.lit(1.0)), group="sid").select("qid", "sid", F.col("count").alias("c"))
    else:
        hit = ranges_per_group(sample, queries, "key", None, "sid").select("qid", F.col("grp").alias("sid"), F.col("count").alias("c"))
    every = queries.select("qid", F.explode(F.sequence(F.lit(0), F.lit(subsamples - 1))).alias("sid"))
    scaled = every.join(hit, ["qid", "sid"], "left").select("qid", (F.coalesce("c", F.lit(0)) * (subsamples / share)).alias("c"))
    tail = (1 - confidence) / 2
    # one query's subsamples: `subsamples` numbers
    order = W.partitionBy("qid").orderBy("c")
    ranked = scaled.withColumn("r", F.row_number().over(order) - 1)
    trim = int(round(subsamples * tail, 9))
    kept = (F.col("r") >= trim) & (F.col("r") < subsamples - trim)
    z = NormalDist().inv_cdf(1 - tail)
    spread = z * F.stddev_samp("c") / F.sqrt(F.lit(float(subsamples)))
    return ranked.groupBy("qid").agg(F.avg(F.when(kept, F.col("c"))).alias("estimate"), spread.alias("e")).select(
        "qid", "estimate", (F.col("estimate") - F.col("e")).alias("low"), (F.col("estimate") + F.col("e")).alias("high")
    )


def sequential_count(queries: DataFrame, rows: DataFrame, row_id: str, absolute: float, relative: float, confidence: float = 0.9, first: int = 30, most: int = 20_000, inside: Column | None = None) -> DataFrame:
    """(qid, drawn, estimate, stopped) of COUNT by sequential sampling: rows are drawn in the order of a hash until
    relative * max(hits, n * absolute / N) >= z * sqrt(n * variance); `most` draws end it, and `stopped` says
    whether the rule was met.  The draws of all queries are the same `most` rows."""
    if inside is None and "k1" in rows.columns:
        inside = F.col("k1").between(F.col("lo1"), F.col("hi1")) & F.col("k2").between(F.col("lo2"), F.col("hi2"))
    inside = inside if inside is not None else F.col("key").between(F.col("lo"), F.col("hi"))
    total = rows.count()
    drawn = rows.withColumn("u", unit_hash(F.col(row_id), "seq")).where(F.col("u") < min(1.0, 2.0 * most / max(total, 1))).orderBy("u", row_id).limit(most)
    drawn = drawn.withColumn("n", F.row_number().over(W.orderBy("u", row_id)))  # `most` rows
    seen = drawn.crossJoin(small(queries)).select("qid", "n", inside.cast("double").alias("x"))
    run = W.partitionBy("qid").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    seen = seen.withColumn("hits", F.sum("x").over(run))
    p = F.col("hits") / F.col("n")
    variance = F.when(F.col("n") > 1, p * (1 - p) * F.col("n") / (F.col("n") - 1)).otherwise(0.0)
    z = NormalDist().inv_cdf((1 + confidence) / 2)
    enough = (F.col("n") >= first) & (relative * F.greatest(F.col("hits"), F.col("n") * (absolute / max(total, 1))) >= z * F.sqrt(F.col("n") * variance))
    last = F.min(F.when(enough, F.struct("n", "hits")))
    found = seen.groupBy("qid").agg(last.alias("a"), F.max(F.struct("n", "hits")).alias("b"))
    at = F.coalesce("a", "b")
    return found.select("qid", at["n"].alias("drawn"), (at["hits"] / at["n"] * total).alias("estimate"), F.col("a").isNotNull().alias("stopped"))
