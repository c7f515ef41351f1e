"""Batches of ranges answered from segments, with error bounds, certificates and refinement.

Cumulative answers are over (lo, hi]: the model at hi less the model at lo.  A bound
below all keys has F = 0; the segments answer for everything above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import certified, horner, region_max
from ..operators.exact import by_cumulative, by_scan
from ..operators.keyspace import asof
from ..tables import keep, small


def cumulative_answers(queries: DataFrame, segments: DataFrame, degree: int) -> DataFrame:
    """(qid, approx, bound): two as-of lookups a query; the bound adds both segments' own errors."""
    ends = queries.select("qid", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(-1.0).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1.0).alias("sign")))).alias("e"))
    found = asof(ends.select("qid", "e.at", "e.sign"), segments)
    x = (F.col("at") - F.col("hit.centre")) / F.col("hit.scale")
    # beyond a segment's last key the cumulative function stays where it is
    value = F.coalesce(horner(F.col("hit.coef"), x, degree), F.lit(0.0))
    return found.groupBy("qid").agg(F.sum(F.col("sign") * value).alias("approx"), F.sum(F.coalesce("hit.loss", F.lit(0.0))).alias("bound"))


def clamp_to_domain(queries: DataFrame, table: DataFrame) -> DataFrame:
    """Bounds beyond the last key behave like the last key."""
    top = table.agg(F.max("key").alias("top"))
    return queries.crossJoin(F.broadcast(top)).withColumn("lo", F.least("lo", "top")).withColumn("hi", F.least("hi", "top")).drop("top")


def count_with_refinement(queries: DataFrame, segments: DataFrame, table: DataFrame, degree: int, relative: float, measure: str = "count") -> DataFrame:
    """(qid, approx, bound, certified, answer): uncertified queries take the exact answer."""
    rough = cumulative_answers(clamp_to_domain(queries, table), segments, degree)
    rough = keep(rough.withColumn("certified", F.coalesce(certified(F.col("approx"), F.col("bound"), relative), F.lit(False))), "rough")
    open_ids = rough.where(~F.col("certified")).select("qid")
    exact = by_cumulative(queries.join(small(open_ids), "qid", "left_semi"), table).select("qid", F.col(measure).alias("exact"))
    return rough.join(exact, "qid", "left").withColumn("answer", F.coalesce(F.col("exact").cast("double"), F.col("approx"))).drop("exact")


def max_answers(queries: DataFrame, segments: DataFrame, degree: int) -> DataFrame:
    """(qid, approx, bound): the largest exact maximum of the segments between both ends and the largest model
    maximum of the segments at the ends, which an as-of lookup finds; null over no keys."""
    asked = queries.where("lo <= hi").select("qid", "lo", "hi")
    both = asof(asked.withColumn("at", F.explode(F.array_distinct(F.array("lo", "hi")))), segments)
    ends = keep(both.select("qid", "lo", "hi", "hit").distinct().where("hit IS NOT NULL").select("qid", "lo", "hi", "hit.*"), "ends")
    z = lambda c: (c - F.col("centre")) / F.col("scale")
    inside = (F.col("key") >= F.col("lo")) & (F.col("key_hi") <= F.col("hi"))
    edge = region_max(F.col("coef"), z(F.greatest("lo", "key")), z(F.least("hi", "key_hi")), degree)
    touched = ends.where("key_hi >= lo AND key <= hi").select("qid", F.when(inside, F.col("seg_max")).otherwise(edge).alias("value"), F.when(inside, 0.0).otherwise(F.col("loss")).alias("off"))
    # the segments between: they start behind lo and end before the one that holds hi
    between = asked.join(ends.groupBy("qid").agg(F.max("key").alias("last")), "qid").select("qid", "lo", F.col("last").alias("hi"))
    middle = by_scan(between, segments.select("key", F.col("seg_max").alias("value")), closed=False, open_end=True).where(F.col("max").isNotNull()).select("qid", F.col("max").alias("value"), F.lit(0.0).alias("off"))
    found = touched.union(middle).groupBy("qid").agg(F.max("value").alias("approx"), F.max("off").alias("bound"))
    return queries.select("qid").join(found, "qid", "left")


def max_with_refinement(queries: DataFrame, segments: DataFrame, rows: DataFrame, degree: int, relative: float) -> DataFrame:
    """(qid, approx, bound, certified, answer) of maxima; uncertified ones are refined over rows (key, value)."""
    rough = max_answers(queries, segments, degree)
    sure = (F.col("bound") == 0) | certified(F.col("approx"), F.col("bound"), relative)
    rough = keep(rough.withColumn("certified", F.coalesce(sure, F.lit(False))), "rough")
    exact = by_scan(queries.join(small(rough.where(~F.col("certified")).select("qid")), "qid", "left_semi"), rows).select("qid", F.col("max").alias("exact"))
    return rough.join(exact, "qid", "left").withColumn("answer", F.when(F.col("certified"), F.col("approx")).otherwise(F.col("exact"))).drop("exact")


def accuracy(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries, mean absolute and relative error of (qid, answer) against (qid, exact); a truth of 0
    counts in the absolute mean alone."""
    off = F.abs(F.col("answer") - F.col("exact"))
    both = answers.join(truth, "qid")
    return both.agg(F.count("*").alias("queries"), F.avg(off).alias("abs_error"), F.avg(F.when(F.col("exact") != 0, off / F.abs("exact"))).alias("rel_error"))


def size_of(segments: DataFrame, degree: int) -> DataFrame:
    """One row: models, parameters and bytes at 4 each."""
    n = F.count("*")
    return segments.agg(n.alias("models"), (n * (degree + 2)).alias("parameters"), (n * (degree + 2) * 4).alias("bytes"))
