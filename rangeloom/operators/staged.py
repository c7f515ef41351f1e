"""Staged linear models of a cumulative function.

Each stage's prediction picks the model of the next stage; a stage is fitted by one
grouped regression.  Predictions are rounded before they are cut to a model number, so
that routing does not hang on the last bits of a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..tables import keep, small

FANOUTS = (1, 10, 100)


def _next(value: Column, total: int, models: int) -> Column:
    return clip(F.floor(F.round(value, 6) / F.lit(float(max(total, 1))) * models), models).cast("int")


def train(table: DataFrame, fanouts: tuple[int, ...] = FANOUTS, measure: str = "f") -> DataFrame:
    """(stage, model, a, b, n, max_error) with value = a * (key - shift) + b, shift included."""
    total = table.agg(F.max(measure)).first()[0] or 0
    rows = table.select("key", F.col(measure).cast("double").alias("v")).withColumn("model", F.lit(0))
    out = None
    for stage, models in enumerate(fanouts):
        centre = F.avg("key")
        fits = rows.groupBy("model").agg(
            centre.alias("shift"),
            F.coalesce(F.regr_slope("v", "key"), F.lit(0.0)).alias("a"),
            F.avg("v").alias("b"),
            F.count("*").alias("n"),
        )
        fits = keep(fits, f"stage{stage}")
        rows = rows.join(small(fits.select("model", "shift", "a", "b")), "model")
        rows = rows.withColumn("guess", F.col("a") * (F.col("key") - F.col("shift")) + F.col("b"))
        worst = rows.groupBy("model").agg(F.max(F.abs(F.col("guess") - F.col("v"))).alias("max_error"))
        done = fits.join(worst, "model").withColumn("stage", F.lit(stage)).withColumn("models", F.lit(models))
        out = done if out is None else out.unionByName(done)
        if stage + 1 < len(fanouts):
            rows = rows.select("key", "v", _next(F.col("guess"), total, fanouts[stage + 1]).alias("model"))
    return out.withColumn("total", F.lit(int(total)))


def predict(probes: DataFrame, models: DataFrame, fanouts: tuple[int, ...] = FANOUTS, at: str = "at") -> DataFrame:
    """`probes` with guess, model and max_error of the last stage; a model without rows predicts by
    its nearest smaller neighbour's number being absent: such probes keep the stage before."""
    total = models.agg(F.max("total")).first()[0] or 0
    out = probes.withColumn("model", F.lit(0)).withColumn("guess", F.lit(0.0)).withColumn("max_error", F.lit(None).cast("double"))
    for stage, _ in enumerate(fanouts):
        fits = models.where(F.col("stage") == stage).select(F.col("model").alias("m"), "shift", "a", "b", F.col("max_error").alias("e"))
        out = out.join(small(fits), F.col("model") == F.col("m"), "left")
        out = out.withColumn("guess", F.coalesce(F.col("a") * (F.col(at) - F.col("shift")) + F.col("b"), F.col("guess"))).withColumn("max_error", F.coalesce("e", "max_error")).drop("m", "shift", "a", "b", "e")
        if stage + 1 < len(fanouts):
            out = out.withColumn("model", _next(F.col("guess"), total, fanouts[stage + 1]))
    return out


def count_answers(queries: DataFrame, models: DataFrame, table: DataFrame, fanouts: tuple[int, ...] = FANOUTS, replace_above: float | None = None) -> DataFrame:
    """(qid, approx, bound, replaced) over (lo, hi]; leaves whose error is above `replace_above` are replaced by the
    exact function.  The bound adds the errors of the leaves at both ends, it holds for ends that are keys;
    `replaced` counts the ends answered exactly."""
    from .keyspace import asof

    ends = queries.select("qid", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(-1.0).alias("sign")), F.struct(F.col("hi").alias("at"), F.lit(1.0).alias("sign")))).alias("e"))
    found = predict(ends.select("qid", "e.at", "e.sign"), models, fanouts).withColumn("own", F.lit(False))
    if replace_above is not None:
        found = asof(found.withColumn("own", F.col("max_error") > replace_above), table.select("key", "f"))
        found = found.withColumn("guess", F.when(F.col("own"), F.coalesce("hit.f", F.lit(0)).cast("double")).otherwise(F.col("guess")))
    bound = F.when(F.col("own"), 0.0).otherwise(F.col("max_error"))
    return found.groupBy("qid").agg(F.sum(F.col("sign") * F.col("guess")).alias("approx"), F.sum(bound).alias("bound"), F.sum(F.col("own").cast("int")).alias("replaced"))


def bucket_map(table: DataFrame, models: DataFrame, fanouts: tuple[int, ...] = FANOUTS) -> DataFrame:
    """(key, bucket): each key's leaf model, by which an equi-join replaces prediction."""
    return predict(table.select("key"), models, fanouts, at="key").select("key", F.col("model").alias("bucket"))
