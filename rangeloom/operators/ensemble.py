"""Cumulative functions learnt by a tree ensemble of the ML library; no error bound."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def train(table: DataFrame, inputs: list[str], label: str, trees: int = 20, depth: int = 5, seed: int = 1) -> GBTRegressionModel:
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(table.select(*inputs, F.col(label).cast("double").alias("label")))
    return GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed).fit(rows)


def save(model: GBTRegressionModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> GBTRegressionModel:
    return GBTRegressionModel.load(path)


def count_answers(queries: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """(qid, approx) over (lo, hi]: the model at hi less the model at lo."""
    ends = queries.select("qid", F.explode(F.array(F.struct(F.col("lo").alias("key"), F.lit(-1.0).alias("sign")), F.struct(F.col("hi").alias("key"), F.lit(1.0).alias("sign")))).alias("e")).select("qid", "e.*")
    rows = model.transform(VectorAssembler(inputCols=["key"], outputCol="features").transform(ends))
    return rows.groupBy("qid").agg(F.sum(F.col("sign") * F.col("prediction")).alias("approx"))


def box_answers(queries: DataFrame, model: GBTRegressionModel) -> DataFrame:
    """(qid, approx) over boxes of lattice cells, by four corners."""
    from .surface import corners

    rows = model.transform(VectorAssembler(inputCols=["i", "j"], outputCol="features").transform(corners(queries)))
    return rows.groupBy("qid").agg(F.sum(F.col("sign") * F.col("prediction")).alias("approx"))
