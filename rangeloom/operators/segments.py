"""Segment tables: compact models of a cumulative function or of a measure.

The distinct keys are cut into blocks of `BLOCK` consecutive ranks, and every block is
fitted on its own.  A block costs one more segment at most than a fit
across blocks, bounds hold by segment, and the result depends on ranks alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fitting

BLOCK = 8192
#: Keys handed to Python at once, in whole blocks, where a fitter takes blocks in step.
TOGETHER = 1 << 17
#: Partitions that blocks are dealt into.
PARTITIONS = 48
SCHEMA = "key double, key_hi double, idx_lo long, idx_hi long, coef array<double>, centre double, scale double, loss double, seg_max double, n long"


def _rows(segs: list[fitting.Segment], part: pd.DataFrame, values: np.ndarray) -> pd.DataFrame:
    k, rank = part.key.to_numpy(), part["rank"].to_numpy()
    return pd.DataFrame(
        [
            (k[i], k[j - 1], rank[i], rank[j - 1] + 1, [float(c) for c in coef], centre, scale, err, float(values[i:j].max()), j - i)
            for i, j, coef, centre, scale, err in segs
        ],
        columns=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def _by_block(table: DataFrame, fit: Callable[[list[pd.DataFrame]], list[pd.DataFrame]], block: int, lanes: int = 1) -> DataFrame:
    # each block also gets the first key of the next one, where its last step ends
    owned = table.withColumn("block", F.floor(F.col("rank") / block)).withColumn("guest", F.lit(False))
    guests = table.where((F.col("rank") % block == 0) & (F.col("rank") > 0)).withColumn("block", F.col("rank") / block - 1).withColumn("guest", F.lit(True))
    both = owned.unionByName(guests.withColumn("block", F.col("block").cast("long")))
    split = lambda rows: [part for _, part in rows.sort_values(["block", "rank"]).groupby("block")]
    # few bytes are much work here, so partitions aren't joined by their bytes
    both = both.withColumn("chunk", F.floor(F.col("block") / lanes)).repartition(PARTITIONS, "chunk")
    return both.groupBy("chunk").applyInPandas(lambda rows: pd.concat(fit(split(rows)), ignore_index=True), SCHEMA)


def build(table: DataFrame, method: str = "poly", t: float = 100.0, degree: int = 1, measure: str = "f", block: int = BLOCK) -> DataFrame:
    """Segments of the cumulative column `measure` of a table from keyspace.cumulative()."""
    if method not in fitting.METHODS:
        raise ValueError(f"method must be one of {sorted(fitting.METHODS)}")
    source = table.select("key", "rank", F.col(measure).cast("double").alias("v"))

    def fit(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        own = [(p.key.to_numpy()[~p.guest], p.v.to_numpy()[~p.guest]) for p in parts]
        if method in fitting.TOGETHER:
            found = fitting.TOGETHER[method]([k for k, _ in own], [v for _, v in own], t)
        else:
            found = [fitting.METHODS[method](k, v, t, degree) for k, v in own]
        return [closed(*both) for both in zip(parts, found)]

    def closed(part: pd.DataFrame, segs: list[fitting.Segment]) -> pd.DataFrame:
        k, v, n = part.key.to_numpy(), part.v.to_numpy(), int((~part.guest).sum())
        if len(k) > n:  # the last step reaches up to the next block's first key
            i, j, coef, centre, scale, _ = segs[-1]
            err = fitting.staircase_error(k, v, i, j, coef, centre, scale)
            if err > t and method != "bottom_up":
                segs[-1:] = [(i + a, i + b, c, m, s, fitting.staircase_error(k, v, i + a, i + b, c, m, s)) for a, b, c, m, s, _ in _split_tail(k[i : n + 1], v[i : n + 1], coef, centre, scale)]
            else:
                segs[-1] = (i, j, coef, centre, scale, err)
        return _rows(segs, part, v)

    return _by_block(source, fit, block, max(1, TOGETHER // block) if method in fitting.TOGETHER else 1)


def _split_tail(k: np.ndarray, v: np.ndarray, coef: np.ndarray, centre: float, scale: float) -> list[fitting.Segment]:
    """A segment whose last step is too long: that step gets a constant of its own."""
    n = len(k) - 1
    last = (n - 1, n, np.array([v[n - 1]] + [0.0] * (len(coef) - 1)), float(k[n - 1]), 1.0, 0.0)
    return [last] if n == 1 else [(0, n - 1, coef, centre, scale, 0.0), last]


def build_max(rows: DataFrame, t: float = 100.0, degree: int = 1, block: int = BLOCK) -> DataFrame:
    """Segments of a raw measure: rows of (key, rank, v), one a distinct key with its largest value."""

    def fit(parts: list[pd.DataFrame]) -> list[pd.DataFrame]:
        parts = [p[~p.guest] for p in parts]
        found = fitting.measure_many([p.key.to_numpy() for p in parts], [p.v.to_numpy() for p in parts], t, degree)
        return [_rows(segs, p, p.v.to_numpy()) for p, segs in zip(parts, found)]

    return _by_block(rows, fit, block, 1 if degree == 1 else max(1, TOGETHER // block))


def on_splits(table: DataFrame, splits: DataFrame, degree: int = 1, measure: str = "f") -> DataFrame:
    """One polynomial for each histogram bucket; `splits` (rank) holds the first rank of each bucket but the first.
    Buckets must fit one task: they are the histogram's, and a model for each is the point."""
    marks = splits.select("rank", F.lit(1).alias("mark")).distinct()
    number = F.sum(F.coalesce("mark", F.lit(0))).over(W.orderBy("coarse").rowsBetween(W.unboundedPreceding, -1))
    coarse = table.join(F.broadcast(marks), "rank", "left").withColumn("coarse", F.col("bucket"))
    base = coarse.groupBy("coarse").agg(F.sum("mark").alias("mark")).select("coarse", F.coalesce(number, F.lit(0)).alias("base"))
    own = F.sum(F.coalesce("mark", F.lit(0))).over(W.partitionBy("coarse").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    parts = coarse.join(F.broadcast(base), "coarse").select("key", "rank", F.col(measure).cast("double").alias("v"), (F.col("base") + own).alias("part"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        k, v = part.key.to_numpy(), part.v.to_numpy()
        return _rows([fitting._poly(k, v, 0, len(k), degree)], part, v)

    return parts.groupBy("part").applyInPandas(fit, SCHEMA)


def refit_errors(segments: DataFrame, table: DataFrame, degree: int, measure: str = "f") -> DataFrame:
    """(key, mse, std, max_error, worst): residuals of a segment table at its keys, and the key of the largest."""
    from ..functions.columns import horner
    from .keyspace import asof

    found = asof(table.select(F.col("key").alias("at"), F.col(measure).cast("double").alias("v")), segments)
    x = (F.col("at") - F.col("hit.centre")) / F.col("hit.scale")
    off = found.select("hit.key", "at", (horner(F.col("hit.coef"), x, degree) - F.col("v")).alias("r"))
    return off.groupBy("key").agg(F.avg(F.col("r") * F.col("r")).alias("mse"), F.stddev_samp("r").alias("std"), F.max(F.abs("r")).alias("max_error"), F.max_by("at", F.abs("r")).alias("worst"))
