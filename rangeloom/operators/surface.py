"""Two keys: cumulative surfaces on a lattice, and polynomial models of them in quadrants.

The surface F(i, j) counts the points in the first i columns and j rows of a lattice of
`grid` x `grid` cells; a count over a box of cells is a sum of four corners.  Quadrants
whose fit is off by more than t are split into four, all quadrants of a level at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import tensor
from ..tables import keep, small

MODEL = "level int, i0 int, j0 int, size int, coef array<double>, loss double, n long"


def points(df: DataFrame, k1: str, k2: str, value: str | None = None) -> DataFrame:
    """(k1, k2, value) as doubles without null or NaN keys; timestamps become seconds."""
    kind = dict(df.dtypes)
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if kind[c].startswith("timestamp") else F.col(c)).cast("double")
    out = df.select(number(k1).alias("k1"), number(k2).alias("k2"), (number(value) if value else F.lit(1.0)).alias("value"))
    return out.where("k1 IS NOT NULL AND k2 IS NOT NULL AND NOT isnan(k1) AND NOT isnan(k2)")


def domain(pts: DataFrame) -> tuple[float, float, float, float]:
    low1, high1, low2, high2 = pts.agg(F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")).first()
    return (low1, high1, low2, high2) if low1 is not None else (0.0, 1.0, 0.0, 1.0)


def cell(k, low: float, high: float, grid: int):
    """Lattice cell 0..grid-1 of a key; the domain's upper border belongs to the last cell."""
    step = (high - low) / grid or 1.0
    return F.least(F.greatest(F.floor((k - low) / step), F.lit(0)), F.lit(grid - 1)).cast("int")


def surface(pts: DataFrame, grid: int = 64, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(i, j, f) for 0 <= i, j <= grid: the number of points in cells below i and below j.
    The lattice's size is a parameter; only cell counts are accumulated."""
    low1, high1, low2, high2 = box or domain(pts)
    cells = pts.groupBy(cell(F.col("k1"), low1, high1, grid).alias("i"), cell(F.col("k2"), low2, high2, grid).alias("j")).agg(F.count("*").alias("c"))
    axis = lambda c: pts.sparkSession.range(grid + 1).select(F.col("id").cast("int").alias(c))
    dense = axis("i").crossJoin(F.broadcast(axis("j"))).join(cells.select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "c"), ["i", "j"], "left")
    along = lambda part, order: W.partitionBy(part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = dense.withColumn("r", F.sum(F.coalesce("c", F.lit(0))).over(along("i", "j")))
    return rows.select("i", "j", F.sum("r").over(along("j", "i")).alias("f"))


def _fit(part: pd.DataFrame, degree: int, kind: str) -> tuple[np.ndarray, float]:
    size = int(part["size"].iloc[0])
    x = 2 * (part.i.to_numpy() - part.i0.to_numpy()) / size - 1
    y = 2 * (part.j.to_numpy() - part.j0.to_numpy()) / size - 1
    if kind == "quadratic":
        basis = np.stack([np.ones_like(x), x, x * x, y, y * y, x * y], 1)
    else:
        basis = np.stack([x**a * y**b for a in range(degree + 1) for b in range(degree + 1)], 1)
    f = part.f.to_numpy().astype(float)
    w, best, least = np.ones(len(f)) / len(f), None, np.inf
    for _ in range(10):
        root = np.sqrt(w)
        coef = np.linalg.lstsq(basis * root[:, None], f * root, rcond=None)[0]
        off = np.abs(basis @ coef - f)
        if off.max() < least:
            best, least = coef, float(off.max())
        if (w * off).sum() <= 0:
            break
        w = w * off / (w * off).sum() + 1e-12
    return best, least


def _fitter(level: int, degree: int, kind: str):
    def work(part: pd.DataFrame) -> pd.DataFrame:
        coef, loss = _fit(part, degree, kind)
        at = [int(part[c].iloc[0]) for c in ("i0", "j0", "size")]
        return pd.DataFrame([(level, *at, [float(c) for c in coef], loss, len(part))], columns=[c.split()[0] for c in MODEL.split(", ")])

    return work


def quadrants(lattice: DataFrame, t: float, degree: int = 2, grid: int = 64, start_level: int = 1, kind: str = "tensor") -> DataFrame:
    """Models (level, i0, j0, size, coef, loss, n) that cover the lattice; each is within t of f on its
    lattice points.  A quadrant of one cell has only its four corners and is always accepted."""
    lattice = keep(lattice, "lattice")
    spark, level, size, done = lattice.sparkSession, start_level, grid >> start_level, None
    steps = spark.range(grid // size)
    open_ = steps.select((F.col("id") * size).cast("int").alias("i0")).crossJoin(steps.select((F.col("id") * size).cast("int").alias("j0"))).withColumn("size", F.lit(size))
    while True:
        # the quadrants a lattice point lies in follow from its numbers: one, or two along an axis on a border
        starts = lambda c: F.explode(F.when((F.col(c) % size == 0) & F.col(c).between(size, grid - size), F.array(F.col(c) - size, F.col(c))).otherwise(F.array(F.least(F.floor(F.col(c) / size) * size, F.lit(grid - size)).cast("int"))))  # noqa: E731,B023
        held = lattice.withColumn("i0", starts("i")).withColumn("j0", starts("j")).join(small(open_), ["i0", "j0"])
        fits = keep(held.groupBy("i0", "j0").applyInPandas(_fitter(level, degree, kind), MODEL), "quadrants")
        fine = fits.where((F.col("loss") <= t) | (F.col("size") <= 1))
        done = fine if done is None else done.union(fine)
        rest = fits.where((F.col("loss") > t) & (F.col("size") > 1))
        if rest.isEmpty():
            return done
        half = (F.col("size") / 2).cast("int")
        quarter = F.explode(F.array(*[F.struct((F.col("i0") + a * half).alias("i0"), (F.col("j0") + b * half).alias("j0")) for a in (0, 1) for b in (0, 1)]))
        open_ = rest.select(quarter.alias("q"), half.alias("size")).select("q.i0", "q.j0", "size")
        level, size = level + 1, size // 2


def model_value(degree: int, kind: str = "tensor", i: str = "i", j: str = "j"):
    """The value of a joined model at lattice place (i, j)."""
    x = 2 * (F.col(i) - F.col("i0")) / F.col("size") - 1
    y = 2 * (F.col(j) - F.col("j0")) / F.col("size") - 1
    c = lambda k: F.col("coef")[k]
    if kind == "quadratic":
        return c(0) + c(1) * x + c(2) * x * x + c(3) * y + c(4) * y * y + c(5) * x * y
    return tensor(F.col("coef"), x, y, degree)


def located(at: DataFrame, models: DataFrame, grid: int, i: str = "i", j: str = "j") -> DataFrame:
    """Rows with lattice places (i, j), which may lie between lattice points, and the one model of each: quadrants
    are half open, but for the domain's upper borders, so that every place has exactly one.  A place names its
    quadrant at each size, so the join is on equal numbers."""
    sizes = [grid >> k for k in range(grid.bit_length()) if grid >> k]
    start = lambda c: F.greatest(F.lit(0), F.least(F.floor(F.col(c) / F.col("size")) * F.col("size"), F.lit(grid) - F.col("size"))).cast("int")
    each = at.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("i0", start(i)).withColumn("j0", start(j))
    return each.join(small(models), ["size", "i0", "j0"])


def corners(queries: DataFrame) -> DataFrame:
    """(qid, i, j, sign) of boxes of cells (qid, i_lo, i_hi, j_lo, j_hi)."""
    corner = lambda i, j, s: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(s).alias("sign"))
    every = F.array(corner("i_hi", "j_hi", 1.0), corner("i_lo", "j_lo", 1.0), corner("i_lo", "j_hi", -1.0), corner("i_hi", "j_lo", -1.0))
    return queries.select("qid", F.explode(every).alias("c")).select("qid", "c.*")


def box_answers(queries: DataFrame, models: DataFrame, degree: int, grid: int, kind: str = "tensor") -> DataFrame:
    """(qid, approx, bound) of COUNT over boxes of lattice cells; the bound adds four models' errors."""
    found = located(corners(queries), models, grid)
    return found.groupBy("qid").agg(F.sum(F.col("sign") * model_value(degree, kind)).alias("approx"), F.sum("loss").alias("bound"))


def exact_boxes(queries: DataFrame, lattice: DataFrame) -> DataFrame:
    """(qid, count) by the four corners of the surface itself."""
    found = small(corners(queries)).join(lattice, ["i", "j"])
    return found.groupBy("qid").agg(F.sum(F.col("sign") * F.col("f")).cast("long").alias("count"))


def prediction_surface(lattice: DataFrame, models: DataFrame, degree: int, grid: int, kind: str = "tensor") -> DataFrame:
    """(i, j, f, value): the model's value at each lattice point."""
    return located(lattice, models, grid).select("i", "j", "f", model_value(degree, kind).alias("value"))


def raw_corners(queries: DataFrame, box: tuple[float, float, float, float], grid: int) -> DataFrame:
    """(qid, sign, u, v) of boxes (qid, lo1, lo2, hi1, hi2) of keys: corners as places on the lattice, inside the domain."""
    low1, high1, low2, high2 = box
    place = lambda c, low, high: F.greatest(F.lit(0.0), F.least(F.lit(float(grid)), (F.col(c) - low) / ((high - low) / grid or 1.0)))
    corner = lambda a, b, s: F.struct(place(a, low1, high1).alias("u"), place(b, low2, high2).alias("v"), F.lit(s).alias("sign"))
    every = F.array(corner("hi1", "hi2", 1.0), corner("lo1", "lo2", 1.0), corner("lo1", "hi2", -1.0), corner("hi1", "lo2", -1.0))
    return queries.where("lo1 <= hi1 AND lo2 <= hi2").select("qid", F.explode(every).alias("c")).select("qid", "c.*")


def raw_box_answers(queries: DataFrame, models: DataFrame, degree: int, grid: int, box: tuple[float, float, float, float], kind: str = "tensor") -> DataFrame:
    """(qid, approx, bound) of COUNT over boxes of keys, corners anywhere: (lo1, hi1] x (lo2, hi2].

    Between lattice points nothing holds a model to the surface, but the surface never falls: a corner's value
    lies between those of the lattice points below and above it, which the models know within their errors."""
    ends = raw_corners(queries, box, grid).withColumn("corner", F.monotonically_increasing_id())
    low = lambda c: F.floor(c)
    high = lambda c: F.least(F.floor(c) + 1, F.lit(grid))
    where = F.array(*[F.struct(F.lit(name).alias("at"), f("u").cast("double").alias("i"), f("v").cast("double").alias("j")) for name, f in (("place", F.col), ("low", low), ("high", high))])
    ends = keep(ends.withColumn("w", F.explode(where)).select("qid", "sign", "corner", "w.*"), "corners")
    value = model_value(degree, kind)
    found = located(ends, models, grid).select("qid", "sign", "corner", "at", value.alias("value"), "loss")
    at = lambda name, e: F.max(F.when(F.col("at") == name, e))
    one = found.groupBy("qid", "sign", "corner").agg(at("place", F.col("value")).alias("value"), at("low", F.col("value") - F.col("loss")).alias("least"), at("high", F.col("value") + F.col("loss")).alias("most"))
    one = one.withColumn("value", F.greatest("least", F.least("most", "value")))
    off = F.greatest(F.col("most") - F.col("value"), F.col("value") - F.col("least"))
    total = one.groupBy("qid").agg(F.sum(F.col("sign") * F.col("value")).alias("approx"), F.sum(off).alias("bound"))
    return queries.select("qid").join(total, "qid", "left").select("qid", F.coalesce("approx", F.lit(0.0)).alias("approx"), F.coalesce("bound", F.lit(0.0)).alias("bound"))


def boxes_with_refinement(queries: DataFrame, rough: DataFrame, points: DataFrame, relative: float) -> DataFrame:
    """(qid, approx, bound, certified, answer): of `rough` (qid, approx, bound) what isn't certified to the relative
    error takes the exact count of `points` in (lo1, hi1] x (lo2, hi2]."""
    from ..functions.columns import certified
    from .exact import box_count

    rough = keep(rough.withColumn("certified", F.coalesce(certified(F.col("approx"), F.col("bound"), relative), F.lit(False))), "rough")
    open_ = queries.join(small(rough.where("NOT certified").select("qid")), "qid", "left_semi")
    exact = box_count(open_, points, closed=False).select("qid", F.col("count").alias("exact"))
    return rough.join(exact, "qid", "left").withColumn("answer", F.coalesce(F.col("exact").cast("double"), F.col("approx"))).drop("exact")
