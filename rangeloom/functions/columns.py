"""Column expressions, inside whole-stage code generation but for maxima of degree 4 and more."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def horner(coef: Column, x: Column, degree: int) -> Column:
    """A polynomial with ascending coefficients, unrolled so that it compiles."""
    out = F.coalesce(coef[degree], F.lit(0.0))
    for j in range(degree - 1, -1, -1):
        out = out * x + F.coalesce(coef[j], F.lit(0.0))
    return out


def tensor(coef: Column, x: Column, y: Column, degree: int) -> Column:
    """A tensor polynomial, coefficients by rows of x's power."""
    rows = [horner(F.slice(coef, i * (degree + 1) + 1, degree + 1), y, degree) for i in range(degree + 1)]
    out = rows[-1]
    for row in reversed(rows[:-1]):
        out = out * x + row
    return out


def region_max(coef: Column, lo: Column, hi: Column, degree: int) -> Column:
    """The maximum over [lo, hi] of a polynomial: both ends and the stationary points between them,
    in closed form up to degree 3, by the roots of the derivative in Arrow batches above."""
    if degree > 3:
        return F.pandas_udf(_region_max, "double")(coef, lo, hi)
    at = lambda x: horner(coef, x, degree)
    points = [at(lo), at(hi)]
    inside = lambda x: F.when((x > lo) & (x < hi), at(x))
    b, c, d = (F.coalesce(coef[j], F.lit(0.0)) if j <= degree else F.lit(0.0) for j in (1, 2, 3))
    if degree == 2:
        points.append(inside(-b / F.nullif(2 * c, F.lit(0.0))))
    elif degree == 3:
        root = F.when(c * c >= 3 * b * d, F.sqrt(F.greatest(c * c - 3 * b * d, F.lit(0.0))))
        slope = F.nullif(3 * d, F.lit(0.0))
        points += [inside((-c + root) / slope), inside((-c - root) / slope), F.when(d == 0, inside(-b / F.nullif(2 * c, F.lit(0.0))))]
    return F.greatest(*points)


def _region_max(coef: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    def one(c, a: float, b: float) -> float | None:
        if c is None or a != a or b != b:
            return None
        roots = np.roots(np.trim_zeros(np.polynomial.polynomial.polyder(np.asarray(c, float))[::-1], "f"))
        at = roots[np.abs(roots.imag) < 1e-9].real
        return float(np.polynomial.polynomial.polyval(np.array([a, b, *at[(at > a) & (at < b)]]), c).max())

    return pd.Series([one(c, a, b) for c, a, b in zip(coef, lo, hi)], dtype="float64")


def certified(answer: Column, error: Column, relative: float) -> Column:
    """Whether the relative error of `answer`, off by `error` at most, is surely within `relative`."""
    least = answer - error
    return (least > 0) & (error / F.nullif(least, F.lit(0.0)) <= relative)


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def within(lo: Column, hi: Column, lo_b: Column, hi_b: Column) -> Column:
    """[lo, hi] lies in [lo_b, hi_b]."""
    return (lo >= lo_b) & (hi <= hi_b)


def overlap_share(lo: Column, hi: Column, lo_b: Column, hi_b: Column) -> Column:
    """The share of [lo, hi] that lies in [lo_b, hi_b]; 1 or 0 where it has no extent."""
    share = F.greatest(F.lit(0.0), F.least(hi, hi_b) - F.greatest(lo, lo_b)) / F.nullif(hi - lo, F.lit(0.0))
    return F.coalesce(share, F.when(overlaps(lo, hi, lo_b, hi_b), 1.0).otherwise(0.0))


def clip(x: Column, models: int) -> Column:
    """A model number in [0, models)."""
    return F.least(F.greatest(x, F.lit(0)), F.lit(models - 1))


def shift_unsigned(x: Column, least: Column) -> Column:
    """Keys moved to start at 1."""
    return (x - least + 1).cast("long")


def leaky_forward(x: Column, first: list[tuple[float, float]], second: list[float], bias: float, slope: float = 0.03) -> Column:
    """A network of one hidden layer of leaky rectifiers over one number."""
    out = F.lit(bias)
    for (w, b), v in zip(first, second):
        z = x * w + b
        out = out + F.when(z > 0, z).otherwise(z * slope) * v
    return out


def normal_quantile(p: float) -> float:
    """Upper normal quantile by the rational approximation 26.2.3 of Abramowitz and Stegun."""
    tail = min(p, 1 - p)
    t = math.sqrt(-2 * math.log(tail))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    return z if p > 0.5 else -z


def normal_quantile_of(p: Column) -> Column:
    """normal_quantile() of a column."""
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p > 0.5, z).otherwise(-z)


def area(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Of a rectangle; 0 if it is inverted."""
    return F.greatest(F.lit(0.0), hi1 - lo1) * F.greatest(F.lit(0.0), hi2 - lo2)


def round_area(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Of the circle around a rectangle."""
    return F.lit(math.pi) * ((hi1 - lo1) * (hi1 - lo1) + (hi2 - lo2) * (hi2 - lo2)) / 4


def united(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """The rectangle around two rectangles (lo1, hi1, lo2, hi2)."""
    return tuple((F.least if i % 2 == 0 else F.greatest)(x, y) for i, (x, y) in enumerate(zip(a, b)))


def cover(lo1: str, hi1: str, lo2: str, hi2: str) -> list[Column]:
    """Aggregates: the rectangle around a group's rectangles."""
    return [F.min(lo1).alias("lo1"), F.max(hi1).alias("hi1"), F.min(lo2).alias("lo2"), F.max(hi2).alias("hi2")]


def entropy_terms(weight: Column) -> tuple[Column, Column]:
    """What an entropy in bits is summed up from: H = log2(sum a) - sum(b) / sum a."""
    return weight, F.when(weight > 0, weight * F.log2(weight)).otherwise(0.0)
