"""Keys, cumulative functions and as-of lookups that no single task has to sort.

Null and NaN keys are left out.  Keys are cut at approximate quantiles into buckets;
buckets are counted, the few bucket totals accumulated, and order is needed only inside
a bucket.  The cuts steer the work alone: results don't depend on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import is_small, keep

#: Buckets of a table hold about so many rows; their number is bounded by what a search tree of comparisons can take.
BUCKET_ROWS, LEAST, MOST = 1_000_000, 16, 256
#: The same for lookups, whose buckets hold rows of both sides whole.
MERGED_ROWS = 250_000
#: Buckets of about equal size, and parts of equal width in each, that lookups of a few probes or ranges go by.
COARSE, FINE = 64, 256
FEW_PROBES = 10_000


def clean(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key, value) as doubles, without null and NaN keys; timestamps become seconds."""
    number = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6 if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)).cast("double")
    out = df.select(number(key).alias("key"), (number(value) if value else F.lit(1.0)).alias("value"))
    return out.where(F.col("key").isNotNull() & ~F.isnan("key"))


def _thinned(found: list[float] | None, n: int, rows: int) -> list[float]:
    """Of MOST - 1 quantiles of n rows as many as make buckets of `rows` rows."""
    step = max(1, MOST // max(LEAST, min(MOST, -(-n // rows))))
    return sorted(set((found or [])[step - 1 :: step]))


def cuts(df: DataFrame, column: str = "key", buckets: int | None = None) -> list[float]:
    """Approximate quantiles of a column, sorted and distinct: `buckets` - 1 numbers at most, or as many as the
    rows call for."""
    most = buckets or MOST
    n, found = df.agg(F.count(column), F.percentile_approx(column, [i / most for i in range(1, most)], 4 * most)).first()
    return sorted(set(found or [])) if buckets else _thinned(found, n, BUCKET_ROWS)


def bucket_of(key: str, bounds: list[float], leaf: Callable[[int], str] = str) -> Column:
    """How many bounds are at most the column `key`, by a search tree of comparisons; with `leaf`, the SQL
    that it gives for that number."""
    def tree(lo: int, hi: int) -> str:
        if lo == hi:
            return leaf(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{key}` < {float(bounds[mid])!r}D THEN {tree(lo, mid)} ELSE {tree(mid + 1, hi)} END"

    return F.expr(tree(0, len(bounds)))


def cumulative(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """(key, n, total, rank, f, s, bucket): one row a distinct key; n and total are the count and sum
    of its rows, rank counts distinct keys from 0, f and s accumulate n and total up to and with it."""
    rows = clean(df, key, value)
    bounds = cuts(rows)
    rows = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).withColumn("bucket", bucket_of("key", bounds))
    over = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most MOST rows
    base = lambda c: F.coalesce(F.sum(c).over(over), F.lit(0))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("total").alias("t"))
    sums = sums.select("bucket", base("k").alias("k0"), base("n").alias("n0"), base("t").cast("double").alias("t0"))
    order = W.partitionBy("bucket").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(F.broadcast(sums), "bucket").select(
        "key", "n", "total",
        (F.col("k0") + F.row_number().over(W.partitionBy("bucket").orderBy("key")) - 1).alias("rank"),
        (F.col("n0") + F.sum("n").over(order)).alias("f"),
        (F.col("t0") + F.sum("total").over(order)).alias("s"),
        "bucket",
    )


def coded(rows: DataFrame, key: str, coarse: int = COARSE, fine: int = FINE) -> Callable[[str], Column]:
    """A function from a column of keys to the number of the part each is in: coarse buckets between approximate
    quantiles, each cut into `fine` parts of equal width.  It never falls as the key rises."""
    first, last, found = rows.agg(F.min(key), F.max(key), F.percentile_approx(key, [i / coarse for i in range(1, coarse)], 4 * coarse)).first()
    if first is None:
        return lambda name: F.lit(0)
    bounds = sorted(set(found))
    edges = [float(x) for x in (first, *bounds, last)]

    def code(name: str) -> Column:
        def leaf(b: int) -> str:
            width = edges[b + 1] - edges[b]
            return f"{b * fine} + CAST(least(greatest(floor((`{name}` - {edges[b]!r}D) * {fine / width!r}D), 0), {fine - 1}) AS INT)" if width > 0 and fine > 1 else str(b * fine)

        return bucket_of(name, bounds, leaf).cast("int")

    return code


def _merged(probes: DataFrame, table: DataFrame, at: str, key: str, inclusive: bool, forward: bool, bounds: list[float]) -> DataFrame:
    """Both sides merged in key order, bucket by bucket; each bucket is handed the nearest row of the ones beside it.
    Forward lookups go through the keys downwards: a frame that ends at the current row grows with it, one that
    starts there is gone through anew for every row."""
    left = probes.select(F.struct(*probes.columns).alias("probe"), F.lit(None).cast(table.select(F.struct("*")).schema[0].dataType).alias("row"), F.col(at).cast("double").alias("k"))
    right = table.select(F.lit(None).cast(left.schema["probe"].dataType).alias("probe"), F.struct(*table.columns).alias("row"), F.col(key).cast("double").alias("k"))
    both = left.union(right).withColumn("bucket", F.when(F.col("k").isNotNull(), bucket_of("k", bounds)))
    first_on_ties = F.col("probe").isNull() if inclusive else F.col("probe").isNotNull()
    order = [F.col("k").desc() if forward else F.col("k"), F.when(first_on_ties, 0).otherwise(1)]
    before = W.partitionBy("bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    near = F.last("row", ignorenulls=True).over(before)
    # one row a bucket: keys are compared first, as numbers combine by hashing, whole rows by sorting
    edge = F.min if forward else F.max
    last = right.groupBy(bucket_of("k", bounds).alias("bucket")).agg(edge("k").alias("e"))
    ends = right.join(F.broadcast(last), F.col("k") == F.col("e")).select("bucket", F.col("row").alias("end"))
    every = probes.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("bucket"))
    beside = W.orderBy(F.desc("bucket") if forward else F.asc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    ends = every.join(F.broadcast(ends), "bucket", "left").select("bucket", F.last("end", ignorenulls=True).over(beside).alias("end"))
    found = both.withColumn("near", near).where(F.col("probe").isNotNull()).join(F.broadcast(ends), "bucket", "left")
    hit = F.when(F.col("k").isNotNull(), F.coalesce("near", "end"))
    return found.select("probe.*", hit.alias("hit"))


def _many_merged(probes: DataFrame, table: DataFrame, at: str, key: str, inclusive: bool, forward: bool) -> DataFrame:
    """As _merged(), in buckets that are cut by the rows of both sides, as probes may crowd where keys don't.
    Probes that no cut can part, because they are alike, are looked up once a value; so are NaN."""
    k = F.col(at).cast("double")
    both = probes.select(k.alias("k")).union(table.select(F.col(key).cast("double")))
    odd = F.col("k").isNull() | F.isnan("k")
    n, none, found = both.agg(F.count("*"), F.count_if(odd), F.percentile_approx(F.when(~odd, F.col("k")), [i / MOST for i in range(1, MOST)], 4 * MOST)).first()
    bounds = _thinned(found, n - none, MERGED_ROWS)
    hot = sorted({a for a, b in zip(found or [], (found or [])[1:]) if a == b})
    if not none and not hot:
        return _merged(probes, table, at, key, inclusive, forward, bounds)
    apart = k.isNull() | F.isnan(k) | k.isin(hot)
    once = probes.sparkSession.createDataFrame([(v,) for v in (*hot, float("nan"))], "of double")
    hits = _looked_up(once, table, "of", key, inclusive, forward)
    alike = probes.where(apart).join(F.broadcast(hits), k == F.col("of"), "left").select(*[probes[c] for c in probes.columns], "hit")
    return _merged(probes.where(~apart), table, at, key, inclusive, forward, bounds).union(alike)


def _looked_up(probes: DataFrame, table: DataFrame, at: str, key: str, inclusive: bool, forward: bool) -> DataFrame:
    """A few probes, sent to the table: each meets the rows of its own part, and the last rows of the parts before it.
    The table isn't shuffled."""
    asked = probes.select(F.struct(*probes.columns).alias("probe"), F.col(at).cast("double").alias("k"), F.monotonically_increasing_id().alias("pid"))
    asked = keep(asked, "probes")
    code = coded(table, key)
    rows = table.select(F.struct(*table.columns).alias("row"), F.col(key).cast("double").alias("k")).withColumn("part", code("k"))
    pick, edge = (F.min_by, F.min) if forward else (F.max_by, F.max)
    # COARSE * FINE rows at most; keys are compared first, as numbers combine by hashing, whole rows by sorting
    last = rows.groupBy("part").agg(edge("k").alias("e"))
    ends = keep(rows.join(F.broadcast(last.select("e")), F.col("k") == F.col("e")).select("row.*"), "ends")
    mine = asked.where("k IS NOT NULL AND NOT isnan(k)").withColumn("part", code("k")).select("pid", F.col("k").alias("p"), "part")
    near = {(False, True): "k <= p", (False, False): "k < p", (True, True): "k >= p", (True, False): "k > p"}[forward, inclusive]
    own = rows.join(F.broadcast(mine), "part").where(near).groupBy("pid").agg(pick("row", "k").alias("own"))
    far = _merged(asked, ends, "k", key, inclusive, forward, [])
    return far.join(own, "pid", "left").select("probe.*", F.coalesce("own", "hit").alias("hit"))


def asof(probes: DataFrame, table: DataFrame, at: str = "at", key: str = "key", inclusive: bool = True, forward: bool = False) -> DataFrame:
    """Each row of `probes` with `hit`, the row of `table` that has the last key <= `at` (< if not inclusive;
    with `forward` the first key >= or > `at`); null where there is none.  Keys of `table` are distinct.
    Spark SQL has no such join: a few probes are sent to the table, many are merged with it in key order."""
    if is_small(probes, FEW_PROBES):
        return _looked_up(probes, table, at, key, inclusive, forward)
    return _many_merged(probes, table, at, key, inclusive, forward)


def spread(table: DataFrame) -> DataFrame:
    """`table` (key, rank, bucket...) with spread, the way to the next key; 1 for the last."""
    heads = table.groupBy("bucket").agg(F.min("key").alias("head"))
    heads = heads.select("bucket", F.lead("head").over(W.orderBy("bucket")).alias("next_head"))
    step = F.coalesce(F.lead("key").over(W.partitionBy("bucket").orderBy("key")), "next_head") - F.col("key")
    return table.join(F.broadcast(heads), "bucket").withColumn("spread", F.coalesce(step, F.lit(1.0))).drop("next_head")
