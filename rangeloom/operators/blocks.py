"""Block summaries: the levels of an aggregate tree as one table, and what can be answered from them.

With one key, level 0 holds blocks of `fanout` consecutive distinct keys; with two, the cells of a grid
between approximate quantiles.  Each further level joins `fanout` nodes (4 x 4 cells), up to a top of few.
Queries go down from there: covered nodes are taken whole, only nodes that stand across a query's border
are opened, by an equi-join with their children.  Answers don't depend on the tree's shape, approximations do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import overlap_share, overlaps, within
from ..tables import keep, small
from .keyspace import bucket_of, cuts

FANOUT = 64
#: Cells along each axis at level 0 of a tree over two keys, how many are joined, and how a cell is numbered.
CELLS, JOINED, STRIDE = 64, 4, 1 << 20
SUMS = ("cnt", "total", "least", "most")
ONE, TWO = (("lo", "hi"),), (("lo1", "hi1"), ("lo2", "hi2"))


def _rolled(df: DataFrame, dims: tuple) -> DataFrame:
    rect = [f(c).alias(c) for lo, hi in dims for f, c in ((F.min, lo), (F.max, hi))]
    return df.groupBy("node").agg(*rect, F.sum("cnt").alias("cnt"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def _levels(leaves: DataFrame, dims: tuple, parent: Callable[[Column], Column], levels: int) -> DataFrame:
    out, rolled = None, None
    for level in range(levels):
        base = leaves if rolled is None else rolled.drop("level", "node").withColumnRenamed("parent", "node")
        rolled = _rolled(base, dims)
        rolled = rolled.select(F.lit(level).alias("level"), "node", parent(F.col("node")).cast("long").alias("parent"), *[c for d in dims for c in d], *SUMS)
        out = rolled if out is None else out.union(rolled)
    return out


def leaves(table: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves of a table (key, rank, n, total, least, most): its keys, with the block each is in."""
    return table.select(F.floor(F.col("rank") / fanout).cast("long").alias("node"), F.col("key").alias("lo"), F.col("key").alias("hi"), F.col("n").alias("cnt"), "total", "least", "most")


def box_leaves(points: DataFrame, cells: int = CELLS) -> DataFrame:
    """The leaves of points (k1, k2, value): the points, with the cell each is in."""
    x, y = (bucket_of(k, cuts(points, k, cells)) for k in ("k1", "k2"))
    node = (x.cast("long") * STRIDE + y).alias("node")
    value = F.col("value")
    return points.select(node, F.col("k1").alias("lo1"), F.col("k1").alias("hi1"), F.col("k2").alias("lo2"), F.col("k2").alias("hi2"), F.lit(1).cast("long").alias("cnt"), value.alias("total"), value.alias("least"), value.alias("most"))


def summary(table: DataFrame, fanout: int = FANOUT, levels: int | None = None) -> DataFrame:
    """(level, node, parent, lo, hi, cnt, total, least, most) over a table (key, rank, n, total, least, most);
    as many levels as leave `fanout` nodes at most on top, unless told."""
    if levels is None:
        nodes, levels = -(-table.count() // fanout), 1
        while nodes > fanout:
            nodes, levels = -(-nodes // fanout), levels + 1
    return _levels(leaves(table, fanout), ONE, lambda node: F.floor(node / fanout), levels)


def box_summary(held: DataFrame, cells: int = CELLS) -> DataFrame:
    """(level, node, parent, lo1, hi1, lo2, hi2, cnt, total, least, most) over box_leaves()."""
    levels = 1
    while cells > JOINED:
        cells, levels = -(-cells // JOINED), levels + 1
    up = lambda node: F.floor(F.floor(node / STRIDE) / JOINED) * STRIDE + F.floor(node % STRIDE / JOINED)
    return _levels(held, TWO, up, levels)


def keyed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """One row a distinct key with its rank and its values' summary: what summary() is built from."""
    values = rows.groupBy("key").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return table.select("key", "rank", "n", "total").join(values, "key")


class Walk:
    """Queries on their way down a tree: for each level the nodes met, `covered` by their query or not."""

    def __init__(self, queries: DataFrame, tree: DataFrame, held: DataFrame, dims: tuple):
        self.dims, self.tree, self.held = dims, tree, held
        self.bounds = [c for d in dims for c in d]
        self.queries = queries.select("qid", *[F.col(c).alias(f"q_{c}") for c in self.bounds])
        self.top = tree.agg(F.max("level")).first()[0]
        self.open: DataFrame | None = None

    def _all(self, test: Callable[..., Column]) -> Column:
        out = F.lit(True)
        for lo, hi in self.dims:
            out = out & test(F.col(lo), F.col(hi), F.col(f"q_{lo}"), F.col(f"q_{hi}"))
        return out

    def share(self) -> Column:
        """The part of a node's rectangle that its query overlaps."""
        out = F.lit(1.0)
        for lo, hi in self.dims:
            out = out * overlap_share(F.col(lo), F.col(hi), F.col(f"q_{lo}"), F.col(f"q_{hi}"))
        return out

    def meet(self, level: int) -> DataFrame:
        """The nodes of a level, or the leaves at -1, that the queries still open meet."""
        if self.open is None:  # few nodes on top: their number doesn't grow with the table
            nodes = self.tree.where(F.col("level") == level).drop("level", "parent") if level >= 0 else self.held
            hit = self.queries.crossJoin(F.broadcast(nodes) if level >= 0 else nodes)
        else:
            nodes = self.tree.where(F.col("level") == level).drop("level") if level >= 0 else self.held.withColumnRenamed("node", "parent")
            hit = small(self.open).join(nodes, "parent")
        hit = hit.where(self._all(overlaps))
        return hit.withColumn("covered", self._all(within)) if level >= 0 else hit.withColumn("covered", F.lit(True))

    def descend(self, hit: DataFrame, stay: DataFrame | None = None) -> None:
        """Opens the nodes that aren't covered, of all queries or of those in `stay` (qid)."""
        rest = hit.where("not covered").select("qid", *[f"q_{c}" for c in self.bounds], F.col("node").alias("parent"))
        self.open = keep(rest if stay is None else rest.join(small(stay), "qid", "left_semi"), "open")


def _aggregate(queries: DataFrame, walk: Walk) -> DataFrame:
    parts = []
    if walk.top is not None:
        for level in range(walk.top, -2, -1):
            hit = walk.meet(level)
            hit = hit if level < 0 else keep(hit, "met")
            parts.append(hit.where("covered").select("qid", *SUMS))
            if level >= 0:
                walk.descend(hit)
    if not parts:
        return queries.select("qid", F.lit(0).cast("long").alias("count"), *[F.lit(None).cast("double").alias(c) for c in ("sum", "min", "max")])
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    total = every.groupBy("qid").agg(F.sum("cnt").alias("count"), F.sum("total").alias("sum"), F.min("least").alias("min"), F.max("most").alias("max"))
    return queries.select("qid").join(total, "qid", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def range_aggregate(queries: DataFrame, tree: DataFrame, table: DataFrame) -> DataFrame:
    """(qid, count, sum, min, max) over [lo, hi]."""
    return _aggregate(queries, Walk(queries, tree, leaves(table), ONE))


def box_aggregate(queries: DataFrame, tree: DataFrame, held: DataFrame) -> DataFrame:
    """(qid, count, sum, min, max) over closed boxes."""
    return _aggregate(queries, Walk(queries, tree, held, TWO))


def _progressive(queries: DataFrame, walk: Walk, enough: Column) -> DataFrame:
    """(qid, level, low, high, estimate, top_low, top_high): of COUNT and MAX, at the first level from the top at
    which `enough` holds; level -1 is the leaves, which are exact.  Queries that have enough go no further."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = "qid", "level", "low", "high", "estimate", "top_low", "top_high"
    seen, done = queries.select("qid", F.lit(0).cast("long").alias("sure"), F.lit(None).cast("double").alias("top")), []
    for level in range(walk.top if walk.top is not None else -2, -2, -1):
        hit = walk.meet(level)
        hit = hit if level < 0 else keep(hit, "met")
        covered, open_ = F.col("covered"), ~F.col("covered")
        met = hit.groupBy("qid").agg(
            F.sum(F.when(covered, F.col("cnt"))).alias("c"), F.sum(F.when(open_, F.col("cnt"))).alias("o"), F.sum(F.when(open_, F.col("cnt") * walk.share())).alias("e"),
            F.max(F.when(covered, F.col("most"))).alias("mc"), F.max(F.when(open_, F.col("most"))).alias("mo"),
        )
        now = seen.join(met, "qid", "left").withColumn("sure", F.col("sure") + zero(F.col("c"))).withColumn("top", F.greatest("top", "mc"))
        now = now.select(
            "qid", F.lit(level).alias("level"), F.col("sure").alias("low"), (F.col("sure") + zero(F.col("o"))).alias("high"),
            (F.col("sure") + zero(F.col("e"))).cast("double").alias("estimate"), F.col("top").alias("top_low"), F.greatest("top", "mo").alias("top_high"),
        )
        now = keep(now, "level")
        fine = F.lit(True) if level < 0 else F.coalesce(enough, F.lit(False)) | (F.col("high") == F.col("low"))
        done.append(now.where(fine).select(*out))
        if level >= 0:
            seen = now.where(~fine).select("qid", F.col("low").alias("sure"), F.col("top_low").alias("top"))
            walk.descend(hit, seen.select("qid"))
    if not done:
        none = F.lit(None).cast("double")
        return queries.select("qid", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), F.lit(0.0).alias("estimate"), none.alias("top_low"), none.alias("top_high"))
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return every


def _count_rule(relative: float, absolute: float | None) -> Column:
    if absolute is not None:
        return (F.col("estimate") - F.col("low") <= absolute) & (F.col("high") - F.col("estimate") <= absolute)
    return F.col("high") <= (1 + relative) * F.col("low")


def progressive(queries: DataFrame, tree: DataFrame, table: DataFrame, relative: float, absolute: float | None = None) -> DataFrame:
    """(qid, level, low, high, estimate) of COUNT: the coarsest level whose interval meets the bound, high / low
    <= 1 + relative, or both gaps to the estimate <= absolute."""
    return _progressive(queries, Walk(queries, tree, leaves(table), ONE), _count_rule(relative, absolute)).select("qid", "level", "low", "high", "estimate")


def box_progressive(queries: DataFrame, tree: DataFrame, held: DataFrame, relative: float, absolute: float | None = None) -> DataFrame:
    """(qid, level, low, high, estimate) of COUNT over closed boxes."""
    return _progressive(queries, Walk(queries, tree, held, TWO), _count_rule(relative, absolute)).select("qid", "level", "low", "high", "estimate")


def progressive_max(queries: DataFrame, tree: DataFrame, table: DataFrame, relative: float) -> DataFrame:
    """(qid, level, low, high, estimate) of MAX, null over no keys: low from covered nodes, high from all."""
    low, high = F.col("top_low"), F.col("top_high")
    found = _progressive(queries, Walk(queries, tree, leaves(table), ONE), (low > 0) & (high <= (1 + relative) * low))
    return found.select("qid", "level", low.alias("low"), high.alias("high"), (low + (high - low) / 2).alias("estimate"))


def size(tree: DataFrame) -> DataFrame:
    """One row: nodes, those of level 0 among them, and parameters, a rectangle and four sums a node."""
    rect = sum(c in tree.columns for d in (*ONE, *TWO) for c in d)
    return tree.agg(F.count("*").alias("nodes"), F.count(F.when(F.col("level") == 0, 1)).alias("leaves"), (F.count("*") * (rect + len(SUMS))).alias("parameters"))


def append(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Rows with more rows, columns by name: the summary is built anew from the result."""
    return rows.unionByName(more.select(rows.columns))


def remove(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows less those of `gone`, one for each row of it that is there; nulls equal nulls."""
    return rows.exceptAll(gone.select(rows.columns))


def load(spark, path: str) -> DataFrame:
    """A tree written by save(), over one or two keys; anything else raises an error."""
    tree = spark.read.parquet(path)
    missing = {"level", "node", "parent", *SUMS} - set(tree.columns)
    if missing or not any({c for d in dims for c in d} <= set(tree.columns) for dims in (ONE, TWO)):
        raise ValueError(f"not a block summary: {sorted(missing) or 'its rectangles'} missing")
    return tree


def save(tree: DataFrame, path: str) -> None:
    tree.write.mode("overwrite").parquet(path)
