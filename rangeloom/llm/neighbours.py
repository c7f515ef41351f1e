"""Largest inner products by low-dimensional stable projections.

Every vector x gets one more component sqrt(M^2 - |x|^2), M the largest norm, and a
query gets 0 there: the largest inner products are then the nearest neighbours.  Gaussian
(2-stable) projections to `DIMENSIONS` numbers keep distances: a point at distance d
lies at a projected distance whose square over d^2 is chi-square distributed.

A kd-tree over the projections cuts the table into regions; its cuts come from a sample of
`SAMPLE` rows at most, all rows are indexed.  A query looks into its own region first, then
into the next nearest ones, round by round, and carries its k-th best from round to round;
it enters a region only if that region's box passes the chi-square test with it.  Inside a
region a kd-tree's leaves come in order of their projected distance; in each, only the
projected neighbours that pass are verified on their vectors, and the walk ends when the
next leaf doesn't pass: a point as near as the k-th best would have shown up with probability
`CONFIDENCE`.  So each true neighbour is missed with probability 1 - CONFIDENCE at most.

How much is verified hangs on the data: a small share where neighbours are much nearer than
the rest, most of it where all distances are alike (the test is then right to go on).

Equal vectors are searched once.  Of a vector that many rows hold, only the k + 1 smallest
ids can be among anyone's k best, so no more of them take part.  Regions of more than
`REGION` rows are dealt by a hash into shards.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part,
neither do null ids, nor vectors of another length than most rows have (the shorter one, if
lengths are equally frequent).  Rows that repeat an id are candidates once for each different
vector, except to their own id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import is_small, stash

DIMENSIONS, CONFIDENCE, SEED = 16, 0.95, 20
SAMPLE, REGION, REGIONS, LEAF = 50_000, 4096, 1024, 128
#: Regions that a query looks into, nearest first, before its k-th best is compared with others'.
ROUNDS = (1, 5, 21, None)


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_quantile(p: float, degrees: int) -> float:
    """Where the distribution function reaches p, by bisection."""
    low, high = 0.0, 20.0 * degrees
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), degrees) < p else (low, mid)
    return high


def kd_leaves(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree that splits the widest dimension at its median."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = points[rows]
        order = np.argsort(part[:, np.argmax(np.ptp(part, axis=0))], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


class Cuts:
    """The upper part of a kd-tree: cuts at medians of a sample, down to a number of regions."""

    def __init__(self, sample: np.ndarray, regions: int):
        self.axis, self.at, self.below = [], [], []
        todo = [(np.arange(len(sample)), max(1, regions), None)]
        self.regions = 0
        while todo:
            rows, parts, parent = todo.pop(0)
            part = sample[rows]
            axis = int(np.argmax(np.ptp(part, axis=0))) if len(rows) else 0
            if parts == 1 or len(rows) < 2 or np.ptp(part[:, axis]) == 0:
                node = -1 - self.regions
                self.regions += 1
            else:
                node = len(self.axis)
                share = (parts + 1) // 2
                order = np.argsort(part[:, axis], kind="stable")
                at = float(part[order[max(1, len(rows) * share // parts) - 1], axis])
                if at == part[order[-1], axis]:  # keep something above the cut
                    at = float(part[part[:, axis] < at, axis].max())
                self.axis.append(axis)
                self.at.append(at)
                self.below.append([0, 0])
                todo += [(rows[part[:, axis] <= at], share, (node, 0)), (rows[part[:, axis] > at], parts - share, (node, 1))]
            if parent:
                self.below[parent[0]][parent[1]] = node

    def region(self, points: np.ndarray) -> np.ndarray:
        """The region of each point."""
        if not self.axis:
            return np.zeros(len(points), np.int32)
        axis, at, below = np.array(self.axis), np.array(self.at), np.array(self.below)
        node, live = np.zeros(len(points), np.int64), np.arange(len(points))
        while len(live):
            here = node[live]
            node[live] = below[here, (points[live, axis[here]] > at[here]).astype(np.int64)]
            live = live[node[live] >= 0]
        return (-1 - node).astype(np.int32)


def box_distances(targets: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of targets to boxes, targets x boxes."""
    out = np.zeros((len(targets), len(low)))
    for d in range(targets.shape[1]):
        out += np.maximum(0, np.maximum(low[:, d] - targets[:, d : d + 1], targets[:, d : d + 1] - high[:, d])) ** 2
    return out


def search(ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, queries: np.ndarray, targets: np.ndarray, bound: float, k: int, limit: float, kth: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query the (ids, scores) of its k best rows as good as `kth`, best first and ties to the smaller
    id; and how many pairs were verified.  `limit` is the chi-square quantile at which the walk stops."""
    leaves = kd_leaves(points, LEAF)
    away = box_distances(targets, np.array([points[r].min(0) for r in leaves]), np.array([points[r].max(0) for r in leaves]))
    order = np.argsort(away, axis=1, kind="stable")
    near = np.take_along_axis(away, order, axis=1)
    norms = (queries**2).sum(1) + bound * bound
    length_t, length_p = (targets**2).sum(1), (points**2).sum(1)
    best = np.full((len(queries), k), -np.inf)
    kth = np.full(len(queries), -np.inf) if kth is None else kth
    reach = lambda who: limit * np.maximum(0, norms[who] - 2 * np.maximum(best[who].min(1), kth[who]))  # noqa: E731  infinite as long as there is no k-th best
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
    live, verified = np.arange(len(queries)), 0
    live = live[near[live, 0] <= reach(live)]
    for step in range(len(leaves)):
        visits = order[live, step]
        for leaf in np.unique(visits):
            who, rows = live[visits == leaf], leaves[leaf]
            # rounding may only let more points pass
            apart = length_t[who][:, None] + length_p[rows] - 2 * (targets[who] @ points[rows].T)
            ahead = apart <= (reach(who) + 1e-9 * (length_t[who] + bound * bound))[:, None]
            verified += int(ahead.sum())
            scores = np.where(ahead, queries[who] @ vectors[rows].T, -np.inf)
            floor = np.maximum(best[who].min(1), kth[who])
            both = np.hstack([best[who], scores])
            best[who] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            hits = ahead & (scores >= (floor - 1e-9 * (1 + np.abs(floor)))[:, None])
            for i in np.flatnonzero(hits.any(1)):
                found[who[i]].append((rows[hits[i]], scores[i, hits[i]]))
        if step + 1 < len(leaves):
            live = live[near[live, step + 1] <= reach(live)]
    out = []
    for q, parts in enumerate(found):
        rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        if parts:
            floor = max(best[q].min(), kth[q])
            rows = rows[np.concatenate([p[1] for p in parts]) >= floor - 1e-9 * (1 + abs(floor))] if np.isfinite(floor) else rows
        # summed row by row, so that equal vectors have equal scores wherever they stand
        exact = (vectors[rows] * queries[q]).sum(1)
        top = np.lexsort((ids[rows], -exact))[:k]
        out.append((ids[rows[top]], exact[top]))
    return out, verified


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _floats(column: pd.Series | pa.Array, width: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    return np.frombuffer(b"".join(values), np.float64).reshape(-1, width)


def _usable(vectors: DataFrame, is_query: F.Column) -> DataFrame:
    """(vec_id, x, asks, square, v1, v2) of the rows that take part; v1 and v2 name the vector."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    return rows.where(sound).withColumn("square", square).where("square > 0").withColumn("v1", F.xxhash64("x")).withColumn("v2", F.xxhash64(F.lit(1), "x"))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 20, confidence: float = CONFIDENCE, region: int = REGION) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row of `vectors`
    (vec_id, embedding) with all other rows."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = _usable(vectors, is_query)
    lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"), F.max("square").alias("longest"))
    usual = lengths.orderBy(F.desc("n"), "width").first()
    if usual is None:
        return none
    width, bound, limit = usual.width, math.sqrt(usual.longest), chi_quantile(confidence, DIMENSIONS)
    rows = rows.where(F.size("x") == width)
    # of equal vectors the k + 1 smallest ids: the one that asks is none of its own neighbours
    same = W.partitionBy("v1", "v2").orderBy("vec_id")
    asks = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v1", "v2").distinct()
    project = np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width)
                extra = np.sqrt(np.maximum(0, bound * bound - (x**2).sum(1)))
                # a sum in a fixed order: equal vectors have equal projections
                points = sum(x[:, [i]] * project[i] for i in range(width)) + extra[:, None] * project[-1]
                columns = [batch.column(c) for c in ("vec_id", "v1", "v2", "first")]
                yield pa.RecordBatch.from_arrays([*columns, _bytes(x), _bytes(points), _bytes(points - extra[:, None] * project[-1])], names=["vec_id", "v1", "v2", "first", "x", "point", "target"])

    few = rows.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("vec_id", "x", "v1", "v2", (F.col("r") == 1).alias("first"))
    held = stash(few.mapInArrow(projected, "vec_id long, v1 long, v2 long, first boolean, x binary, point binary, target binary"), "projected")
    n = held.count()
    sample = held.select("vec_id", "v1", "point").orderBy(F.xxhash64("vec_id", "v1"), "vec_id").limit(SAMPLE).select("point").toPandas()
    cuts = Cuts(_floats(sample.point, DIMENSIONS), min(REGIONS, -(-n // region)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("region", pa.array(cuts.region(_floats(batch.column("point"), DIMENSIONS))))

    held = stash(held.mapInArrow(placed, "vec_id long, v1 long, v2 long, first boolean, x binary, point binary, target binary, region int"), "placed")

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, count = (np.full((cuts.regions, DIMENSIONS), s * np.inf) for s in (1, -1, 0))
        count = np.zeros(cuts.regions, np.int64)
        for batch in batches:
            at, points = batch.column("region").to_numpy(), _floats(batch.column("point"), DIMENSIONS)
            np.minimum.at(low, at, points)
            np.maximum.at(high, at, points)
            count += np.bincount(at, minlength=cuts.regions)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(low[some].tolist(), pa.list_(pa.float64())), pa.array(high[some].tolist(), pa.list_(pa.float64()))], names=["region", "n", "low", "high"])

    # REGIONS rows at most
    each = lambda f, c: F.array(*[f(F.col(c)[d]) for d in range(DIMENSIONS)]).alias(c)
    boxes = held.select("region", "point").mapInArrow(boxed, "region int, n long, low array<double>, high array<double>").groupBy("region").agg(F.sum("n").alias("n"), each(F.min, "low"), each(F.max, "high")).orderBy("region").collect()
    number = np.array([b.region for b in boxes])
    low, high = np.array([b.low for b in boxes]), np.array([b.high for b in boxes])
    shards = np.ones(cuts.regions, np.int64)
    shards[number] = [-(-b.n // region) for b in boxes]
    shard_of = F.array(*[F.lit(int(s)) for s in shards])[F.col("region")]
    cells = held.select("vec_id", "x", "point", "region", F.pmod(F.xxhash64("vec_id", "v1"), shard_of).cast("int").alias("shard"))

    # each different vector that asks is searched for once
    wanted = held.where("first").join(_few(stash(asks.select("v1", "v2").distinct(), "asking")), ["v1", "v2"], "left_semi")
    open_ = wanted.select("v1", "v2", "x", "target", F.lit(None).cast("double").alias("kth"))
    best, schema = None, "v1 long, v2 long, vec_id long, score double"

    def route(first: int, last: int | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    part = batch.slice(a, 1024)
                    targets, x = _floats(part.column("target"), DIMENSIONS), _floats(part.column("x"), width)
                    kth = part.column("kth").fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    away = box_distances(targets, low, high)
                    order = np.argsort(away, axis=1, kind="stable")[:, first:last]
                    passes = np.take_along_axis(away, order, axis=1) <= limit * np.maximum(0, (x**2).sum(1) + bound * bound - 2 * kth)[:, None]
                    row, col = np.nonzero(passes)
                    yield part.take(pa.array(row)).append_column("region", pa.array(number[order[row, col]].astype(np.int32)))

        return work

    def work(part: pd.DataFrame) -> pd.DataFrame:  # 64-bit columns hold no nulls here: pandas would round them
        ask = part.asks.to_numpy()
        out = []
        if ask.any() and not ask.all():
            own, other = part[~ask], part[ask]
            found, _ = search(
                own.vec_id.to_numpy(), _floats(own.x, width), _floats(own.point, DIMENSIONS), _floats(other.x, width), _floats(other.point, DIMENSIONS),
                bound, k + 1, limit, other.kth.fillna(-np.inf).to_numpy(float),
            )
            out = [(v1, v2, i, s) for v1, v2, (ids, scores) in zip(other.v1, other.v2, found) for i, s in zip(ids, scores)]
        return pd.DataFrame(out, columns=["v1", "v2", "vec_id", "score"]).astype({"v1": "int64", "v2": "int64", "vec_id": "int64", "score": "float64"})

    ranked = W.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id")
    for start, end in zip((0, *ROUNDS), ROUNDS):
        if start and start >= len(boxes):
            break
        visits = open_.mapInArrow(route(start, end), "v1 long, v2 long, x binary, target binary, kth double, region int")
        visits = visits.withColumn("shard", F.explode(F.sequence(F.lit(0), shard_of.cast("int") - 1)))
        visits = visits.select(F.lit(0).cast("long").alias("vec_id"), "x", F.col("target").alias("point"), "region", "shard", "v1", "v2", "kth", F.lit(True).alias("asks"))
        rows = cells.select("vec_id", "x", "point", "region", "shard", F.lit(0).cast("long").alias("v1"), F.lit(0).cast("long").alias("v2"), F.lit(None).cast("double").alias("kth"), F.lit(False).alias("asks"))
        hits = rows.union(visits).groupBy("region", "shard").applyInPandas(work, schema)
        hits = hits if best is None else best.union(hits)
        best = stash(hits.withColumn("r", F.row_number().over(ranked)).where(F.col("r") <= k + 1).drop("r"), "best")
        kth = best.groupBy("v1", "v2").agg(F.min("score").alias("least"), F.count("*").alias("c")).where(F.col("c") > k).select("v1", "v2", F.col("least").alias("kth"))
        open_ = wanted.join(kth, ["v1", "v2"], "left").select("v1", "v2", "x", "target", "kth")

    mine = asks.join(_few(best), ["v1", "v2"]).where("vec_id <> query_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _few(df: DataFrame) -> DataFrame:
    """A written table, sent to all executors if it was counted to be small."""
    return F.broadcast(df) if is_small(df) else df
