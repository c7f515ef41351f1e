"""Cumulative functions and segments kept up to date from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fitting import bottom_up


def windowed(events: DataFrame, time: str, value: str, size: str, late: str) -> DataFrame:
    """(start, n, total, least, most) by tumbling windows; rows later than `late` are left out."""
    by = events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"))
    return by.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select("w.start", "n", "total", "least", "most")


def accumulate(events: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Count keys batch by batch into `path`; a cumulative function over it is exact at any time.
    Batches are written under their number, so a repeated batch replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.groupBy(F.col(key).cast("double").alias("key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_segments(points: DataFrame, t: float, buffer: int = 60) -> DataFrame:
    """Line segments of streams (series, x, y), x rising in each series: a series' buffered points are fitted
    bottom-up, and all but the last segment's points leave the buffer.  A series' buffer is bounded by
    `buffer` points and one segment."""
    out = "series string, x_lo double, x_hi double, intercept double, slope double, n long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        xs, ys = (list(v) for v in state.get) if state.exists else ([], [])
        new = pd.concat(list(batches)).sort_values("x")
        rows = []
        for x, y in zip(new.x, new.y):
            xs.append(float(x))
            ys.append(float(y))
            if len(xs) >= buffer:
                i, j, coef, centre, _, _ = bottom_up(np.array(xs), np.array(ys), t)[0]
                j = j if j < len(xs) else len(xs) - 1
                rows.append((key[0], xs[0], xs[j - 1], float(coef[0] - coef[1] * centre), float(coef[1]), j))
                xs, ys = xs[j:], ys[j:]
        state.update((xs, ys))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return points.groupBy("series").applyInPandasWithState(step, out, "xs array<double>, ys array<double>", "append", GroupStateTimeout.NoTimeout)
