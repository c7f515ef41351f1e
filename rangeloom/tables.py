"""Small shared helpers: tables between rounds, and checked broadcasts.

Tables go below the folder that the cluster names in spark.checkpoint.dir, so every executor can read
them again after another one is lost; that folder is emptied when a job is over, as checkpoints are.
Where the setting is missing, as in tests, a folder on this machine takes its place.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; on one machine a temporary one may stand in."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    # local-cluster has executors of its own, each with its own temporary folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _fallback.setdefault("at", tempfile.mkdtemp(prefix="rangeloom-"))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int = 2 * BROADCAST_ROWS) -> bool:
    """Whether a written table holds at most `rows` rows (counted, not estimated)."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is counted to hold at most `rows` rows, else as it is.  What is dear
    to compute is written first, or it is computed twice."""
    return F.broadcast(df) if is_small(df, rows) else df
