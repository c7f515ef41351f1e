"""Readers and writers of the engine's tables: typed, never by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas of delimited inputs by role.
SCHEMAS = {
    "keys": "key double, cum double",
    "measures": "key double, id double, value double",
    "points": "k1 double, k2 double",
    "surface": "k1 double, k2 double, f double",
    "ranges": "qid long, lo double, hi double",
    "ranges_by_selectivity": "qid long, selectivity double, lo double, hi double",
    "boxes": "qid long, lo1 double, lo2 double, hi1 double, hi2 double",
    "truth": "qid long, exact double",
    "buckets": "key double, bucket int",
    "metrics": "tag string, queries long, abs_error double, rel_error double, hits long, refined long, models long, parameters long, bytes long",
}


def read(spark: SparkSession, path: str, role: str | None = None, format: str = "parquet", header: bool = False) -> DataFrame:
    """A table by path; delimited files take the schema of their role."""
    if format == "parquet":
        return spark.read.parquet(path)
    if role not in SCHEMAS:
        raise ValueError(f"role must be one of {sorted(SCHEMAS)}")
    reader = spark.read.schema(SCHEMAS[role])
    return reader.csv(path, header=header) if format == "csv" else reader.format(format).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Arrays are written as text where the format has none."""
    if format == "csv":
        flat = [f"concat_ws(' ', `{c}`) AS `{c}`" if kind.startswith("array") else f"`{c}`" for c, kind in df.dtypes]
        df.selectExpr(*flat).write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).format(format).save(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """One more row of results."""
    write(metrics, path, "csv", "append")
