"""Streams of small files through the engine's streaming operators."""

import numpy as np
from pyspark.sql import functions as F

from rangeloom import streaming
from rangeloom.operators.keyspace import cumulative


def test_counts_accumulate_batch_by_batch(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 40).cast("double").alias("k"))
    source = f"{tmp_path}/in"
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streaming.accumulate(stream, "k", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    counted = spark.read.parquet(f"{tmp_path}/out").groupBy("key").agg(F.sum("n").alias("n"))
    want = {r.key: r.n for r in cumulative(rows, "k").collect()}
    assert {r.key: r.n for r in counted.collect()} == want


def test_late_rows_are_left_out(spark, tmp_path):
    schema = "ts timestamp, value double"
    batches = [[("2024-01-01 00:10:00", 1.0)], [("2024-01-02 00:00:00", 2.0)], [("2024-01-02 00:30:00", 1.0)], [("2024-01-01 00:20:00", 9.0), ("2024-01-03 00:00:00", 3.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.windowed(stream, "ts", "value", "1 hour", "1 hour").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.n, r.most) for r in spark.sql("SELECT * FROM late").collect()} == {(1, 1.0), (2, 2.0)}


def test_online_segments_stay_within_their_error(spark, tmp_path):
    x = np.arange(300.0)
    y = np.where(x < 150, 2 * x, 300 - (x - 150))
    rows = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, y)], "series string, x double, y double").repartitionByRange(3, "x")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = streaming.online_segments(stream, 5.0, 40).writeStream.format("memory").queryName("segs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.sql("SELECT * FROM segs").collect()
    assert found
    for r in found:
        at = (x >= r.x_lo) & (x <= r.x_hi)
        assert np.abs(r.intercept + r.slope * x[at] - y[at]).max() <= 5 + 1e-6
