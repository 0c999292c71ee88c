"""The audit log, appended as JSON and read back in batches or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, tool string, args string, decision string, layer string, ok boolean, ms double"


def append(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def windowed(entries: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, decision, layer, n per tumbling window; works on batches and streams."""
    at = entries.withWatermark("ts", late) if entries.isStreaming else entries
    return at.groupBy(F.window("ts", width).alias("w"), "decision", "layer").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "decision", "layer", "n")


def decisions(entries: DataFrame) -> DataFrame:
    """decision, layer, n, ok_n, mean_ms."""
    return entries.groupBy("decision", "layer").agg(F.count("*").alias("n"), F.count(F.when(F.col("ok"), 1)).alias("ok_n"), F.round(F.avg("ms"), 4).alias("mean_ms"))
