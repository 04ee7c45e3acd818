"""Streaming forms of windows, degrees and last messages, with watermarks; an extension of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Edges of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def window_degrees(edges: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """(src, start, degree) by event-time window; a window closes once the watermark has passed it."""
    at = F.window(time, width)
    return edges.withWatermark(time, late).groupBy("src", at).agg(F.count("*").alias("degree")).select("src", F.col("window.start").alias("start"), "degree")


def distinct_edges(edges: DataFrame, late: str = "2 days", time: str = "ts") -> DataFrame:
    """Each edge_id once, within the watermark's delay."""
    return edges.withWatermark(time, late).dropDuplicatesWithinWatermark(["edge_id"])


def last_messages(edges: DataFrame) -> DataFrame:
    """(node, nbr, t) of the last edge at each node so far; write it in complete or update mode."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")))).alias("e"), "ts", "edge_id")
    last = F.max(F.struct("ts", "edge_id", "e.nbr")).alias("m")
    return ends.groupBy("e.node").agg(last).select("node", "m.nbr", F.col("m.ts").alias("t"))
