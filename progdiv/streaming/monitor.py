"""Streams: status files handled once, and windowed counts of events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir; a local one only with a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/work/{uuid.uuid4().hex}"


def status_stream(spark: SparkSession, path: str) -> DataFrame:
    """A row for every results.jsonl (success) or error.txt (failure) that appears below path."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    p = F.col("_metadata.file_path")
    status = F.when(p.endswith("results.jsonl"), "success").when(p.endswith("error.txt"), "failure")
    return files.select(p.alias("path"), F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("experiment_id"), status.alias("status"), "value").where("status IS NOT NULL")


def each_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands what is there to handle in batches and stops; the checkpoint keeps files from being seen twice."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n and total of value by window and event type; works on streams and on tables."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each user: start, end and number of events, closed by a gap."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, schema) -> DataFrame:
    """Runs a stream over what is there, appends to Parquet, and gives the table; windows need a last watermark."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(path)
