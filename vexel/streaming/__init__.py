"""Structured Streaming: batches, hourly buckets with retention, sessions, online centroids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vexel.operators import kmeans


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of a Parquet folder's files, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs work(batch, number) over what is available, then ends. A batch that is run again has the same number."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(stream: DataFrame, retention: str = "168 hours") -> DataFrame:
    """hour, key, n of an access stream (key, ts); rows later than the retention are dropped, older state is forgotten."""
    counts = stream.withWatermark("ts", retention).groupBy(F.window("ts", "1 hour"), "key").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("hour"), "key", "n")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: accesses of a key with gaps below the bound."""
    counts = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count("*").alias("n"))
    return counts.select("key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class OnlineCentroids:
    """Centroids that move with each batch towards its rows' means, by 1 / (batches + 1) of the way."""

    def __init__(self, start: np.ndarray):
        self.centroids, self.batches = np.array(start, float), 0

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        sums, weights, *_ = kmeans.step(batch, self.centroids)
        means = sums / np.where(weights > 0, weights, 1)[:, None]
        self.batches += 1
        self.centroids = np.where(weights[:, None] > 0, self.centroids + (means - self.centroids) / (self.batches + 1), self.centroids)
