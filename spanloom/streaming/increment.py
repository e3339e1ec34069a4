"""Incremental runs: only documents that the output lacks, and a stream of them.

The batch form resumes after a break by an anti join with what is written. The stream
form runs the same operator on each micro-batch and writes it under its number, so that a
batch that is run again writes the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def missing(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without output yet; those with a null key are never done and never run."""
    return docs.where(F.col(key).isNotNull()).join(done.select(key).distinct(), key, "left_anti")


def run_stream(spark: SparkSession, schema: str, source: str, sink: str, checkpoint: str, operator: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Files that come into ``source`` through ``operator`` into ``sink``, each micro-batch once; ends when all are read."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    docs = spark.readStream.schema(schema).parquet(source)
    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, at: str, late: str, window: str, by: str) -> DataFrame:
    """Counts per window and group of a stream, with rows later than ``late`` left out by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n"))
