"""Annotation of documents as they land in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftloom.operators.parse import parse_model_output
from siftloom.operators.score import HeuristicScorer, Scorer, annotate


def annotate_stream(
    spark: SparkSession, landing: str, out: str, checkpoint: str, schema: str, prompt: Column, factory: Callable[[], Scorer] = HeuristicScorer, available_now: bool = True
):
    """Reads JSON lines that land in a folder, rates them and appends Parquet; returns the running query.

    Every line is rated once, also over restarts: files and outputs are tracked in ``checkpoint``.
    """
    docs = spark.readStream.schema(schema).json(landing)
    rated = parse_model_output(annotate(docs, prompt, factory, "stream"), "output").drop("output")
    writer = rated.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by event-time window and key with a watermark: works on streams, and on tables as a plain aggregation."""
    marked = events.withWatermark(time, late)
    counted = marked.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), by, "n")
