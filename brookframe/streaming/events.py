"""Streams: stateless lanes take streaming DataFrames as they are; windows over event time need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed(events: DataFrame, time: str, length: str, keys: list[str], late: str = "10 minutes", slide: str | None = None, **aggregates) -> DataFrame:
    """Tumbling (or sliding) windows by key; rows later than `late` are left out of streams. Also takes a batch."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = rows.groupBy(span.alias("w"), *keys).agg(*[c.alias(k) for k, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)
