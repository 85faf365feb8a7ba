"""Rows that keep coming: the stateless operators of this library work on streams as on tables.

What has state is windows over event time, with a watermark so that old windows can go: windows side by
side (like tiles of a sequence), windows that slide, and sessions (like intervals merged over gaps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, folder: str, schema, per_trigger: int = 100) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def tumbling(events: DataFrame, size: str, by: list[str], values: list[Column], slide: str | None = None, late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """(start, by, values) over windows of a size, a new one every slide."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(w.alias("w"), *by).agg(*values)
    return out.select(F.col("w.start").alias("start"), *by, *[c for c in out.columns if c not in ("w", *by)])


def sessions(events: DataFrame, gap: str, by: list[str], values: list[Column], late: str = "0 seconds", time: str = "ts") -> DataFrame:
    """(start, end, by, values) over runs of events at most a gap apart."""
    out = (events.withWatermark(time, late) if events.isStreaming else events).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*values)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in out.columns if c not in ("w", *by)])


def write(stream: DataFrame, path: str, state: str, mode: str = "append"):
    """Everything there is so far, then stop; state keeps what has been done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
