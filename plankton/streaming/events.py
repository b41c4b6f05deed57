"""Windowed counts over a stream of events; the same functions run on a stored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").load(folder)


def windowed(events: DataFrame, *, size: str = "1 hour", slide: str | None = None, by: tuple[str, ...] = ("event_type",), late: str | None = None, ts: str = "ts", **measures: Column) -> DataFrame:
    """Measures for each window and key: tumbling windows, or sliding ones with `slide`.  On a stream, events later than `late` are dropped."""
    events = events.withWatermark(ts, late) if late else events
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *measures)


def sessions(events: DataFrame, *, gap: str = "30 minutes", by: tuple[str, ...] = ("user_id",), late: str | None = None, ts: str = "ts", **measures: Column) -> DataFrame:
    """Measures for each session: events of a key with less than `gap` between neighbours."""
    events = events.withWatermark(ts, late) if late else events
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *measures)
