"""Windowed aggregates over event time, the same for streams and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    # watermarks need an instant; a timestamp without a zone is taken as UTC by the session's zone
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late) if late else events


def _sums(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")]


def _flat(df: DataFrame, *by: str) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *by, "n", "total")


def tumbling(events: DataFrame, length: str, *by: str, time: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _flat(_timed(events, time, late).groupBy(F.window(time, length), *by).agg(*_sums(value)), *by)


def sliding(events: DataFrame, length: str, step: str, *by: str, time: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _flat(_timed(events, time, late).groupBy(F.window(time, length, step), *by).agg(*_sums(value)), *by)


def session(events: DataFrame, gap: str, *by: str, time: str = "ts", value: str = "value", late: str | None = None) -> DataFrame:
    return _flat(_timed(events, time, late).groupBy(F.session_window(time, gap).alias("window"), *by).agg(*_sums(value)), *by)


def deduplicated(events: DataFrame, *key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is let go."""
    return _timed(events, time, late).dropDuplicatesWithinWatermark(list(key))
