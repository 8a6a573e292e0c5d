"""Streaming forms of the segment windows (an extension: event time, watermarks, late rows dropped)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _counted(stream: DataFrame, window, keys: list[str]) -> DataFrame:
    out = stream.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling_counts(stream: DataFrame, time: str, keys: list[str], length: str = "30 seconds", late: str = "1 hour") -> DataFrame:
    return _counted(stream.withWatermark(time, late), F.window(time, length), keys)


def sliding_counts(stream: DataFrame, time: str, keys: list[str], length: str = "30 seconds", step: str = "25 seconds", late: str = "1 hour") -> DataFrame:
    return _counted(stream.withWatermark(time, late), F.window(time, length, step), keys)


def session_counts(stream: DataFrame, time: str, keys: list[str], gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Points that follow each other within the gap are one session."""
    return _counted(stream.withWatermark(time, late), F.session_window(time, gap), keys)
