"""Event-time windows over unbounded input: tumbling, sliding and session, with watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, time: str, aggs: list[Column], size: str, slide: str | None = None, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    """Aggregates by window; state older than the watermark is dropped."""
    w = F.window(F.col(time), size, slide) if slide else F.window(F.col(time), size)
    return stream.withWatermark(time, late).groupBy(w, *(keys or [])).agg(*aggs)


def sessions(stream: DataFrame, time: str, aggs: list[Column], gap: str, late: str = "10 minutes", keys: list[str] | None = None) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap), *(keys or [])).agg(*aggs)
