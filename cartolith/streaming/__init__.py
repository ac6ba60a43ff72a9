"""Windowed weather aggregates over a stream: an extension, the batch operators have no streaming counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_climate(stream: DataFrame, value: str, time: str = "obs_ts", width: str = "1 hour", late: str = "2 hours", keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and extremes by tumbling window; rows later than the watermark are dropped."""
    v = F.col(value).cast("double")
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
