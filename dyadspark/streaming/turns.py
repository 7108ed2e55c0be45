"""Merging of a speaker's segments on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_stream(events: DataFrame, keys: tuple[str, ...] = ("interaction", "participant"), *, start: str = "start_ts", end: str = "end_ts", gap: float = 1.0, delay: str = "10 minutes") -> DataFrame:
    """Session windows whose gap runs from the end of each event: ``(keys, start, end, n_merged)``.

    Touching sessions merge, which is the inclusive rule of the batch operator.
    """
    seconds = (F.unix_micros(end) - F.unix_micros(start)) / 1e6 + gap
    window = F.session_window(start, F.make_interval(secs=seconds.cast("decimal(18,6)")))
    out = events.withWatermark(start, delay).groupBy(*keys, window).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_merged"))
    return out.select(*keys, "start", "end", "n_merged")
