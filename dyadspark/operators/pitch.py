"""Pitch statistics of segments from frame rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dyadspark import constants as C


def pitch_stats(frames: DataFrame, keys: Sequence[str] = ("segment_id",), f0: str = "f0", *, segments: DataFrame | None = None, least_voiced: float = C.MIN_VOICED_RATIO, state: str | None = None) -> DataFrame:
    """Mean, population SD and range of voiced pitch inside its 10th to 90th percentile, and the voiced share.

    The percentiles interpolate exactly and are joined back; a segment's frames are few (15 s at most), so a
    group is small. ``segments`` adds segments without frames; its column ``state`` may hold a status of
    :func:`segment_state`, which then stands, with no measurement and no voiced share.
    """
    keys = list(keys)
    own = frames.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col(f0) > 0).alias("voiced"), F.expr(f"percentile(CASE WHEN {f0} > 0 THEN {f0} END, array(0.1, 0.9))").alias("q"))
    inner = frames.join(own.select(*keys, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")), keys).where(F.col(f0) > 0).where(F.col(f0).between(F.col("lo"), F.col("hi")))
    trimmed = inner.groupBy(*keys).agg(F.avg(f0).alias("f0_mean"), F.stddev_pop(f0).alias("f0_sd"))
    if segments is not None:
        given = segments.groupBy(*keys).agg(F.max(state).alias("_state")) if state else segments.select(*keys).distinct()
        own = given.join(own, keys, "left")
    out = own.join(trimmed, keys, "left")
    n, voiced = F.coalesce("n", F.lit(0)), F.coalesce("voiced", F.lit(0))
    ratio = F.when(n > 0, voiced / n).otherwise(0.0)
    status = F.when(n == 0, "NO_PITCH_FRAMES").when(voiced == 0, "NO_VOICED_FRAMES").when(ratio < least_voiced, "LOW_VOICED_RATIO").otherwise("OK")
    status = F.when((voiced > 0) & F.col("f0_mean").isNull(), "EMPTY_TRIMMED_F0").otherwise(status)
    found = {"f0_mean": F.col("f0_mean"), "f0_sd": F.col("f0_sd"), "f0_range": F.col("q")[1] - F.col("q")[0], "voiced_ratio": ratio}
    if segments is not None and state:
        found = {c: F.when(F.col("_state").isNull(), v) for c, v in found.items()}
        status = F.coalesce("_state", status)
    return out.select(*keys, *[v.alias(c) for c, v in found.items()], status.alias("status_prosody"))


def frames_in_segments(frames: DataFrame, segments: DataFrame, *, key: str = "path", time: str = "time", start: str = "start", end: str = "end", bucket: float = C.MAX_SEGMENT) -> DataFrame:
    """Every frame with each segment of its recording that it lies in, ``start <= time < end``; segments may overlap.

    An equi-join on stretches of ``bucket``, the length of the longest segments: a segment stands in two of them at most
    and a frame in one, so the work grows with the frames and not with frames times segments of a recording.
    """
    spread = segments.where(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    met = frames.withColumn("_b", F.floor(F.col(time) / bucket)).join(spread, [key, "_b"])
    return met.where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b")


def segment_state(start: Column, end: Column, duration: Column, analysed: Column | None = None, *, shortest: float = 0.05) -> Column:
    """Why a clip cannot be measured at all: bounds outside the recording, too short, analysis failed; else null."""
    bad = F.coalesce((start < 0) | (end <= start) | (start >= duration), F.lit(True))
    failed = F.lit(False) if analysed is None else ~F.coalesce(analysed, F.lit(False))
    return F.when(bad, "SEGMENT_INVALID_FOR_PITCH").when(F.least(end, duration) - start < shortest, "SEGMENT_TOO_SHORT_FOR_PITCH").when(failed, "PITCH_ANALYSIS_FAILED")


def relative_pitch(df: DataFrame, roles: Sequence[str] = ("prompt", "response")) -> DataFrame:
    """SD and range of pitch as shares of the segment's mean."""
    for role in roles:
        mean = F.col(f"{role}_f0_mean")
        for what in ("f0_sd", "f0_range"):
            df = df.withColumn(f"{role}_{what}", F.when(mean > 0, F.col(f"{role}_{what}") / mean))
    return df
