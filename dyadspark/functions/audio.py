"""Column functions on sample arrays and time bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_bounds(start: Column, end: Column, mode: str, longest: float = 15.0) -> Column:
    """Prompts keep their last ``longest`` units, responses their first; ``was_clipped`` says if that cut anything."""
    long = (end - start) > longest
    if mode == "prompt":
        return F.struct(F.when(long, end - longest).otherwise(start).alias("start"), end.alias("end"), long.alias("was_clipped"))
    if mode == "response":
        return F.struct(start.alias("start"), F.when(long, start + longest).otherwise(end).alias("end"), long.alias("was_clipped"))
    raise ValueError(f"mode must be prompt or response, not {mode!r}")


def latency(prompt_end: Column, response_start: Column) -> Column:
    return F.greatest(response_start - prompt_end, (response_start - prompt_end) * 0)


def overlap(prompt_end: Column, response_start: Column) -> Column:
    return F.greatest(prompt_end - response_start, (prompt_end - response_start) * 0)


def slice_samples(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """``{status, samples}`` between two times; indices round half to even."""
    a, b = F.rint(start * rate).cast("int"), F.rint(end * rate).cast("int")
    bad = (a < 0) | (b <= a) | (b > F.size(samples))
    status = F.when(samples.isNull() | (F.size(samples) == 0), "EMPTY_AUDIO").when(F.coalesce(bad, F.lit(True)), "AUDIO_SEGMENT_INVALID").otherwise("OK")
    return F.struct(status.alias("status"), F.when(status == "OK", F.slice(samples, a + 1, b - a)).alias("samples"))


def rms_normalize(samples: Column) -> Column:
    """``x / max(sqrt(mean(x^2) + 1e-8), 1e-4)``."""
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples)
    scale = F.greatest(F.sqrt(power + 1e-8), F.lit(1e-4))
    return F.transform(samples, lambda x: x / scale)
