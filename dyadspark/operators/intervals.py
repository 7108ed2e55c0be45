"""Intervals: merging, total length, refinement against voice activity, cutting into chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, *, inclusive: bool = True, order: Sequence[str] = (), into: str = "island") -> DataFrame:
    """``df`` with the number of the merged interval each row belongs to.

    Rows are read in order of their start; one joins what came before when it starts no more than ``gap`` after
    the largest end so far (less than ``gap`` if not ``inclusive``). The largest end over all rows before equals
    the largest end of the island, so a single window does.
    """
    by = W.partitionBy(*keys).orderBy(start, *order)
    before = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col(start) - before
    breaks = F.when(before.isNull() | ((apart > gap) if inclusive else (apart >= gap)), 1).otherwise(0)
    return df.withColumn("_break", breaks).withColumn(into, F.sum("_break").over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_break")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: float, *, inclusive: bool = True) -> DataFrame:
    """``(keys, start, end, n_merged)``: disjoint intervals more than ``gap`` apart."""
    found = islands(df.where(F.col(end) > F.col(start)), keys, start, end, gap, inclusive=inclusive)
    return found.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_merged")).drop("island")


def total_length(df: DataFrame, keys: Sequence[str], start: str, end: str, into: str = "speech") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(into))


def as_arrays(df: DataFrame, keys: Sequence[str], start: str, end: str, into: str = "vad") -> DataFrame:
    """One row for each key with its intervals as an array of ``{start, end}`` in order."""
    one = F.struct(F.col(start).alias("start"), F.col(end).alias("end"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias(into))


def refine_bounds(start: Column, end: Column, vad: Column, tolerance: float = 0.5) -> Column:
    """``{start, end}`` of all intervals that touch the span; else the nearest within ``tolerance``; else null.

    ``vad`` is an array of ``{start, end}``; of equally near intervals the earliest counts.
    """
    touching = F.filter(vad, lambda v: (v["end"] >= start) & (v["start"] <= end))
    low = F.array_min(F.transform(touching, lambda v: v["start"]))
    high = F.array_max(F.transform(touching, lambda v: v["end"]))
    away = F.transform(vad, lambda v: F.struct(F.greatest(start - v["end"], v["start"] - end).alias("gap"), v["start"].alias("start"), v["end"].alias("end")))
    near = F.array_min(F.filter(away, lambda v: v["gap"] <= tolerance))
    return F.when(F.size(touching) > 0, F.struct(low.alias("start"), high.alias("end"))).when(near.isNotNull(), F.struct(near["start"].alias("start"), near["end"].alias("end")))


def refine_by_join(spans: DataFrame, vad: DataFrame, keys: Sequence[str], *, start: str = "start", end: str = "end", tolerance: float = 0.5, bucket: float = 60.0) -> DataFrame:
    """:func:`refine_bounds` for recordings too long for one array: an equi-join on time buckets.

    Both sides are put into every bucket they cover (spans widened by the tolerance), so the join never
    compares a span with intervals far from it. ``spans`` needs a column ``span_id`` that is unique.
    """
    cover = lambda a, b: F.sequence(F.floor(a / bucket), F.floor(b / bucket))
    left = spans.withColumn("_b", F.explode(cover(F.col(start) - tolerance, F.col(end) + tolerance)))
    right = vad.select(*keys, F.col(start).alias("_vs"), F.col(end).alias("_ve")).withColumn("_b", F.explode(cover(F.col("_vs"), F.col("_ve"))))
    met = left.join(right, [*keys, "_b"]).where((F.col("_ve") >= F.col(start) - tolerance) & (F.col("_vs") <= F.col(end) + tolerance))
    touch = (F.col("_ve") >= F.col(start)) & (F.col("_vs") <= F.col(end))
    gap = F.greatest(F.col(start) - F.col("_ve"), F.col("_vs") - F.col(end))
    found = met.groupBy("span_id").agg(
        F.min(F.when(touch, F.col("_vs"))).alias("_lo"),
        F.max(F.when(touch, F.col("_ve"))).alias("_hi"),
        F.min(F.when(~touch, F.struct(gap.alias("gap"), F.col("_vs").alias("s"), F.col("_ve").alias("e")))).alias("_near"),
    )
    best = found.select("span_id", F.coalesce("_lo", F.col("_near.s")).alias("refined_start"), F.coalesce("_hi", F.col("_near.e")).alias("refined_end"))
    return spans.join(best, "span_id", "left")


def speech_chunks(speech: DataFrame, keys: Sequence[str], start: str, end: str, *, longest: float = 15.0, shortest: float = 3.0) -> DataFrame:
    """``(keys, chunk_idx, chunk_start, chunk_end, speech)``: cuts of the concatenated speech of each key.

    Times count along the concatenation. Pieces under ``shortest`` are left out but count in ``speech``.
    """
    total = total_length(speech, keys, start, end)
    cuts = total.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("speech") / longest) - 1, F.lit(0)).cast("int"))))
    cuts = cuts.withColumn("chunk_start", F.col("chunk_idx") * longest).withColumn("chunk_end", F.least(F.col("chunk_start") + longest, F.col("speech")))
    return cuts.where(F.col("chunk_end") - F.col("chunk_start") >= shortest).select(*keys, "chunk_idx", "chunk_start", "chunk_end", "speech")


def chunk_pieces(speech: DataFrame, keys: Sequence[str], start: str, end: str, *, longest: float = 15.0, shortest: float = 3.0) -> DataFrame:
    """``(keys, chunk_idx, piece_idx, start, end)``: which stretches of the recording each chunk of :func:`speech_chunks` holds.

    Intervals lie on the clock of the concatenated speech by a running sum of their lengths, are cut where chunks meet,
    and go back to the recording's time. The pieces of a chunk add up to its length; chunks under ``shortest`` are left out.
    """
    length = F.col(end) - F.col(start)
    own = speech.where(F.col(end) > F.col(start))
    by = W.partitionBy(*keys).orderBy(start, end)
    clock = own.withColumn("_to", F.sum(length).over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("_from", F.col("_to") - length).withColumn("_all", F.sum(length).over(W.partitionBy(*keys)))
    cut = clock.withColumn("chunk_idx", F.explode(F.sequence(F.floor(F.col("_from") / longest), F.greatest(F.ceil(F.col("_to") / longest) - 1, F.floor(F.col("_from") / longest)))))
    low, high = F.greatest("_from", F.col("chunk_idx") * longest), F.least("_to", (F.col("chunk_idx") + 1) * longest)
    cut = cut.where((high > low) & (F.least(F.lit(longest), F.col("_all") - F.col("chunk_idx") * longest) >= shortest))
    out = cut.select(*keys, F.col("chunk_idx").cast("int").alias("chunk_idx"), (F.col(start) + low - F.col("_from")).alias(start), (F.col(start) + high - F.col("_from")).alias(end))
    return out.withColumn("piece_idx", F.row_number().over(W.partitionBy(*keys, "chunk_idx").orderBy(start, end)) - 1).select(*keys, "chunk_idx", "piece_idx", start, end)


def refine_by_sweep(spans: DataFrame, vad: DataFrame, keys: Sequence[str], *, start: str = "start", end: str = "end", tolerance: float = 0.5) -> DataFrame:
    """:func:`refine_bounds` against disjoint intervals (see :func:`merge_intervals`) by one sweep along time.

    Spans and intervals share one order for each key, and each span looks for two intervals in it: the first that ends at
    or after its start, and the last that starts at or before its end. If they touch the span they are the outermost that do;
    else they are its neighbours on both sides. There is no bucket length to choose and no row is multiplied, however
    long intervals or recordings are. Spans keep their columns and gain ``refined_start`` and ``refined_end``.
    """
    own = F.struct(*[F.col(c) for c in spans.columns])
    left = spans.select(*keys, own.alias("_span"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(None).cast(T.StructType([T.StructField("start", vad.schema[start].dataType), T.StructField("end", vad.schema[end].dataType)])).alias("_v"))
    right = vad.where(F.col(end) > F.col(start)).select(*keys, F.lit(None).cast(T.StructType(spans.schema.fields)).alias("_span"), F.col(end).alias("_s"), F.col(start).alias("_e"), F.struct(F.col(start).alias("start"), F.col(end).alias("end")).alias("_v"))
    is_span = F.col("_span").isNotNull()
    seen = lambda order: F.last("_v", ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    # of equal times intervals are read before spans, in both directions
    swept = left.unionByName(right).withColumn("_next", seen([F.col("_s").desc(), is_span])).withColumn("_before", seen([F.col("_e"), is_span])).where(is_span)
    s, e, after, before = F.col("_s"), F.col("_e"), F.col("_next"), F.col("_before")
    gap_before, gap_after = s - before["end"], after["start"] - e
    near = F.when((gap_before <= tolerance) & (gap_after.isNull() | (gap_before <= gap_after)), before).when(gap_after <= tolerance, after)
    refined = F.when(after["start"] <= e, F.struct(after["start"].alias("start"), before["end"].alias("end"))).otherwise(near)
    return swept.select("_span.*", refined["start"].alias("refined_start"), refined["end"].alias("refined_end"))
