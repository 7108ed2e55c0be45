"""From timed words and voice activity to pairs of neighbouring turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.functions import audio, text
from dyadspark.operators.intervals import as_arrays, islands, merge_intervals, refine_bounds, refine_by_join, refine_by_sweep


def valid_words(words: DataFrame) -> DataFrame:
    return words.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") > F.col("start")) & (F.trim("word") != ""))


def segment_events(words: DataFrame, keys: Sequence[str] = ("interaction", "participant"), segment: Sequence[str] = ("turn", "seg_idx"), transcripts: DataFrame | None = None) -> DataFrame:
    """One event for each segment that has a valid word.

    It starts with its first word and ends with the end of its last word in order of starts. Its text is the
    segment's own transcript if there is one that is not blank, else its words.
    """
    one = F.struct("start", *[F.col(c) for c in segment], "word_idx", "end", F.trim("word").alias("word"))
    events = valid_words(words).groupBy(*keys, *segment).agg(F.array_sort(F.collect_list(one)).alias("words"))
    events = events.withColumn("start", F.col("words")[0]["start"]).withColumn("end", F.element_at("words", -1)["end"])
    spoken = text.words_to_text(F.col("words"))
    if transcripts is None:
        return events.withColumn("transcript", spoken)
    own = transcripts.select(*keys, *segment, F.trim("transcript").alias("_own"))
    return events.join(own, [*keys, *segment], "left").withColumn("transcript", F.when(F.coalesce("_own", F.lit("")) != "", F.col("_own")).otherwise(spoken)).drop("_own")


def merge_events(events: DataFrame, keys: Sequence[str] = ("interaction", "participant"), segment: Sequence[str] = ("turn", "seg_idx"), gap: float = C.MERGE_GAP) -> DataFrame:
    """Neighbouring events of a speaker as one turn; only turns of several events have their text rebuilt from words."""
    found = islands(events, keys, "start", "end", gap, order=segment)
    merged = found.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_events"), F.array_sort(F.flatten(F.collect_list("words"))).alias("words"), F.min("transcript").alias("_only"))
    return merged.withColumn("transcript", F.when(F.col("n_events") == 1, F.col("_only")).otherwise(text.words_to_text(F.col("words")))).drop("_only", "island")


def neighbours(turns: DataFrame, interaction: str = "interaction", participant: str = "participant", carry: Sequence[str] = ("words", "transcript")) -> DataFrame:
    """Turns of both speakers in one order, with the turn before as ``prev``; rows whose neighbour is the same speaker go.

    Backchannels are still in the order here: they part their neighbours.
    """
    by = W.partitionBy(interaction).orderBy("start", "end", participant)
    rows = turns.withColumn("prev", F.lag(F.struct(participant, "start", "end", *carry)).over(by)).withColumn("place", F.row_number().over(by))
    return rows.where(F.col("prev").isNotNull() & (F.col("prev")[participant] != F.col(participant)))


def inside(words: Column, start: Column, end: Column) -> Column:
    return F.filter(words, lambda w: (w["start"] >= start) & (w["end"] <= end))


def build_pairs(words: DataFrame, vad: DataFrame, transcripts: DataFrame | None = None, *, merge_gap: float = C.MERGE_GAP, tolerance: float = C.VAD_TOLERANCE, shortest: float = C.MIN_SEGMENT, longest: float = C.MAX_SEGMENT, max_latency: float = C.MAX_LATENCY, max_overlap: float = C.MAX_OVERLAP, bucket: float | None = None, sweep: bool = False) -> DataFrame:
    """Pairs of a prompt turn and the other speaker's response.

    ``words``: interaction, participant, turn, seg_idx, word_idx, word, start, end. ``vad``: interaction,
    participant, start, end. One shuffle on interaction and participant serves merging; one on interaction
    serves the order of turns. Recordings carry their voice activity as one array, so refinement is a column
    expression without a second shuffle. For long recordings ``sweep`` refines by one pass along time instead, and
    ``bucket`` (a length of time, a few turns long) by an equi-join on time buckets, both in time that grows with the
    recording and not with its square; buckets also part a recording that is too much for one task.
    """
    keys = ("interaction", "participant")
    turns = merge_events(segment_events(words, keys, transcripts=transcripts), keys, gap=merge_gap)
    active = merge_intervals(vad, keys, "start", "end", merge_gap)
    if sweep:
        turns = refine_by_sweep(turns, active, keys, tolerance=tolerance)
    elif bucket is None:
        turns = turns.join(as_arrays(active, keys, "start", "end"), list(keys), "left").withColumn("refined", refine_bounds(F.col("start"), F.col("end"), F.col("vad"), tolerance)).drop("vad")
    else:
        spans = turns.withColumn("span_id", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("start").cast("string")))
        turns = refine_by_join(spans, active, keys, tolerance=tolerance, bucket=bucket).drop("span_id")
    if sweep or bucket is not None:
        bounds = F.struct(F.col("refined_start").alias("start"), F.col("refined_end").alias("end"))
        turns = turns.withColumn("refined", F.when(F.col("refined_start").isNotNull(), bounds)).drop("refined_start", "refined_end")
    turns = turns.withColumn("backchannel", text.is_backchannel(F.col("transcript"), F.col("words")))
    rows = neighbours(turns, carry=("words", "transcript", "refined", "backchannel"))
    rows = rows.where(~F.col("backchannel") & ~F.col("prev.backchannel") & F.col("refined").isNotNull() & F.col("prev.refined").isNotNull())
    p = audio.clip_bounds(F.col("prev.refined.start"), F.col("prev.refined.end"), "prompt", longest)
    r = audio.clip_bounds(F.col("refined.start"), F.col("refined.end"), "response", longest)
    rows = rows.withColumn("p", p).withColumn("r", r)
    rows = rows.withColumn("latency", audio.latency(F.col("p.end"), F.col("r.start"))).withColumn("overlap", audio.overlap(F.col("p.end"), F.col("r.start")))
    rows = rows.where(thresholds(F.col("p.end") - F.col("p.start"), F.col("r.end") - F.col("r.start"), F.col("latency"), F.col("overlap"), shortest, max_latency, max_overlap))
    order = W.partitionBy("interaction").orderBy("place")
    rows = rows.withColumn("turn_index", F.row_number().over(order))
    rows = rows.withColumn("prompt_words", inside(F.col("prev.words"), F.col("p.start"), F.col("p.end"))).withColumn("response_words", inside(F.col("words"), F.col("r.start"), F.col("r.end")))
    prompt, response = F.col("prev.participant"), F.col("participant")
    return rows.select(
        text.pair_id(F.col("interaction").cast("string"), prompt, response, F.col("turn_index")).alias("pair_id"),
        "interaction",
        text.dyad_id(prompt, response).alias("dyad_id"),
        prompt.alias("prompt_participant_id"),
        response.alias("response_participant_id"),
        "turn_index",
        F.col("p.start").alias("prompt_start"),
        F.col("p.end").alias("prompt_end"),
        F.col("r.start").alias("response_start"),
        F.col("r.end").alias("response_end"),
        "latency",
        "overlap",
        text.words_to_text(F.col("prompt_words")).alias("prompt_transcript"),
        text.words_to_text(F.col("response_words")).alias("response_transcript"),
        F.size("prompt_words").alias("prompt_word_count"),
        F.size("response_words").alias("response_word_count"),
        "prompt_words",
        "response_words",
    )


def thresholds(prompt: Column, response: Column, latency: Column, overlap: Column, shortest: float = C.MIN_SEGMENT, max_latency: float = C.MAX_LATENCY, max_overlap: float = C.MAX_OVERLAP) -> Column:
    return (prompt >= shortest) & (response >= shortest) & (overlap <= max_overlap) & (latency <= max_latency)


def join_dyads(dyads: DataFrame, recordings: DataFrame) -> DataFrame:
    """Each dyad with the recordings of both participants, found by path."""
    side = lambda n: recordings.select(*[F.col(c).alias(f"p{n}_{c}") for c in recordings.columns])
    out = dyads.join(side(1), F.col("participant1_relpath") == F.col("p1_path")).join(side(2), F.col("participant2_relpath") == F.col("p2_path"))
    return out


def attach_relationships(pairs: DataFrame, relationships: DataFrame, keys: Sequence[str] = ("vendor_id", "session_id")) -> DataFrame:
    """Left join that never drops a pair; a miss reads UNKNOWN. Spark broadcasts the dimension while it is small."""
    found = relationships.select(*keys, "relationship", "relationship_detail").withColumn("_hit", F.lit(True))
    out = pairs.join(found, list(keys), "left")
    detail = text.normalize_relationship_detail(F.col("relationship"), F.col("relationship_detail"))
    hit = F.col("_hit").isNotNull()
    return out.select(*pairs.columns, F.when(hit, F.col("relationship")).otherwise("UNKNOWN").alias("relationship"), F.when(hit, detail).otherwise("UNKNOWN").alias("relationship_detail"), F.when(hit, "OK").otherwise("MISSING_RELATIONSHIP_METADATA").alias("status_relationship"))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the last in the given order, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
