"""Manifest of model answers: metadata joins, transcripts, paths, skips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.functions import audio, text
from dyadspark.operators.pairs import last_wins

_PROMPT = ["audio_path", "transcript_question", "speakers", "conversation_id"]


def asr_lookup(outputs: DataFrame, asr: DataFrame, order: list[str], group: tuple[str, ...] = ("model_name", "split", "source_style")) -> DataFrame:
    """``outputs`` with ``asr_text``: the transcript of the answer's path, else of its file name; the last row of a key wins.

    A row that is found counts even where its transcript is blank.
    """
    group = list(group)
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    path = F.col("answer_audio_path")
    full = last_wins(asr.select(*group, path.alias("_key"), F.trim("ASR_transcript_answer").alias("by_path"), *order), [*group, "_key"], order).select(*group, "_key", "by_path", F.lit(True).alias("_by_path"))
    base = last_wins(asr.select(*group, name(path).alias("_key"), F.trim("ASR_transcript_answer").alias("by_name"), *order), [*group, "_key"], order).select(*group, "_key", "by_name")
    out = outputs.withColumn("_key", path).join(full, [*group, "_key"], "left").withColumn("_key", name(path)).join(base, [*group, "_key"], "left")
    return out.select(*outputs.columns, F.coalesce(F.when(F.col("_by_path").isNotNull(), F.col("by_path")).otherwise(F.col("by_name")), F.lit("")).alias("asr_text"))


def manifest(outputs: DataFrame, inputs: DataFrame, asr: DataFrame, catalog: DataFrame, root: str, *, order: list[str], longest: float = C.MAX_SEGMENT, shortest: float = C.MIN_SEGMENT, session: str = "candidates", source_split: str = "candidates", split_unit: str = "candidate_question") -> DataFrame:
    """Every output row with its prompt, texts, bounds and one ``status``; :func:`usable` and :func:`skipped` split it.

    ``order`` are the columns of ``inputs`` and ``asr`` whose greatest value marks the last row of a key;
    ``catalog`` is ``(path, duration_s)``. ``session``, ``source_split`` and ``split_unit`` name the benchmark.
    """
    stem = text.stem_of(F.col("audio_path"))
    place = ["split", "source_style", "prompt_stem"]
    # one row for each set of names that lookups go by: these meet the lookups, and the texts of the outputs meet them once
    names = ["model_name", "split", "source_style", "audio_path", "answer_audio_path"]
    prompts = last_wins(inputs.withColumn("prompt_stem", stem).select(*place, *_PROMPT, *order), place, order).select(*place, *[F.col(c).alias(f"in_{c}") for c in _PROMPT], F.lit(True).alias("_hit"))
    rows = asr_lookup(outputs.select(*names).distinct(), asr, order).withColumn("prompt_stem", stem).join(prompts, place, "left")
    hit = F.col("_hit").isNotNull()
    # the prompt row's own value counts even where it is empty: columns fall back by presence of the row
    prompt = lambda c: F.coalesce(F.when(hit, F.col(f"in_{c}")).otherwise(F.col(c)), F.lit(""))
    rows = rows.withColumn("prompt_audio_path", text.resolve_path(root, prompt("audio_path"))).withColumn("response_audio_path", text.resolve_path(root, F.col("answer_audio_path")))
    known = catalog.groupBy("path").agg(F.max("duration_s").alias("duration_s"))
    for role in ("prompt", "response"):
        rows = rows.join(known.select(F.col("path").alias(f"{role}_audio_path"), F.col("duration_s").alias(f"{role}_audio_duration_s")), f"{role}_audio_path", "left")
    own = [c for c in outputs.columns if c not in names]
    found, given = rows.withColumnsRenamed({c: f"_{c}" for c in names}), outputs
    same = [given[c].eqNullSafe(found[f"_{c}"]) for c in names]
    rows = given.join(found, same).select(*names, *own, *[c for c in rows.columns if c not in names])
    rows = rows.withColumn("prompt_transcript", F.trim(prompt("transcript_question"))).withColumn("speakers", F.trim(F.coalesce("speakers", F.when(hit, F.col("in_speakers")), F.lit("")))).withColumn("conversation_id", F.coalesce("conversation_id", "in_conversation_id", F.lit("")))
    status = F.when(F.coalesce("answer_audio_path", F.lit("")) == "", "MISSING_RESPONSE_AUDIO_PATH").when(F.col("prompt_audio_duration_s").isNull(), "MISSING_PROMPT_AUDIO_FILE").when(F.col("response_audio_duration_s").isNull(), "MISSING_RESPONSE_AUDIO_FILE").otherwise("OK")
    said = F.trim(F.coalesce("transcript_answer", F.lit("")))
    rows = rows.withColumn("status", status).withColumn("response_metadata_transcript", said)
    rows = rows.withColumn("response_transcript", F.when(F.col("asr_text") != "", F.col("asr_text")).otherwise(said))
    filled = lambda a, b: F.when(a != "", a).otherwise(b)
    speakers, original = F.col("speakers"), F.col("model_name") == "original"
    zero = F.lit(0.0)
    p = audio.clip_bounds(zero, F.col("prompt_audio_duration_s"), "prompt", longest)
    r = audio.clip_bounds(zero, F.col("response_audio_duration_s"), "response", longest)
    starts = F.coalesce(F.expr("try_cast(nullif(answer_start_time, '') AS double)"), zero)
    rows = rows.withColumn("_p", p).withColumn("_r", r).withColumn("answer_start", starts).withColumn("response_stem", text.stem_of(F.col("response_audio_path")))
    return rows.select(
        F.when(F.col("status") == "OK", text.candidate_pair_id(F.col("model_name"), F.col("split"), F.col("source_style"), F.col("prompt_stem"), F.col("response_stem"))).alias("pair_id"),
        F.when(F.col("status") == "OK", text.candidate_pair_id(F.col("model_name"), F.col("split"), F.col("source_style"), F.col("prompt_stem"), F.col("response_stem"))).alias("candidate_id"),
        "status",
        F.lit(session).alias("session_id"),
        F.col("conversation_id").alias("interaction_id"),
        "model_name",
        original.alias("is_original_reference"),
        "split",
        "source_style",
        "prompt_stem",
        "response_stem",
        F.lit(source_split).alias("source_dataset_split"),
        F.lit("").alias("split_seed"),
        F.lit(split_unit).alias("split_unit"),
        "conversation_id",
        "speakers",
        F.coalesce("finish_reason", F.lit("")).alias("finish_reason") if "finish_reason" in outputs.columns else F.lit("").alias("finish_reason"),
        F.col("speakers").alias("dyad_id"),
        filled(text.last_speaker(F.col("prompt_transcript")), text.participant_fallback(speakers, 0)).alias("prompt_participant_id"),
        F.when(original, filled(text.first_speaker(said), text.participant_fallback(speakers, 1))).otherwise(F.col("model_name")).alias("response_participant_id"),
        text.turn_index_of(F.col("prompt_stem")).alias("turn_index"),
        F.col("answer_start").alias("answer_start_time"),
        F.greatest(F.col("answer_start"), zero).alias("latency_s"),
        F.greatest(-F.col("answer_start"), zero).alias("overlap_s"),
        "prompt_audio_path",
        "response_audio_path",
        F.col("prompt_audio_path").alias("source_wav_path_prompt"),
        F.col("response_audio_path").alias("source_wav_path_response"),
        F.lit("").alias("source_json_path_prompt"),
        F.lit("").alias("source_json_path_response"),
        "prompt_audio_duration_s",
        "response_audio_duration_s",
        (F.col("_p.end") - F.col("_p.start")).alias("prompt_duration_s"),
        (F.col("_r.end") - F.col("_r.start")).alias("response_duration_s"),
        F.col("_p.start").alias("prompt_clip_start_s"),
        F.col("_p.end").alias("prompt_clip_end_s"),
        F.col("_r.start").alias("response_clip_start_s"),
        F.col("_r.end").alias("response_clip_end_s"),
        F.col("_p.start").alias("prompt_start_s"),
        F.col("_p.end").alias("prompt_end_s"),
        F.col("_r.start").alias("response_start_s"),
        F.col("_r.end").alias("response_end_s"),
        F.col("_p.was_clipped").alias("prompt_was_clipped"),
        F.col("_r.was_clipped").alias("response_was_clipped"),
        (F.col("_p.end") - F.col("_p.start") >= shortest).alias("prompt_vox_compatible"),
        (F.col("_r.end") - F.col("_r.start") >= shortest).alias("response_vox_compatible"),
        "prompt_transcript",
        "response_transcript",
        "response_metadata_transcript",
        F.col("asr_text").alias("response_asr_transcript"),
        text.word_count(F.col("prompt_transcript")).alias("prompt_word_count"),
        text.word_count(F.col("response_transcript")).alias("response_word_count"),
        F.lit("UNKNOWN").alias("relationship"),
        F.lit("UNKNOWN").alias("relationship_detail"),
        F.lit("MISSING_RELATIONSHIP_METADATA").alias("status_relationship"),
        F.col("status").alias("status_pair"),
        *[F.when(F.col("status") == "OK", "OK").alias(f"status_{role}_audio") for role in ("prompt", "response")],
        F.when(hit, "INPUT_METADATA").otherwise("OUTPUT_METADATA_FALLBACK").alias("status_prompt_source"),
        F.lit("OUTPUT_METADATA").alias("status_response_source"),
        text.candidate_pair_id(F.col("model_name"), F.col("split"), F.col("source_style"), F.col("prompt_stem"), F.coalesce(text.stem_of(F.col("answer_audio_path")), F.lit(""))).alias("_skip_id"),
        F.col("audio_path").alias("_audio_path"),
        F.col("answer_audio_path").alias("_answer_audio_path"),
        (F.col("file") if "file" in outputs.columns else F.lit(None).cast("string")).alias("_metadata_csv"),
    )


def usable(rows: DataFrame) -> DataFrame:
    """The rows of :func:`manifest` with both recordings, in the columns of the candidate table."""
    return rows.where("status = 'OK'").select(*C.CANDIDATE_COLUMNS)


def skipped(rows: DataFrame) -> DataFrame:
    """The other rows: their id, where they were listed, and why they are left out."""
    given = [F.col("_skip_id").alias("pair_id"), F.col("_metadata_csv").alias("metadata_csv"), F.col("_audio_path").alias("audio_path"), F.coalesce("_answer_audio_path", F.lit("")).alias("answer_audio_path")]
    return rows.where("status <> 'OK'").select(*given, "model_name", "split", "source_style", "prompt_stem", "prompt_audio_path", "response_audio_path", "status_pair")


def counts(rows: DataFrame, by: tuple[str, ...] = ("model_name", "split", "source_style"), *, rollup: bool = False) -> DataFrame:
    """Usable and skipped rows of each model, split and style; ``rollup`` adds the sums."""
    grouped = rows.rollup(*by) if rollup else rows.groupBy(*by)
    return grouped.agg(F.count_if(F.col("status") == "OK").alias("usable"), F.count_if(F.col("status") != "OK").alias("skipped"))
