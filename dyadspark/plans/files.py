"""Queries that write derived tables as files and read them back: readers, writers, and what runs from files to pairs."""

from __future__ import annotations

import contextlib
import re
import struct
import uuid

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.constants import RESPONSE_TARGETS
from dyadspark.functions import text
from dyadspark.operators import embed, evaluate, merge, pairs, quality, voice
from dyadspark.operators.checkpoints import ensure_checkpoint_dir, stored
from dyadspark.plans import fixtures as X
from dyadspark.plans.natural import natural_pairs as build_natural
from dyadspark.plans.natural import natural_violations as build_violations
from dyadspark.plans.probe_pairs import item_violations
from dyadspark.plans.probe_pairs import probe_pairs as build_probe
from dyadspark.sources import pcm, tables

QUERIES = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which the driver and all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _rename(spark: SparkSession, folder: str, name) -> None:
    """The files that Spark wrote to ``folder/i=<value>`` as ``folder/<name(value)>``."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.globStatus(path(f"{folder}/i=*/part-*")):
        at = part.getPath()
        fs.rename(at, path(f"{folder}/{name(at.getParent().getName().removeprefix('i='))}"))


@_query
def dyads_file(spark: SparkSession, d: str) -> DataFrame:
    """Dyads from two folders of CSV files whose columns come in different orders."""
    k = F.col("o_orderkey")
    second = F.regexp_replace("path", r"_P\d+\.wav$", F.concat(F.lit("_P"), F.col("o_custkey") + 1, F.lit(".wav")))
    rows = X.order_paths(spark, d).select(k, F.when(k % 2 == 0, F.concat(F.lit("P"), "o_custkey")).otherwise(F.concat(F.lit(" "), "o_custkey")).alias("participant1_id"), F.col("path").alias("participant1_relpath"), (F.col("o_custkey") + 1).cast("string").alias("participant2_id"), second.alias("participant2_relpath"))
    to = _folder(spark)
    names = ["participant1_id", "participant1_relpath", "participant2_id", "participant2_relpath"]
    _write_csv(rows.where(k % 3 == 0).select(*names), f"{to}/a")
    _write_csv(rows.where(k % 3 != 0).select(F.lit("x").alias("note"), *reversed(names)), f"{to}/b")
    return tables.read_dyads(spark, f"{to}/*/*.csv").select("interaction_id", "session_id", "participant1_id", "participant2_id", "p2_participant", "dyad_id", "split", "p1_source_split")


@_query
def relationships_file(spark, d):
    """The last row of a key in the order of the files wins."""
    to = _folder(spark)
    _write_csv(X.relationships(spark, d).orderBy("place").select("vendor_id", F.col("session_id").cast("string").alias("session_id"), "relationship", "relationship_detail"), to)
    return tables.read_relationships(spark, f"{to}/*.csv").select("vendor_id", "session_id", "relationship", F.coalesce("relationship_detail", F.lit("")).alias("relationship_detail"))


def _recordings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, segments and voice activity of the conversations, from one JSON document for each speaker."""
    words = X.timed_words(spark, d)
    keys = ["interaction", "participant"]
    one = F.struct("word", (F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end"))
    by_segment = words.groupBy(*keys, "turn", "seg_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", one.alias("w")))).alias("ws"))
    said = by_segment.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "seg_idx", "ws"))).alias("segments"))
    transcript = F.transform("segments", lambda s: F.struct(F.lit("").alias("transcript"), F.transform(s["ws"], lambda w: w["w"]).alias("words")))
    active = X.voice_activity(words).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col("start") / 1000.0).alias("start"), (F.col("end") / 1000.0).alias("end")))).alias("metadata:vad"))
    docs = said.select(*keys, transcript.alias("metadata:transcript")).join(active, keys, "left").select(*keys, F.to_json(F.struct("`metadata:transcript`", "`metadata:vad`")).alias("doc"))
    to = _folder(spark)

    def put(batches):
        for batch in batches:
            for i, participant, doc in zip(*[batch.column(c) for c in range(3)], strict=True):
                pcm.write_file(f"{to}/interaction={i.as_py()}/participant={participant.as_py()}/recording.json", doc.as_py().encode())
            yield batch.select(["interaction"])

    # one file for each recording, as recordings come, written by the tasks
    docs.repartition(_parts(spark, d), *keys).mapInArrow(put, "interaction long").count()
    return tables.read_recordings(spark, f"{to}/*/*/*.json")


def _parts(spark: SparkSession, d: str) -> int:
    """So many tasks that each writes about a hundred conversations: what one holds at once does not grow with the table."""
    n = X.table(spark, d, "conversations").agg(F.approx_count_distinct("conv_id")).first()[0]
    return max(8, n // 100)


def _speaker(path: Column) -> list[Column]:
    return [F.regexp_extract(path, "interaction=([^/]+)", 1).cast("long").alias("interaction"), F.regexp_extract(path, "participant=([^/]+)", 1).alias("participant")]


@_query
def recordings_file(spark, d):
    """Every recording: words, their seconds, segments, and voice activity."""
    words, segments, vad = _recordings(spark, d)
    per = lambda df, *aggs: df.groupBy(*_speaker(F.col("path"))).agg(*aggs)
    out = per(words, F.count("*").alias("n_words"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("spoken"))
    out = out.join(per(segments, F.count("*").alias("n_segments")), ["interaction", "participant"], "left")
    return out.join(per(vad, F.count("*").alias("n_vad")), ["interaction", "participant"], "left").select("interaction", "participant", "n_words", "spoken", "n_segments", F.coalesce("n_vad", F.lit(0)).alias("n_vad"))


@_query
def recordings_violations(spark, d):
    """What is wrong in documents of which some are cut off, wrongly typed, or lack fields: every violation of every one."""
    words = X.timed_words(spark, d)
    keys = ["interaction", "participant"]
    seconds = lambda c: F.col(c) / 1000.0
    k = F.col("interaction") % 11
    one = F.struct("word_idx", F.struct("word", seconds("start").alias("start"), seconds("end").alias("end")).alias("w"))
    said = words.groupBy(*keys, "turn", "seg_idx").agg(F.array_sort(F.collect_list(one)).alias("ws")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "seg_idx", "ws"))).alias("segments"))
    transcript = F.transform("segments", lambda s: F.struct(F.lit("").alias("transcript"), F.transform(s["ws"], lambda w: w["w"]).alias("words")))
    interval = F.struct(F.when(k == 2, seconds("end")).when(k != 4, seconds("start")).alias("start"), F.when(k == 2, seconds("start")).otherwise(seconds("end")).alias("end"))
    active = X.voice_activity(words).groupBy(*keys).agg(F.collect_list(interval).alias("vad"))
    docs = said.join(active, keys, "left").select(*keys, F.to_json(F.struct(F.concat_ws("|", *keys).alias("path"), transcript.alias("metadata:transcript"), F.when(k != 1, F.col("vad")).alias("metadata:vad"))).alias("value"))
    soon = F.regexp_replace("value", '^(.*?"start":)[-0-9.E]+', '$1"soon"')
    docs = docs.select(F.when(k == 0, F.expr("left(value, length(value) - 7)")).when(k == 3, soon).otherwise(F.col("value")).alias("value"))
    to = _folder(spark)
    docs.write.text(to)
    found = tables.recordings(spark, to, lines=True).violations
    return found.select("reason", F.when(F.col("reason") != "BROKEN_DOCUMENT", F.col("path")).alias("recording"), "place")


def _natural_inputs(spark, d, *, keep: bool = False) -> dict[str, DataFrame]:
    """Dyads, words, segments, voice activity and relationships of the conversations, as recordings of two speakers. With
    ``keep`` the words are computed once and stored."""
    words = X.timed_words(spark, d)
    words = stored(words) if keep else words
    path = F.format_string("/c%d_%s.json", "interaction", "participant")
    conv = words.select("interaction").distinct()
    wav = lambda n: F.format_string(f"/c%d_P%d.wav", "interaction", F.col("interaction") * 2 + n)  # noqa: E731, F541
    dyads = conv.select(F.col("interaction").cast("string").alias("interaction_id"), (F.col("interaction") % 30).cast("string").alias("session_id"), F.lit("V").alias("p1_vendor"), F.lit("train").alias("p1_source_split"), F.lit("train").alias("split"), *[c for n in (0, 1) for c in (F.concat(F.lit("P"), F.col("interaction") * 2 + n).alias(f"participant{n + 1}_id"), wav(n).alias(f"participant{n + 1}_relpath"))])
    own = words.select(path.alias("path"), (F.col("turn") * 1000 + F.col("seg_idx")).alias("seg_idx"), "word_idx", "word", "start", "end")
    segments = own.select("path", "seg_idx").distinct().withColumn("transcript", F.lit(None).cast("string"))
    vad = X.voice_activity(words).select(path.alias("path"), "start", "end")
    rel = pairs.last_wins(X.relationships(spark, d).withColumn("session_id", F.col("session_id").cast("string")), ["vendor_id", "session_id"], ["place"])
    return {"dyads": dyads, "words": own, "segments": segments, "vad": vad, "relationships": rel}


_NATURAL = {"merge_gap": 1000, "tolerance": 500, "shortest": 3000, "longest": 15000, "max_latency": 1000, "max_overlap": 250, "pause": 200, "per": 60000.0}


@_query
def natural_pairs(spark, d):
    """The whole pair table of the conversations: dyads, words, voice activity, relationships, thresholds, tempo."""
    out = build_natural(**_natural_inputs(spark, d), **_NATURAL)
    rounded = [F.round(c, 6).alias(c) for c in ("response_speech_rate_local", "response_pause_ratio_local")]
    return out.select("pair_id", "session_id", "interaction_id", "dyad_id", "prompt_participant_id", "response_participant_id", "turn_index", "source_wav_path_prompt", "source_json_path_response", "prompt_start_s", "prompt_end_s", "prompt_duration_s", "response_start_s", "response_end_s", "latency_s", "overlap_s", "prompt_transcript", "response_transcript", "prompt_word_count", "response_word_count", "relationship", "relationship_detail", "status_relationship", "status_pair", "source_dataset_split", "split", "split_unit", *rounded, "status_response_temporal", "merge_key")


@_query
def natural_pairs_pitch(spark, d):
    """The pair table with the pitch of both sides, from frames of whole recordings by time."""
    given = _natural_inputs(spark, d, keep=True)
    f0 = F.when(F.col("word_idx") % 4 == 0, 0.0).otherwise((80 + (F.length("word") * 13 + F.col("word_idx") * 7) % 200).cast("double"))
    frames = given["words"].select(F.regexp_replace("path", "json$", "wav").alias("path"), F.col("start").alias("time"), f0.alias("f0"))
    out = build_natural(**given, frames=frames, **_NATURAL)
    pitch = [F.round(f"{role}_{c}", 6).alias(f"{role}_{c}") for role in ("prompt", "response") for c in ("f0_mean", "f0_sd", "f0_range", "voiced_ratio")]
    return out.select("pair_id", *pitch, "status_prompt_prosody", "status_response_prosody")


@_query
def natural_violations(spark, d):
    """What keeps recordings out of the pair table: lost ones, disagreeing dyads, inverted and null bounds, ids given twice."""
    given = _natural_inputs(spark, d)
    k = F.regexp_extract("path", "/c([0-9]+)_", 1).cast("long")
    i = F.col("interaction_id").cast("long")
    dyads = given["dyads"].withColumns({"p1_session": F.col("session_id"), "p1_interaction": F.col("interaction_id"), "p2_vendor": F.when(i % 19 == 0, "W").otherwise("V"), "p2_session": F.col("session_id"), "p2_interaction": F.col("interaction_id"), "p2_source_split": F.col("p1_source_split")})
    dyads = dyads.unionByName(dyads.where(i % 23 == 0))
    vad = given["vad"].withColumn("start", F.when(k % 17 == 0, F.col("end") + 5).when(k % 29 != 0, F.col("start"))).where(k % 13 != 0)
    found = build_violations(dyads, given["words"].where(k % 13 != 0), vad)
    return found.groupBy("check", "key", "detail").agg(F.count("*").alias("n"))


def _probe_folder(spark, d) -> str:
    """Folders of two tracks with their metadata, some incomplete, empty or oddly named; times in milliseconds."""
    words = X.timed_words(spark, d)
    keys = ["interaction", "participant"]
    one = F.struct("word_idx", F.struct("word", "start", "end").alias("w"))
    said = words.groupBy(*keys, "turn", "seg_idx").agg(F.array_sort(F.collect_list(one)).alias("ws")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "seg_idx", "ws"))).alias("segments"))
    transcript = F.transform("segments", lambda s: F.struct(F.transform(s["ws"], lambda w: w["w"]).alias("words")))
    active = X.voice_activity(words).groupBy(*keys).agg(F.collect_list(F.struct("start", "end")).alias("vad"))
    docs = said.join(active, keys, "left").select(*keys, F.to_json(F.struct(transcript.alias("metadata:transcript"), F.coalesce("vad", F.array()).alias("metadata:vad"))).alias("doc"))
    user = F.col("participant") == F.concat(F.lit("P"), F.col("interaction") * 2)
    items = docs.groupBy("interaction").agg(F.max(F.when(user, F.col("doc"))).alias("a"), F.max(F.when(~user, F.col("doc"))).alias("b"))
    to = _folder(spark)

    def put(batches):
        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("interaction", "a", "b")], strict=True):
                i, a, b = (x.as_py() for x in row)
                name = f"{to}/{'rows' if i % 13 == 0 else 'row'}_{i}_p1_P{2 * i}_p2_P{2 * i + 1}"
                lines = ["spk,tts_model", f"A,{'synth' if i % 3 == 0 else ''}", "A,other", f"A,{'synth' if i % 3 == 0 else ''}", " ,synth"]
                lines += [] if i % 5 == 0 else [f"B,{'synth' if i % 2 == 0 else 'other'}"]
                held = {"metadata.csv": "\n".join(lines) + "\n", "speaker1_track.wav": "", "speaker2_track.wav": "", "notes/extra.txt": "", "speaker1_track.json": a or "{}", "speaker2_track.json": b or "{}"}
                pcm.make_folder(name)
                for file, content in held.items() if i % 11 else ():
                    if i % 7 or file != "speaker2_track.wav":
                        pcm.write_file(f"{name}/{file}", content.encode())
            yield batch.select(["interaction"])

    items.repartition(_parts(spark, d), "interaction").mapInArrow(put, "interaction long").count()
    return to


@_query
def probe_pairs(spark, d):
    """From folders of two tracks to the probe's pair table: complete folders only, voices by majority, flags, tempo."""
    to = _probe_folder(spark, d)
    found = tables.recordings(spark, f"{to}/*/*_track.json")
    root = re.sub("^file:/+", "/", to)
    out = build_probe(tables.item_files(spark, to), tables.read_item_metadata(spark, to), found.words, found.segments, found.vad, synthetic="synth", dataset="probe", root=root, **_NATURAL)
    short = [F.regexp_extract(c, "([^/]+/[^/]+)$", 1).alias(c) for c in ("source_wav_path_prompt", "source_json_path_response")]
    times = [F.col(c).cast("long").alias(c) for c in ("prompt_start_s", "prompt_end_s", "response_start_s", "response_end_s", "latency_s", "overlap_s")]
    return out.select("pair_id", "session_id", "interaction_id", "dyad_id", "turn_index", *short, *times, "prompt_transcript", "response_word_count", "relationship", "prompt_tts_model", "response_tts_model", "prompt_is_synthetic", "response_is_synthetic", "is_human_prompt_synthetic_response", "row_dir", "prompt_track", "response_track", "split", "split_unit", F.round("response_speech_rate_local", 6).alias("response_speech_rate_local"))


@_query
def probe_violations(spark, d):
    """Folders that cannot take part: what they lack, empty ones too, and names of another form."""
    return item_violations(tables.item_files(spark, _probe_folder(spark, d)))


@_query
def metadata_files(spark, d):
    """Prompts and answers from partitioned metadata, columns in another order for each model."""
    t = X.candidate_tables(spark, d)
    to = _folder(spark)
    safe = F.translate("model_name", "/|", "--")
    names = ["audio_path", "answer_audio_path", "transcript_question", "transcript_answer", "speakers", "conversation_id", "finish_reason", "answer_start_time"]
    for n, model in enumerate(("original", "model-a", "model-b", "model_c")):
        own = t["outputs"].where(safe == model)
        _write_csv(own.select(*names[n:], *names[:n]), f"{to}/outputs/{model}/test/all/metadata.csv")
    _write_csv(t["inputs"].select("speakers", "audio_path", "transcript_question"), f"{to}/inputs/test/all/metadata.csv")
    out = tables.read_partitioned_metadata(spark, to, "outputs").select("model_name", "split", "source_style", "audio_path", F.coalesce("answer_audio_path", F.lit("")).alias("answer_audio_path"), F.md5("transcript_answer").alias("digest"), "conversation_id", F.coalesce("answer_start_time", F.lit("")).alias("answer_start_time"))
    asked = tables.read_partitioned_metadata(spark, to, "inputs").groupBy("audio_path").agg(F.count("*").alias("n_inputs"), F.max("conversation_id").alias("input_conversation"))
    return out.join(asked, "audio_path", "left")


@_query
def transcripts_file(spark, d):
    """Transcripts beside the outputs."""
    to = _folder(spark)
    asr = X.candidate_tables(spark, d)["asr"]
    _write_csv(asr.select("ASR_transcript_answer", "answer_audio_path"), f"{to}/outputs/m1/test/calm/large_transcripts.csv")
    found = tables.read_asr_transcripts(spark, to)
    return found.select("model_name", "split", "source_style", F.coalesce("answer_audio_path", F.lit("")).alias("answer_audio_path"), F.coalesce(F.trim("ASR_transcript_answer"), F.lit("")).alias("said"))


def _pcm(samples: Column, rate: int, channels: int) -> Column:
    """A 16-bit PCM file: header and little-endian samples."""
    little = lambda v, n: F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(255)), 2, "0") for i in range(n)])
    size = F.size(samples) * 2
    fixed = f"666D74201000000001000{channels}00" + rate.to_bytes(4, "little").hex() + (rate * channels * 2).to_bytes(4, "little").hex() + f"0{2 * channels}001000"
    head = F.concat(F.lit("52494646"), little(size + 36, 4), F.lit("57415645" + fixed + "64617461"), little(size, 4))
    return F.unhex(F.concat(head, F.array_join(F.transform(samples, lambda x: little(F.rint(x * 16384).cast("int"), 2)), "")))


@_query
def audio_files(spark, d):
    """Stereo PCM made of the vectors: header fields and the mono mix."""
    e = X.table(spark, d, "embeddings").where("size(embedding) = 64")
    files = e.select(F.concat(F.lit("/a/"), F.col("vec_id"), F.lit(".wav")).alias("path"), F.when(F.col("vec_id") % 10 != 0, _pcm(F.col("embedding"), 16000, 2)).otherwise(F.unhex(F.lit("52494646"))).alias("content"))
    out = tables.decoded_audio(files, samples=True)
    return out.select("path", "sample_rate", "n_frames", "duration_s", "status", F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def _write_pcm(rows: DataFrame, folder: str, rate: int = 8000, junk: int = 5000) -> None:
    """A PCM file ``<i>.wav`` for each row ``(i, samples)``, with a long chunk before its format; every tenth is cut off."""

    def put(frames):
        for frame in frames:
            for i, samples in zip(frame["i"], frame["samples"], strict=True):
                x = np.clip(np.rint(np.asarray(samples, np.float64) * 16384), -32768, 32767).astype("<i2").tobytes()
                form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16)
                body = b"WAVE" + b"LIST" + struct.pack("<I", junk) + bytes(junk) + form + b"data" + struct.pack("<I", len(x)) + x
                pcm.write_file(f"{folder}/{i}.wav", b"RIFF" if i % 10 == 0 else b"RIFF" + struct.pack("<I", len(body)) + body)
            yield frame[["i"]]

    rows.select("i", "samples").mapInPandas(put, "i long").count()


@_query
def pcm_files(spark, d):
    """Real PCM files: headers by seeks alone, and the samples of every block."""
    e = X.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    rows = e.groupBy(F.floor(F.col("vec_id") / 8).alias("i")).agg(F.flatten(F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))["embedding"]).alias("samples"))
    to = _folder(spark)
    _write_pcm(rows, to)
    own, known = pcm.audio_blocks(spark, f"{to}/*.wav", 100)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    sums = own.groupBy("path").agg(F.count("*").alias("n_blocks"), F.max(F.size("samples")).alias("longest"), F.round(F.sum(total), 4).alias("total"))
    i = F.regexp_extract("path", "([0-9]+)[.]wav$", 1).cast("long")
    return known.join(sums, "path", "left").select(i.alias("i"), "sample_rate", "channels", "n_frames", "duration_s", "status", "bytes_read", "n_blocks", "longest", "total")


@_query
def shards_file(spark, d):
    """Shard files by number, and their union in the order of the shards."""
    to = _folder(spark)
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 16).cast("int").alias("i"))
    o.where("i <> 5").repartition("i").sortWithinPartitions("i", "o_orderkey").write.partitionBy("i").option("header", True).csv(to)
    _rename(spark, to, lambda i: f"a_shard_{i}.csv")
    rows, files = tables.read_shards(spark, f"{to}/*.csv", ["o_orderkey", "o_custkey"])
    missing = quality.shards_complete(files, 16).agg(F.max("key").alias("missing"))  # one row
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min_by("o_orderkey", "at").cast("long").alias("first"), F.max_by("o_orderkey", "at").cast("long").alias("last")).join(F.broadcast(missing))


@_query
def pairs_written(spark, d):
    """Rows written by split and read back from the folder of one split."""
    to = _folder(spark)
    p = X.order_paths(spark, d).withColumn("split", text.split_of(text.source_dataset_split(F.col("path")))).where("split IS NOT NULL")
    tables.write_pairs(p, to, ["path", "o_orderkey", "o_custkey", "split"])
    return spark.read.parquet(f"{to}/split=test").select("o_orderkey", "path")


@_query
def embeddings_written(spark, d):
    """Appending what is not there yet: the first rows of a key stay."""
    to = _folder(spark)
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("merge_key"), F.lit("prompt").alias("role"), F.col("embedding")[0].cast("double").alias("v"))
    tables.write_embeddings(e.where("merge_key % 3 = 0").withColumn("v", F.lit(-1.0)), to)
    tables.write_embeddings(e, to)
    return tables.read_embeddings(spark, to).select("merge_key", "role", F.round("v", 6).alias("v"))


@_query
def embeddings_committed(spark, d):
    """A write that fails in the middle and one that is repeated: each key once, from the first commit that has it."""
    to = _folder(spark)
    e = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("merge_key"), F.lit("prompt").alias("role"), F.size("embedding").cast("double").alias("v"))
    tables.write_embeddings(e.where("merge_key % 3 = 0").withColumn("v", F.lit(-1.0)), to)
    with contextlib.suppress(PySparkException):
        tables.write_embeddings(e.withColumn("v", F.when(F.col("merge_key") % 100 == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(-2.0)), to)
    for _ in range(2):
        tables.write_embeddings(e, to)
    return tables.read_embeddings(spark, to)


@_query
def merge_buckets(spark, d):
    """Three feature tables, bucketed by their key, joined one to one without a shuffle."""
    keys = ["l_orderkey", "l_linenumber"]
    left, right = X.feature_tables(spark, d)
    third = X.table(spark, d, "lineitem").groupBy(*keys).agg(F.max("l_discount").alias("discount"))
    buckets = merge.bucket_count(X.table(spark, d, "lineitem"))
    save = lambda df: merge.save_bucketed(df, f"features_{uuid.uuid4().hex}", keys, buckets=buckets)
    return merge.merge_bucketed([save(left), save(right), save(third)], keys)


@_query
def checked_write(spark, d):
    """A table written and checked by one job: what it holds, and how many rows fail each check."""
    line = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.when(F.col("l_orderkey") % 1000 == 0, " ").otherwise("x").alias("k"), "l_quantity", F.when(F.col("l_partkey") % 50 == 0, F.col("l_quantity") - 1).otherwise(F.col("l_quantity") + 1).alias("end"))
    twice = line.unionByName(line.where("l_orderkey % 777 = 1"))
    to = f"{_folder(spark)}/table"
    checks = {"non_empty_key": F.trim("k") != "", "interval": F.col("end") >= F.col("l_quantity"), "shipped": F.col("l_shipdate").isNotNull()}
    found = quality.write_checked(twice, to, checks, unique=["l_orderkey", "l_linenumber"], fail=False)
    facts = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(n).cast("long").alias("n")) for name, n in found.items()])
    total = spark.read.parquet(to).agg(F.count("*").alias("written"), F.sum("l_quantity").cast("double").alias("quantity"))
    return total.select(F.explode(facts).alias("f"), "written", F.round("quantity", 2).alias("quantity")).select("f.check", "f.n", "written", "quantity")


@_query
def response_targets(spark, d):
    """All response measurements of every order as rows, those that are missing too."""
    o = X.table(spark, d, "orders")
    value = lambda i: F.when(F.col("o_custkey") % (i + 5) != 0, (F.col("o_orderkey") % (i + 7)).cast("double") / 4)
    rows = o.select(F.col("o_orderkey").alias("merge_key"), *[value(i).alias(f"response_{t}") for i, t in enumerate(RESPONSE_TARGETS)])
    return evaluate.response_table(rows)


@_query
def encoder_outputs(spark, d):
    """Encoders that name their outputs: the pooled one of rank two counts, whatever else they return."""

    def encoder():
        def run(x):
            return embed.select_output({"hidden": x[:, None, :], "embedding": x.reshape(len(x), -1)[:, :4] * 2, "scale": x.sum(axis=1)})

        return run

    e = X.table(spark, d, "embeddings").where("embedding IS NOT NULL AND size(embedding) >= 4")
    rows = e.select(F.col("vec_id").alias("merge_key"), F.lit("prompt").alias("role"), F.col("embedding").alias("samples"), F.lit("OK").alias("status"))
    out = embed.embed_segments(rows, encoder)
    return out.select("merge_key", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"e{i}") for i in range(4)])


@_query
def first_rows(spark, d):
    """The first hundred line items by key: sorted output with a limit."""
    return merge.ordered(X.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")), ["l_orderkey", "l_linenumber"], 100)


@_query
def schema_checks(spark, d):
    docs = X.table(spark, d, "documents")
    return quality.schema(docs, ["doc_id", "text", "lang", "absent"], exact=True).unionByName(quality.not_empty(docs, "documents")).unionByName(quality.not_empty(docs.where("doc_id < 0"), "none"))


@_query
def embed_outputs(spark, d):
    """Sequences kept or pooled, as the output form asks."""
    e = X.table(spark, d, "embeddings").where("size(embedding) > 0").select(F.col("vec_id").alias("merge_key"), F.lit("prompt").alias("role"), F.array("embedding", "embedding", F.transform("embedding", lambda x: -x)).alias("sequence"))
    out = embed.pool_wide(e, ["merge_key"]).join(embed.pool_wide(e, ["merge_key"], how="max").withColumnRenamed("embedding", "most"), "merge_key")
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 4)
    return out.select("merge_key", total("embedding").alias("mean_total"), total("most").alias("most_total"))


@_query
def chunk_predictions(spark, d):
    """A user's model over sample chunks."""

    def model():
        return lambda parts: [{"power": float((x.astype("float64") ** 2).sum()), "n": len(x)} for x in parts]

    e = X.table(spark, d, "embeddings").where("size(embedding) > 0").select("vec_id", F.col("embedding").alias("samples"))
    return voice.predict_chunks(e, model, "power double, n int", batch=7).select("vec_id", F.round("power", 4).alias("power"), "n")
