"""Registered queries: each applies operators of the library to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadspark.functions import audio, text
from dyadspark.operators import blocks, candidates, embed, evaluate, intervals, merge, pairs, pitch, probe, quality, split, tempo, voice
from dyadspark.plans import fixtures as X
from dyadspark.sources.tables import shard_index

_MS = {"merge_gap": 1000, "tolerance": 500, "shortest": 3000, "longest": 15000, "max_latency": 1000, "max_overlap": 250}
_KEYS = ["interaction", "participant"]
QUERIES = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _r(c, alias=None):
    return F.round(c, 6).alias(alias or c)


def _turns(spark, d):
    return pairs.merge_events(pairs.segment_events(X.timed_words(spark, d)), gap=1000)


def _pairs(spark, d):
    words = X.timed_words(spark, d)
    return pairs.build_pairs(words, X.voice_activity(words), **_MS)


@_query
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).drop("prompt_words", "response_words")


@_query
def turn_pairs_buckets(spark, d):
    """The same pairs with voice activity met by time buckets, as for recordings too long for one array."""
    words = X.timed_words(spark, d)
    return pairs.build_pairs(words, X.voice_activity(words), **_MS, bucket=60_000).drop("prompt_words", "response_words")


@_query
def turn_events(spark, d):
    return _turns(spark, d).select(*_KEYS, "start", "end", "n_events", "transcript", F.size("words").alias("n_words"))


@_query
def vad_merged(spark, d):
    return intervals.merge_intervals(X.voice_activity(X.timed_words(spark, d)), _KEYS, "start", "end", 1000)


@_query
def events_merged(spark, d):
    return intervals.merge_intervals(X.event_intervals(spark, d), ["user_id"], "start", "end", 3_600_000)


@_query
def energy_gap_merge(spark, d):
    return intervals.merge_intervals(X.event_intervals(spark, d), ["user_id"], "start", "end", 3_600_000, inclusive=False)


@_query
def speech_total(spark, d):
    return intervals.total_length(X.event_intervals(spark, d), ["user_id"], "start", "end")


@_query
def backchannel_flags(spark, d):
    seg = pairs.segment_events(X.timed_words(spark, d))
    return seg.select(*_KEYS, "turn", "seg_idx", "transcript", text.is_backchannel(F.col("transcript"), F.col("words")).alias("backchannel"))


@_query
def neighbour_turns(spark, d):
    rows = pairs.neighbours(_turns(spark, d))
    return rows.select("interaction", F.col("prev.participant").alias("prompt"), F.col("participant").alias("response"), F.col("prev.end").alias("prompt_end"), F.col("start").alias("response_start"), audio.latency(F.col("prev.end"), F.col("start")).alias("latency"), audio.overlap(F.col("prev.end"), F.col("start")).alias("overlap"))


@_query
def vad_refine(spark, d):
    words = X.timed_words(spark, d)
    vad = intervals.as_arrays(intervals.merge_intervals(X.voice_activity(words), _KEYS, "start", "end", 1000), _KEYS, "start", "end")
    turns = pairs.merge_events(pairs.segment_events(words), gap=1000).join(vad, _KEYS, "left")
    r = intervals.refine_bounds(F.col("start"), F.col("end"), F.col("vad"), 500)
    return turns.withColumn("r", r).select(*_KEYS, "start", "end", F.col("r.start").alias("refined_start"), F.col("r.end").alias("refined_end"))


@_query
def vad_refine_buckets(spark, d):
    words = X.timed_words(spark, d)
    vad = intervals.merge_intervals(X.voice_activity(words), _KEYS, "start", "end", 1000)
    turns = pairs.merge_events(pairs.segment_events(words), gap=1000).select(*_KEYS, "start", "end").withColumn("span_id", F.concat_ws("|", *_KEYS, "start"))
    return intervals.refine_by_join(turns, vad, _KEYS, tolerance=500, bucket=60000).drop("span_id")


@_query
def vad_refine_sweep(spark, d):
    words = X.timed_words(spark, d)
    vad = intervals.merge_intervals(X.voice_activity(words), _KEYS, "start", "end", 1000)
    turns = pairs.merge_events(pairs.segment_events(words), gap=1000).select(*_KEYS, "start", "end")
    return intervals.refine_by_sweep(turns, vad, _KEYS, tolerance=500)


@_query
def turn_pairs_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with voice activity met by a sweep along time."""
    words = X.timed_words(spark, d)
    return pairs.build_pairs(words, X.voice_activity(words), **_MS, sweep=True).drop("prompt_words", "response_words")


@_query
def clip_bounds(spark, d):
    t = _turns(spark, d).withColumn("p", audio.clip_bounds(F.col("start"), F.col("end"), "prompt", 4000)).withColumn("r", audio.clip_bounds(F.col("start"), F.col("end"), "response", 4000))
    return t.select(*_KEYS, "start", "end", F.col("p.start").alias("prompt_start"), F.col("r.end").alias("response_end"), F.col("p.was_clipped").alias("was_clipped"))


@_query
def tempo_words(spark, d):
    t = _turns(spark, d).withColumn("t", tempo.word_tempo(F.col("words"), F.col("start"), F.col("end"), pause=200, per=60000.0))
    return t.select(*_KEYS, "start", *[_r(F.col(f"t.{c}"), c) for c in ("speech_rate_local", "articulation_rate_local", "pause_ratio_local", "mean_pause_duration_local")], F.col("t.status_temporal").alias("status_temporal"))


@_query
def word_gaps(spark, d):
    return tempo.word_tempo_rows(X.timed_words(spark, d), ["interaction", "turn"], pause=200)


@_query
def pitch_stats(spark, d):
    out = pitch.pitch_stats(X.pitch_frames(spark, d))
    return out.select("segment_id", *[_r(c) for c in ("f0_mean", "f0_sd", "f0_range", "voiced_ratio")], "status_prosody")


@_query
def pitch_relative(spark, d):
    out = pitch.pitch_stats(X.pitch_frames(spark, d)).select("segment_id", *[F.col(c).alias(f"prompt_{c}") for c in ("f0_mean", "f0_sd", "f0_range")])
    return pitch.relative_pitch(out, ["prompt"]).select("segment_id", _r("prompt_f0_sd"), _r("prompt_f0_range"))


_FRAMES = {"frame": 0.25, "hop": 0.125}


@_query
def frame_rms(spark, d):
    return tempo.frame_rms(X.signals(spark, d), **_FRAMES).select("segment_id", "frame_idx", _r("center"), _r("rms"))


@_query
def energy_vad(spark, d):
    out = tempo.energy_speech(tempo.frame_rms(X.signals(spark, d), **_FRAMES), frame=0.25, gap=0.2)
    return out.select("segment_id", _r("start"), _r("end"))


@_query
def tempo_energy(spark, d):
    speech = tempo.energy_speech(tempo.frame_rms(X.signals(spark, d), **_FRAMES), frame=0.25, gap=0.2)
    own = X.signals(spark, d).select("segment_id", F.lit(1.0).alias("duration"), (F.col("segment_id") % 7).alias("word_count"))
    out = tempo.energy_tempo(own, speech)
    return out.select("segment_id", *[_r(c) for c in ("speech_rate_local", "articulation_rate_local", "pause_ratio_local", "mean_pause_duration_local", "vad_speech_sec", "vad_pause_sec")], "status_temporal")


@_query
def rms_normalized(spark, d):
    s = X.signals(spark, d).select("segment_id", F.posexplode(audio.rms_normalize(F.col("samples"))).alias("pos", "x"))
    return s.select("segment_id", "pos", _r("x"))


@_query
def sample_slices(spark, d):
    start, end = (F.col("segment_id") % 5) / 8.0, (F.col("segment_id") % 11) / 8.0
    s = X.signals(spark, d).withColumn("s", audio.slice_samples(F.col("samples"), F.col("sample_rate"), start, end))
    return s.select("segment_id", F.col("s.status").alias("status"), F.size("s.samples").alias("n"), _r(F.aggregate("s.samples", F.lit(0.0), lambda a, x: a + x), "total"))


@_query
def voice_chunks(spark, d):
    return intervals.speech_chunks(X.event_intervals(spark, d), ["user_id"], "start", "end", longest=900_000, shortest=180_000)


def _affect(spark, d):
    """Three values of every vector: the means of its three parts."""
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) > 0")
    third = lambda i: F.expr(f"slice(embedding, int(size(embedding) * {i} / 3) + 1, int(size(embedding) * {i + 1} / 3) - int(size(embedding) * {i} / 3))")
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    return e.select(F.col("label").alias("segment_id"), *[mean(third(i)).alias(n) for i, n in enumerate(("arousal", "valence", "dominance"))])


@_query
def affect_mean(spark, d):
    return voice.affect_means(_affect(spark, d)).select("segment_id", *[_r(c) for c in ("arousal", "valence", "dominance")], "vox_num_chunks")


@_query
def affect_status(spark, d):
    seg = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("segment_id"), (F.col("s_suppkey") % 6).cast("double").alias("duration"))
    out = voice.with_vox_status(seg, voice.affect_means(_affect(spark, d)))
    return out.select("segment_id", "duration", _r("arousal"), "vox_num_chunks", "status_vox")


def _profiles(spark, d):
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL")
    return voice.speaker_profiles(e.select(F.col("label").alias("wav_key"), F.col("embedding")[0].cast("double").alias("age_raw"), F.transform("embedding", lambda x: x.cast("double")).alias("class_probs")))


@_query
def affect_speech(spark, d):
    """Chunks of the speech of each user with a value each, their means, and the seconds they stand for."""
    speech = X.event_intervals(spark, d)
    chunks = intervals.speech_chunks(speech, ["user_id"], "start", "end", longest=900_000, shortest=180_000)
    values = chunks.select("user_id", (F.col("chunk_idx") % 5).cast("double").alias("arousal"), ((F.col("chunk_end") - F.col("chunk_start")) / 1000.0).alias("valence"), F.lit(1.0).alias("dominance"))
    means = voice.affect_means(values, "user_id", speech=intervals.total_length(speech, ["user_id"], "start", "end"))
    seg = X.table(spark, d, "events").select("user_id").distinct().where("user_id IS NOT NULL").withColumn("duration", (F.col("user_id") % 6).cast("double"))
    out = voice.with_vox_status(seg, means, "user_id")
    return out.select("user_id", "duration", _r("arousal"), _r("valence"), "vox_num_chunks", "vox_support_speech_sec", "status_vox")


@_query
def clip_profiles(spark, d):
    """Profiles of clips, found by recording, start and end."""
    key = ["wav", "start_s", "end_s"]
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) > 0")
    clips = e.select(F.col("label").alias("wav"), (F.col("vec_id") % 3).cast("double").alias("start_s"), (F.col("vec_id") % 3 + 2).cast("double").alias("end_s"), F.col("embedding")[0].cast("double").alias("age_raw"), F.transform("embedding", lambda x: x.cast("double")).alias("class_probs"))
    o = X.table(spark, d, "orders")
    clip = lambda role, wav, start: [(wav % 14).cast("int").alias(f"{role}_wav"), (start % 4).cast("double").alias(f"{role}_start_s"), (start % 4 + 2).cast("double").alias(f"{role}_end_s")]
    pairs_ = o.select("o_orderkey", *clip("prompt", F.col("o_custkey"), F.col("o_orderkey")), *clip("response", F.col("o_orderkey"), F.col("o_custkey")))
    out = voice.attach_profiles(pairs_, voice.speaker_profiles(clips, key).select(*key, "age"), key, status="speaker_profile")
    return out.select("o_orderkey", _r("prompt_age"), _r("response_age"), "status_prompt_speaker_profile", "status_response_speaker_profile")


@_query
def pitch_states(spark, d):
    """Pitch of clips whose bounds may be wrong, short, or not analysed."""
    k = F.col("l_suppkey")
    seg = X.table(spark, d, "lineitem").select(k.alias("segment_id")).distinct()
    k = F.col("segment_id")
    start, end = (k % 4 - 1).cast("double"), (k % 4 - 1).cast("double") + (k % 7) * 0.02
    seg = seg.withColumn("state", pitch.segment_state(start, end, F.lit(2.0), k % 13 != 0))
    out = pitch.pitch_stats(X.pitch_frames(spark, d), segments=seg, state="state")
    return out.select("segment_id", _r("f0_mean"), _r("voiced_ratio"), "status_prosody")


@_query
def speaker_profile(spark, d):
    return _profiles(spark, d).select("wav_key", _r("age"), "gender", _r("gender_confidence"))


@_query
def profile_lookup(spark, d):
    o = X.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 12).cast("int").alias("prompt_wav_key"), (F.col("o_orderkey") % 12).cast("int").alias("response_wav_key"))
    out = voice.attach_profiles(o, _profiles(spark, d).select("wav_key", "gender"), status="speaker_profile")
    return out.select("o_orderkey", "prompt_gender", "response_gender", "status_prompt_speaker_profile", "status_response_speaker_profile")


@_query
def profile_keys(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("prompt_wav"), (F.col("o_orderkey") % 1000).alias("response_wav"))
    return voice.distinct_keys(o, ["wav"])


_BLOCK = 240  # samples; clips and frames cross block edges


@_query
def blocked_slices(spark, d):
    """Clips of long recordings, cut from the blocks they touch."""
    pieces, known = X.recordings(spark, d)
    start = F.col("offset") / 64.0 + (F.col("vec_id") % 3) / 4.0
    segments = pieces.select(F.col("vec_id").alias("segment_id"), "path", start.alias("start"), (start + (F.col("vec_id") % 7) / 2.0).alias("end"))
    out = blocks.clips(segments, blocks.to_blocks(pieces, _BLOCK), known, _BLOCK)
    return out.select("segment_id", "status", F.size("samples").alias("n"), _r(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), "total"))


@_query
def blocked_frames(spark, d):
    """RMS frames over whole recordings, with a halo where they cross block edges."""
    pieces, known = X.recordings(spark, d)
    out = blocks.frame_rms(blocks.to_blocks(pieces, _BLOCK), known, _BLOCK, **_FRAMES)
    return out.select("path", "frame_idx", _r("center"), _r("rms"))


@_query
def chunk_contents(spark, d):
    """Which stretches of time each chunk of speech holds."""
    return intervals.chunk_pieces(X.event_intervals(spark, d), ["user_id"], "start", "end", longest=900_000, shortest=180_000)


def _loudness():
    """A stand-in for a trained model: level, power and two shares of each chunk."""
    import numpy as np

    def one(x):
        x = np.asarray(x, np.float64)
        up = float((x > 0).mean())
        return {"arousal": float((x**2).mean()), "valence": float(x.mean()), "dominance": float(len(x)), "age_raw": up, "class_probs": [1 - up, up]}

    return lambda parts: [one(x) for x in parts]


@_query
def voice_from_recordings(spark, d):
    """From blocks of samples to voice features: speech by energy, chunks of it, a model, means and profile of each recording."""
    pieces, known = X.recordings(spark, d)
    stored_blocks = blocks.to_blocks(pieces, _BLOCK)
    speech = tempo.energy_speech(blocks.frame_rms(stored_blocks, known, _BLOCK, **_FRAMES), "path", frame=0.25, gap=0.2)
    ticks = speech.select("path", *[F.rint(F.col(c) * 64).cast("long").alias(c) for c in ("start", "end")])
    chunks = blocks.chunk_samples(intervals.chunk_pieces(ticks, ["path"], "start", "end", longest=960, shortest=192), stored_blocks, _BLOCK)
    found = voice.predict_chunks(chunks, _loudness, "arousal double, valence double, dominance double, age_raw double, class_probs array<double>")
    means = voice.affect_means(found, "path", speech=intervals.total_length(speech, ["path"], "start", "end"))
    out = voice.with_vox_status(known.select("path", (F.col("n_frames") / F.col("sample_rate")).alias("duration")), means, "path")
    out = out.join(voice.speaker_profiles(found, "path"), "path", "left")
    return out.select("path", "duration", *[_r(c) for c in ("arousal", "valence", "dominance")], "vox_num_chunks", _r("vox_support_speech_sec"), "status_vox", _r("age"), "gender", _r("gender_confidence"))


@_query
def stem_parse(spark, d):
    p = X.order_paths(spark, d).withColumn("n", text.parse_stem(text.stem_of(F.col("path"))))
    return p.select("o_orderkey", "n.vendor", "n.session", "n.interaction", "n.participant")


@_query
def split_from_path(spark, d):
    s = text.source_dataset_split(F.col("path"))
    return X.order_paths(spark, d).select("o_orderkey", s.alias("source_dataset_split"), text.split_of(s).alias("split"))


@_query
def dyad_ids(spark, d):
    a, b = text.canonical_participant_id(F.concat(F.lit(" P"), F.col("o_custkey"))), text.canonical_participant_id((F.col("o_orderkey") % 1000).cast("string"))
    return X.table(spark, d, "orders").select("o_orderkey", text.dyad_id(a, b).alias("dyad_id"), text.pair_id(F.col("o_orderkey").cast("string"), a, b, F.col("o_orderkey") % 20000).alias("pair_id"))


@_query
def row_dir_parse(spark, d):
    name = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("rows_"), F.col("o_orderkey"))).otherwise(F.format_string("row_%d_p1_P%d_p2_P%d", F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderkey") % 77))
    return X.table(spark, d, "orders").withColumn("r", text.parse_row_dir(name)).select("o_orderkey", "r.row_id", "r.p1", "r.p2")


@_query
def rel_normalize(spark, d):
    return X.relationships(spark, d).select("place", text.normalize_relationship_detail(F.col("relationship"), F.col("relationship_detail")).alias("detail"))


@_query
def rel_join(spark, d):
    rel = pairs.last_wins(X.relationships(spark, d), ["vendor_id", "session_id"], ["place"])
    own = X.table(spark, d, "supplier").select("s_suppkey", F.lit("V").alias("vendor_id"), (F.col("s_suppkey") % 30).cast("int").alias("session_id"))
    return pairs.attach_relationships(own, rel)


@_query
def dyad_recordings(spark, d):
    o = X.order_paths(spark, d)
    rec = o.select("path", F.col("o_custkey").alias("cust"))
    dyads = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("path").alias("participant1_relpath")).join(o.where("o_orderkey % 2 = 1").select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("path").alias("participant2_relpath")), "o_orderkey")
    return pairs.join_dyads(dyads, rec).select("o_orderkey", "p1_cust", "p2_cust")


@_query
def merge_final(spark, d):
    left, right = X.feature_tables(spark, d)
    out = merge.merge_tables(left.withColumn("quantity", F.col("quantity") / 3), right, ["l_orderkey", "l_linenumber"], key_text=["l_orderkey", "l_linenumber", "part"])
    return merge.ordered(out, ["merge_key"]).withColumn("quantity", F.round("quantity", 6))


@_query
def merge_key_text(spark, d):
    c = X.table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 7).alias("start"))
    return c.select("c_custkey", text.merge_key(["c_custkey", "start"], ["start"]).alias("merge_key"))


@_query
def merge_anti(spark, d):
    return merge.key_differences(*X.feature_tables(spark, d), ["l_orderkey", "l_linenumber"])


@_query
def merge_semi(spark, d):
    return merge.shared_keys(*X.feature_tables(spark, d), ["l_orderkey", "l_linenumber"])


@_query
def dup_report(spark, d):
    return merge.duplicate_report(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query
def shared_mismatch(spark, d):
    return merge.shared_mismatches(*X.feature_tables(spark, d), ["l_orderkey", "l_linenumber"])


@_query
def quality_violations(spark, d):
    line = X.table(spark, d, "lineitem")
    rows = X.event_intervals(spark, d).withColumn("end", F.when(F.col("user_id") % 50 == 0, F.col("start") - 1).otherwise(F.col("end")))
    out = quality.unique_key(line, ["l_orderkey", "l_linenumber"]).unionByName(quality.intervals_sane(rows, ["user_id", "start"]))
    out = out.unionByName(quality.non_empty_key(line.withColumn("k", F.when(F.col("l_orderkey") % 1000 == 0, " ").otherwise("x")), "k"))
    return out.unionByName(quality.shared_columns_agree(merge.shared_mismatches(*X.feature_tables(spark, d), ["l_orderkey", "l_linenumber"])))


@_query
def dyad_checks(spark, d):
    p = X.order_paths(spark, d).withColumn("n", text.parse_stem(text.stem_of(F.col("path")))).withColumn("s", text.source_dataset_split(F.col("path")))
    stated = F.when(F.col("o_orderkey") % 17 == 0, "P0").otherwise(F.concat(F.lit("P"), F.col("o_custkey")))
    side = lambda n, key: p.select(key.alias("interaction_id"), stated.alias(f"participant{n}_id"), *[F.col(f"n.{c}").alias(f"p{n}_{c}") for c in ("vendor", "session", "interaction", "participant")], F.col("s").alias(f"p{n}_source_split"))
    both = side(1, F.col("o_orderkey")).join(side(2, F.col("o_orderkey") - 3), "interaction_id")
    return quality.dyads_consistent(both)


@_query
def shard_audit(spark, d):
    i = (F.col("o_orderkey") % 16).cast("int")
    files = X.table(spark, d, "orders").select(i.alias("i")).distinct().where("i <> 5")
    names = files.select(F.explode(F.when(F.col("i") == 3, F.array(F.lit("a_shard_3.csv"), F.lit("b_shard_3.csv"))).when(F.col("i") == 9, F.array(F.lit("notes.csv"), F.lit("a_shard_31.csv"))).otherwise(F.array(F.format_string("a_shard_%d.csv", F.col("i"))))).alias("file_name"))
    return quality.shards_complete(names.select(shard_index(F.col("file_name")).alias("shard")), 16)


def _manifest(spark, d):
    return candidates.manifest(**X.candidate_tables(spark, d), root="/root", order=["place"])


@_query
def candidate_manifest(spark, d):
    return candidates.usable(_manifest(spark, d))


@_query
def candidate_skips(spark, d):
    return candidates.skipped(_manifest(spark, d))


@_query
def candidate_counts(spark, d):
    return candidates.counts(_manifest(spark, d))


@_query
def asr_fallback(spark, d):
    t = X.candidate_tables(spark, d)
    return candidates.asr_lookup(t["outputs"], t["asr"], ["place"]).groupBy("model_name", "source_style").agg(F.count_if(F.col("asr_text") != "").alias("heard"), F.count("*").alias("n"))


@_query
def speaker_tags(spark, d):
    t = X.table(spark, d, "documents").select("doc_id", F.concat(F.lit("P1A: "), F.coalesce("text", F.lit("")), F.lit(" P"), F.col("doc_id"), F.lit(": end")).alias("t"))
    return t.select("doc_id", text.first_speaker(F.col("t")).alias("first"), text.last_speaker(F.col("t")).alias("last"), text.participant_fallback(F.concat(F.lit(" |P"), F.col("doc_id")), 0).alias("fallback"))


@_query
def word_counts(spark, d):
    return X.table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@_query
def normalized_text(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.normalize_text(F.col("text"))).alias("digest"))


@_query
def probe_tts_majority(spark, d):
    meta = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("spk"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.col("event_type")).alias("tts_model"), F.col("event_id").alias("row_order"), (F.col("user_id") % 3).alias("row_dir"))
    return probe.majority_model(meta, ["row_dir"])


@_query
def probe_complete(spark, d):
    kinds = ["click", "view", "purchase", "signup", "logout"]
    files = X.table(spark, d, "events").select(F.col("user_id").alias("row_dir"), F.col("event_type").alias("file_name"))
    out = probe.complete_items(files, kinds)
    return out.select("row_dir", F.concat_ws(",", "missing").alias("missing"), "complete")


@_query
def probe_flags(spark, d):
    models = X.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("spk"), F.col("c_mktsegment").alias("tts_model"), F.lit(1).alias("g"))
    o = X.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("prompt_spk"), (F.col("o_orderkey") % 100).alias("response_spk"), F.lit(1).alias("g"))
    out = probe.attach_models(o, models, ["g"])
    return out.select("o_orderkey", "prompt_tts_model", "response_tts_model", *probe.voice_flags(F.col("prompt_tts_model"), F.col("response_tts_model"), "BUILDING"))


def _role_vectors(spark, d):
    e = X.table(spark, d, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 2).alias("merge_key"), F.when(F.col("vec_id") % 2 == 0, "prompt").otherwise("response").alias("role"), F.when(F.col("vec_id") % 13 == 0, "EMPTY_AUDIO").otherwise("OK").alias("status"), "embedding", F.lit(64).alias("sample_rate"))


@_query
def embed_pool(spark, d):
    e = X.table(spark, d, "embeddings").where("label IS NOT NULL")
    out = embed.pool_sequence(e, ["label"], "embedding").select("label", F.posexplode("embedding").alias("pos", "mean")).join(embed.pool_sequence(e, ["label"], "embedding", how="max").select("label", F.posexplode("embedding").alias("pos", "most")), ["label", "pos"])
    return out.select("label", "pos", _r("mean"), _r(F.col("most").cast("double"), "most"))


@_query
def embed_atomic(spark, d):
    return embed.atomic_pairs(_role_vectors(spark, d)).select("merge_key", "role", "status")


@_query
def embed_segments(spark, d):
    def encoder():
        import numpy as np

        return lambda x: np.stack([x.sum(axis=1), x.max(axis=1), x.min(axis=1)], axis=1)

    rows = embed.atomic_pairs(_role_vectors(spark, d)).withColumnRenamed("embedding", "samples")
    out = embed.embed_segments(rows, encoder)
    return out.select("merge_key", "role", *[F.round(F.col("embedding")[i].cast("double"), 3).alias(n) for i, n in enumerate(("total", "most", "least"))])


@_query
def embed_manifest(spark, d):
    rows = embed.atomic_pairs(_role_vectors(spark, d))
    done = rows.select("merge_key", "role", F.concat_ws("/", F.lit("vec"), "role", F.col("merge_key").cast("string")).alias("vec_path"), F.size("embedding").alias("vec_shape"), "status")
    return embed.manifest(rows.select("merge_key").distinct(), done, model="m1")


@_query
def embed_align(spark, d):
    rows = _role_vectors(spark, d)
    out = embed.align(rows.select("merge_key").distinct(), rows)
    return out.select("merge_key", *[_r(F.aggregate(f"{role}_embedding", F.lit(0.0), lambda s, x: s + x), f"{role}_sum") for role in ("prompt", "response")])


@_query
def embed_status(spark, d):
    rows = X.signals(spark, d).withColumn("samples", F.when(F.col("segment_id") % 9 != 0, F.col("samples"))).withColumn("sample_rate", F.when(F.col("segment_id") % 8 != 0, 64)).withColumn("start", (F.col("segment_id") % 5) / 8.0).withColumn("end", (F.col("segment_id") % 11) / 8.0)
    return embed.segment_status(rows).groupBy("status").count()


@_query
def artifact_names(spark, d):
    p = F.concat(F.lit("a|b/"), F.col("o_orderkey").cast("string"), F.lit("\\x"))
    return X.table(spark, d, "orders").select("o_orderkey", text.artifact_name(p, F.col("o_custkey").cast("string"), F.lit("prompt")).alias("name"))


def _dyads(spark, d):
    o = X.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("participant1_id"), ((F.col("o_custkey") * 31 + F.col("o_orderkey") % 3) % 20000).alias("participant2_id"))


@_query
def speaker_components(spark, d):
    return split.speaker_components(_dyads(spark, d))


@_query
def component_split(spark, d):
    dyads = _dyads(spark, d)
    parts = split.speaker_components(dyads)
    w = split.component_weights(dyads, parts)
    return w.join(split.assign_components(w), "component").select("component", "weight", "n_speakers", "split")


@_query
def history_window(spark, d):
    c = X.table(spark, d, "conversations").select(F.col("conv_id").alias("interaction_id"), F.col("turn").alias("turn_index"), F.length("text").alias("n"))
    h = evaluate.history(c, ["n"], 3)
    return h.select("interaction_id", "turn_index", F.array_join(F.transform("history", lambda x: F.coalesce(x["n"].cast("string"), F.lit("-"))), ",").alias("history"), F.array_join("history_mask", ",").alias("mask"))


@_query
def zscore(spark, d):
    line = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.lit(3.0).alias("same"))
    out = evaluate.zscore(line, ["q", "same"], F.col("l_partkey") % 10 < 6)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("q", 4).alias("q"), "same")


@_query
def mse_r2(spark, d):
    s = evaluate.regression_scores(X.predictions(spark, d), ["condition", "target"])
    return s.select("condition", "target", "n", _r("mse"), _r("r2"))


@_query
def mse_r2_mean(spark, d):
    s = evaluate.target_average(evaluate.regression_scores(X.predictions(spark, d), ["condition", "target"]), ["condition"])
    return s.select("condition", _r("mse"), _r("r2"))


@_query
def c_index(spark, d):
    return evaluate.c_index(X.predictions(spark, d), ["condition", "target"]).select("condition", "target", "comparable", _r("c_index"))


@_query
def delta_ll(spark, d):
    s = evaluate.delta_ll(evaluate.log_likelihood(X.predictions(spark, d)), ["condition", "target"])
    return s.select("condition", "target", _r("natural_ll"), _r("probe_ll"), _r("delta_ll"))


def _sweep(spark, d):
    p = X.predictions(spark, d).withColumn("condition", F.concat("condition", "target"))
    return evaluate.regression_scores(p, ["condition"]).join(evaluate.delta_ll(evaluate.log_likelihood(p), ["condition"]), "condition").select("condition", F.round("mse", 6).alias("mse"), F.round("delta_ll", 6).alias("delta_ll"))


@_query
def balanced_score(spark, d):
    return evaluate.balanced_scores(_sweep(spark, d)).select("condition", "mse", "delta_ll", _r("balanced"))


@_query
def sweep_winners(spark, d):
    p = X.predictions(spark, d)
    by = ["condition", "target"]
    s = evaluate.regression_scores(p, by).join(evaluate.delta_ll(evaluate.log_likelihood(p), by), by)
    return evaluate.winners(s.where("delta_ll IS NOT NULL").withColumns({"mse": F.round("mse", 6), "delta_ll": F.round("delta_ll", 6)}), "condition")


@_query
def ratings_summary(spark, d):
    style = ["rhythm", "emphasis", "speed", "pauses"]
    clips = evaluate.clip_ratings(X.ratings(spark, d), ["overall", *style], style=style)
    out = evaluate.condition_summary(clips, ["overall", "style_avg"], pools={"pooled": ["click", "view"]})
    return out.select("condition", "n", *[_r(f"{v}_{s}") for v in ("overall", "style_avg") for s in ("mean", "sd")])


@_query
def mann_whitney(spark, d):
    clips = evaluate.clip_ratings(X.ratings(spark, d), ["overall"]).withColumn("overall", F.round("overall", 6))
    return evaluate.mann_whitney(clips, "overall", "condition", "click", "view").select("n_a", "n_b", "u", _r("z"), _r("p"))


@_query
def response_unpivot(spark, d):
    t = tempo.word_tempo(F.col("response_words"), F.col("response_start"), F.col("response_end"), pause=200, per=60000.0)
    p = _pairs(spark, d).withColumn("t", t).select(F.col("pair_id").alias("merge_key"), (F.col("response_end") - F.col("response_start")).alias("response_duration_s"), F.col("response_word_count"), *[F.col(f"t.{c}").alias(f"response_{c}") for c in ("speech_rate_local", "pause_ratio_local")])
    return evaluate.response_table(p, targets=["duration_s", "word_count", "speech_rate_local", "pause_ratio_local"]).withColumn("value", F.round("value", 6))
