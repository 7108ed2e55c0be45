import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.operators import candidates, embed, evaluate, merge, pitch, split, tempo, voice
from dyadspark.operators.graph import connected_components
from dyadspark.streaming.turns import merge_stream


def test_pitch_edges(spark):
    frames = [("voiced", float(x)) for x in range(100, 200, 10)] + [("silent", 0.0)] * 4 + [("one", 150.0)] + [("rare", 100.0)] + [("rare", 0.0)] * 40
    df = spark.createDataFrame(frames, "segment_id string, f0 double")
    segs = spark.createDataFrame([(k,) for k in ("voiced", "silent", "one", "rare", "none")], "segment_id string")
    got = {r.segment_id: r for r in pitch.pitch_stats(df, segments=segs).collect()}
    x = np.arange(100, 200, 10.0)
    lo, hi = np.percentile(x, [10, 90])
    inner = x[(x >= lo) & (x <= hi)]
    assert got["voiced"].f0_mean == pytest.approx(inner.mean()) and got["voiced"].f0_sd == pytest.approx(inner.std()) and got["voiced"].f0_range == pytest.approx(hi - lo)
    assert (got["silent"].status_prosody, got["silent"].f0_mean, got["silent"].voiced_ratio) == ("NO_VOICED_FRAMES", None, 0.0)
    assert (got["none"].status_prosody, got["none"].voiced_ratio) == ("NO_PITCH_FRAMES", 0.0)
    assert (got["one"].f0_sd, got["one"].status_prosody, got["rare"].status_prosody) == (0.0, "OK", "LOW_VOICED_RATIO")


def test_word_tempo(spark):
    one = "array<struct<start: double, end: double, word: string>>"
    rows = [(1, [(0.0, 0.5, "a"), (0.75, 1.0, "b"), (1.125, 2.0, "c")], 0.0, 2.0), (2, [(0.0, 1.0, "a")], 0.0, 2.0), (3, [], 0.0, 2.0)]
    df = spark.createDataFrame(rows, f"k int, w {one}, s double, e double")
    got = {r.k: r.t for r in df.select("k", tempo.word_tempo(F.col("w"), F.col("s"), F.col("e")).alias("t")).collect()}
    assert got[1].speech_rate_local == 90 and got[1].mean_pause_duration_local == 0.25
    assert got[1].articulation_rate_local == pytest.approx(180 / 1.75) and got[1].pause_ratio_local == 0.125
    assert got[2].status_temporal == got[3].status_temporal == "TOO_FEW_WORDS_FOR_TEMPORAL" and got[3].pause_ratio_local is None


def plain_speech(y, sr, frame, hop, gap):
    size, step = int(round(frame * sr)), int(round(hop * sr))
    if len(y) < size:
        return [(0.0, len(y) / sr)]
    rms = np.array([math.sqrt(np.mean(y[a : a + size] ** 2) + 1e-6) for a in range(0, len(y) - size + 1, step)])
    centers = [(a + size / 2) / sr for a in range(0, len(y) - size + 1, step)]
    loud = rms >= max(np.percentile(rms, 65) * 0.35, rms.max() * 0.05, 1e-4)
    out, begin = [], None
    for on, c in zip(loud, centers, strict=True):
        if on and begin is None:
            begin = max(0.0, c - frame / 2)
        elif not on and begin is not None:
            out.append([begin, min(len(y) / sr, c + frame / 2)])
            begin = None
    if begin is not None:
        out.append([begin, len(y) / sr])
    merged = out[:1]
    for s, e in out[1:]:
        if s - merged[-1][1] < gap:
            merged[-1][1] = e
        else:
            merged.append([s, e])
    return [tuple(x) for x in merged]


def test_energy_speech_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    signals = {"zero": np.zeros(400), "short": np.ones(10), "empty": np.zeros(0)}
    for i in range(12):
        y = rng.normal(size=1600) * np.repeat(rng.choice([0.0, 0.001, 1.0], 16), 100)
        signals[f"s{i}"] = y.astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, 400, v.tolist()) for k, v in signals.items()], "segment_id string, sample_rate int, samples array<float>")
    speech = tempo.energy_speech(tempo.frame_rms(df))
    got = {}
    for r in speech.orderBy("start").collect():
        got.setdefault(r.segment_id, []).append((r.start, r.end))
    for k, y in signals.items():
        want = plain_speech(y, 400, 0.025, 0.01, 0.2) if len(y) else []
        assert np.allclose(got.get(k, []), want), k
    segs = df.select("segment_id", (F.size("samples") / 400).alias("duration"), F.lit(1).alias("word_count")).withColumn("duration", F.greatest("duration", F.lit(1.0)))
    status = {r.segment_id: r.status_temporal for r in tempo.energy_tempo(segs, speech).collect()}
    assert status["empty"] == "NO_SPEECH_FRAMES" and status["zero"] == "TOO_FEW_WORDS_FOR_TEMPORAL"


def test_encoder_surface(spark):
    rows = [("k", "prompt", [1.0, 2.0], "OK"), ("k", "response", [1.0], "OK"), ("l", "prompt", [3.0], "OK"), ("l", "response", None, "EMPTY_AUDIO")]
    df = embed.atomic_pairs(spark.createDataFrame(rows, "merge_key string, role string, samples array<float>, status string"))
    assert sorted(r.status for r in df.collect()) == ["EMPTY_AUDIO", "OK", "OK", "SKIPPED_PAIR_FAILURE"]
    encoder = lambda: lambda x: {"z": np.zeros((len(x), 1, 1)), "output": np.stack([x.sum(axis=1), np.full(len(x), x.shape[0])], axis=1)}
    got = {r.role: list(r.embedding) for r in embed.embed_segments(df.coalesce(1), encoder, batch=2).collect()}
    assert got == {"prompt": [3.0, 2.0], "response": [1.0, 2.0]}
    seq = embed.embed_segments(df.coalesce(1), lambda: lambda x: np.stack([x, x * 2], axis=1), keep_sequence=True, pool="max").collect()
    assert {r.role: len(r.sequence) for r in seq} == {"prompt": 2, "response": 2}
    with pytest.raises(Exception, match="encoder returned"):
        embed.embed_segments(df, lambda: lambda x: np.zeros((9, 2))).collect()
    with pytest.raises(ValueError, match="rank 2"):
        embed.select_output({"a": np.zeros((2, 2)), "b": np.zeros((2, 2))})


def test_wide_pooling_agrees(spark):
    seq = spark.createDataFrame([("a", [[1.0, 5.0], [3.0, 1.0]]), ("b", [[2.0, 2.0]])], "k string, sequence array<array<float>>")
    rows = seq.select("k", F.explode("sequence").alias("vec"))
    for how in ("mean", "max"):
        a = {r.k: list(r.embedding) for r in embed.pool_wide(seq, ["k"], how=how).collect()}
        assert a == {r.k: list(r.embedding) for r in embed.pool_sequence(rows, ["k"], how=how).collect()}


def test_chunk_model(spark):
    df = spark.createDataFrame([("s", i, [float(i)] * 3) for i in range(5)], "segment_id string, chunk_idx int, samples array<float>")
    model = lambda: lambda xs: [{"arousal": float(x[0]), "valence": 0.0, "dominance": 1.0} for x in xs]
    out = voice.predict_chunks(df, model, "arousal double, valence double, dominance double", batch=2)
    assert voice.affect_means(out).first().arousal == 2.0
    with pytest.raises(Exception, match="returned"):
        voice.predict_chunks(df, lambda: lambda xs: [], "a double").collect()


def test_components_and_split(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rnd.randrange(100, 400), rnd.randrange(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 600)] + [(700, 700), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in edges[:-1]:
        x, y = sorted((find(a), find(b)))
        low[y] = x
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in low}
    assert connected_components(df.limit(0), "a", "b").count() == 0
    weights = spark.createDataFrame([(i, w) for i, w in enumerate([60, 30, 10, 1, 1])], "component long, weight long")
    parts = {r.component: r.split for r in split.assign_components(weights).collect()}
    assert (parts[0], parts[1], parts[2]) == ("train", "test", "val")


def test_merge_family(spark):
    left = spark.createDataFrame([("a", 1.00000001, 5, "p"), ("b", 2.0, 6, "q"), ("c", 3.0, None, "r")], "k string, t double, v int, pair_id string")
    right = spark.createDataFrame([("a", 1.0, 5, 0.1), ("c", 3.0, None, 0.3), ("d", 4.0, 7, 0.4)], "k string, t double, v int, w double")
    out = merge.merge_tables(left, right, ["k", "t"], key_text=["k", "t"])
    assert {(r.k, r.w, r.pair_id_old) for r in out.collect()} == {("a", 0.1, "p"), ("c", 0.3, "r")}
    assert {(r.k, r.side) for r in merge.key_differences(left.select("k"), right.select("k"), ["k"]).collect()} == {("b", "left"), ("d", "right")}
    assert [(r.column, r.mismatches) for r in merge.shared_mismatches(left, right, ["k"]).orderBy("column").collect()] == [("t", 1), ("v", 0)]
    assert [r.k for r in merge.ordered(left, ["k"], 2).collect()] == ["a", "b"] and merge.ordered(left, ["k"]).count() == 3


def test_candidate_counts_rollup(spark):
    rows = spark.createDataFrame([("m", "s", "x", "OK"), ("m", "s", "y", "MISSING_PROMPT_AUDIO_FILE")], "model_name string, split string, source_style string, status string")
    total = candidates.counts(rows, rollup=True).where("model_name IS NULL").first()
    assert (total.usable, total.skipped) == (1, 1)


def test_history_padding(spark):
    df = spark.createDataFrame([("i", t, float(t)) for t in range(1, 4)], "interaction_id string, turn_index int, x double")
    rows = evaluate.history(df, ["x"], 2).orderBy("turn_index").collect()
    assert [[h and h.x for h in r.history] for r in rows] == [[None, None], [None, 1.0], [1.0, 2.0]]
    assert [r.history_mask for r in rows] == [[0, 0], [0, 1], [1, 1]]


def test_published_sweep(spark):
    """Balanced scores of a printed table; its rounding makes ties, so some are a few ranks off."""
    mse = [0.033, 0.034, 0.025, 0.030, 0.028, 0.034, 0.040, 0.041, 0.040, 0.028, 0.035, 0.041, 0.036, 0.026, 0.034, 0.030]
    dll = [0.205, 0.306, 0.115, 0.153, 1.263, 0.472, 0.092, 0.205, 0.496, 1.096, 0.924, 1.556, 0.390, 0.405, 1.281, 1.451]
    want = [0.433, 0.367, 0.533, 0.433, 0.800, 0.500, 0.067, 0.133, 0.400, 0.800, 0.500, 0.500, 0.333, 0.700, 0.700, 0.800]
    df = spark.createDataFrame(list(zip(range(16), mse, dll, strict=True)), "i int, mse double, delta_ll double")
    got = [r.balanced for r in evaluate.balanced_scores(df).orderBy("i").collect()]
    steps = [abs(a - b) * 30 for a, b in zip(got, want, strict=True)]
    assert sum(s < 0.02 for s in steps) >= 9 and all(abs(s - round(s)) < 0.02 and s < 3.1 for s in steps)


def test_mann_whitney_small(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 5.0)] + [("b", x) for x in (2.0, 3.0, 4.0)] + [("c", 9.0)], "g string, x double")
    r = evaluate.mann_whitney(df, "x", "g", "a", "b").first()
    u = sum((x > y) + 0.5 * (x == y) for x in (1, 2, 2, 5) for y in (2, 3, 4))
    assert (r.n_a, r.n_b, r.u) == (4, 3, u) and 0 < r.p <= 1


def test_stream_of_turns(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    at = lambda s: day + dt.timedelta(seconds=s)
    rows = [(1, "A", at(0), at(2)), (1, "A", at(3), at(4)), (1, "A", at(5.5), at(6)), (1, "B", at(0), at(1))]
    spark.createDataFrame(rows, "interaction long, participant string, start_ts timestamp, end_ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("interaction long, participant string, start_ts timestamp, end_ts timestamp").parquet(str(tmp_path / "in"))
    q = merge_stream(stream).writeStream.format("memory").queryName("turns").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.participant, r.start, r.end, r.n_merged) for r in spark.table("turns").collect()}
    assert got == {("A", at(0), at(4), 2), ("A", at(5.5), at(6), 1), ("B", at(0), at(1), 1)}
