"""Cases at the edges of the operators: headers in another order, blank rows, zero divisors, large groups, repeated keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.functions import text
from dyadspark.operators import candidates, evaluate, merge, pitch, quality, split, tempo
from dyadspark.sources import tables


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    put(tmp_path / "outputs/m1/test/calm/metadata.csv", "audio_path,answer_audio_path,conversation_id\nq/a_1.wav,r/a.wav,c1\n")
    put(tmp_path / "outputs/m2/test/calm/metadata.csv", "conversation_id,audio_path,extra,answer_audio_path\nc2,q/y_2.wav,e,r/y.wav\n")
    put(tmp_path / "outputs/m3/test/[a]/metadata.csv", "audio_path\n")
    put(tmp_path / "outputs/m4/test/none/metadata.csv", "")
    got = {r.model_name: (r.audio_path, r.answer_audio_path, r.conversation_id, r.speakers) for r in tables.read_partitioned_metadata(spark, str(tmp_path), "outputs").collect()}
    assert got == {"m1": ("q/a_1.wav", "r/a.wav", "c1", None), "m2": ("q/y_2.wav", "r/y.wav", "c2", None)}


def test_a_transcript_row_that_is_found_counts_even_if_blank(spark):
    group = ("m", "test", "calm")
    outputs = spark.createDataFrame([(*group, "r/a.wav"), (*group, "r/b.wav"), (*group, "r/c.wav")], "model_name string, split string, source_style string, answer_audio_path string")
    asr = spark.createDataFrame([(*group, "r/a.wav", None, 1), (*group, "x/a.wav", "other", 2), (*group, "x/b.wav", " by name ", 3)], "model_name string, split string, source_style string, answer_audio_path string, ASR_transcript_answer string, place int")
    got = {r.answer_audio_path: r.asr_text for r in candidates.asr_lookup(outputs, asr, ["place"]).collect()}
    assert got == {"r/a.wav": "", "r/b.wav": "by name", "r/c.wav": ""}


def test_turn_numbers_of_any_length(spark):
    stems = ["a_12", "a_12345678901", "a_" + "9" * 30, "a_", "b"]
    frame = spark.createDataFrame([(s,) for s in stems], "s string").select("s", text.turn_index_of(F.col("s")).alias("i"))
    assert {r.s: r.i for r in frame.collect()} == dict(zip(stems, [12, 12345678901, None, None, None], strict=True))


def test_zero_divisors_give_null(spark):
    one = spark.createDataFrame([(1.0, "a")], "v double, g string")
    r = evaluate.mann_whitney(one, "v", "g", "a", "b").first()
    assert (r.n_a, r.n_b, r.z, r.p) == (1, 0, None, None)
    flat = spark.createDataFrame([(1.0, 2.0, 0.0), (1.0, 1.0, 1.0)], "y double, mu double, sigma double")
    assert [r.ll is None for r in evaluate.log_likelihood(flat).collect()] == [True, False]


def plain_c_index(rows):
    good = tied = n = 0
    for i, (y, mu) in enumerate(rows):
        for y2, mu2 in rows[:i]:
            if y != y2:
                n += 1
                good += (mu - mu2) * (y - y2) > 0
                tied += mu == mu2
    return n, (good + tied / 2) / n


def test_c_index_of_groups_cut_into_ranges(spark):
    rnd = random.Random(1)
    rows = {g: [(float(rnd.randrange(40)), float(rnd.randrange(30))) for _ in range(n)] for g, n in (("small", 5), ("large", 300))}
    frame = spark.createDataFrame([(g, y, mu) for g, own in rows.items() for y, mu in own], "g string, y double, mu double")
    for options in ({}, {"block_rows": 20, "most_blocks": 7}):
        got = {r.g: (r.comparable, round(r.c_index, 9)) for r in evaluate.c_index(frame, ["g"], **options).collect()}
        assert got == {g: (n, round(c, 9)) for g, own in rows.items() for n, c in [plain_c_index(own)]}


def test_pairs_are_counted_by_the_bits_of_ranks():
    rng = np.random.default_rng(0)
    for k in range(60):
        y, mu, n = rng.integers(0, 8, k).astype(float), rng.integers(0, 6, k).astype(float), rng.integers(1, 5, k)
        good = tied = comparable = 0
        for i in range(k):
            for j in range(k):
                if y[i] < y[j]:
                    comparable += n[i] * n[j]
                    tied += n[i] * n[j] * (mu[i] == mu[j])
                    good += n[i] * n[j] * (mu[i] < mu[j])
        assert evaluate.ordered_pairs(y, mu, n) == (good, tied, comparable)


def test_split_takes_the_same_greedy_choices(spark):
    rnd = random.Random(2)
    for fractions in ({"train": 0.6, "val": 0.1, "test": 0.3}, {"a": 0.5, "b": 0.5}):
        weights = sorted((rnd.choice([1, 1, 1, 2, 3, 7, 40]) for _ in range(400)), reverse=True)
        held, plain = dict.fromkeys(fractions, 0), []
        for w in weights:
            best = min(fractions, key=lambda s: abs(held[s] + w - fractions[s] * sum(weights)))
            held[best] += w
            plain.append((w, best))
        histogram = [(w, weights.count(w)) for w in sorted(set(weights), reverse=True)]
        runs = [(w, s) for w, a, b, s in split._greedy_runs(histogram, fractions) for _ in range(b - a + 1)]
        assert runs == plain
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "component long, weight long")
    got = split.assign_components(frame, fractions=fractions).collect()
    assert len(got) == 400 and len({r.component for r in got}) == 400


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.speaker: r.component for r in split.speaker_components(spark.createDataFrame(edges, "participant1_id long, participant2_id long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_merge_refuses_a_repeated_key(spark):
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    with pytest.raises(Exception, match="right table has a key more than once: 1"):
        merge.merge_tables(left, right, ["k"]).collect()
    assert merge.merge_tables(left, right, ["k"], one_to_one=False).count() == 2
    assert merge.merge_tables(left, right.limit(1), ["k"]).count() == 1


def test_participants_of_the_file_names_are_checked(spark, tmp_path):
    put(tmp_path / "d.csv", "participant1_id,participant1_relpath,participant2_id,participant2_relpath\nP7,x/train/V1_S2_I3_P7.wav,9,x/train/V1_S2_I3_P8.wav\n")
    assert [r.detail for r in quality.dyads_consistent(tables.read_dyads(spark, str(tmp_path / "d.csv"))).collect()] == ["participant2"]


def test_empty_shards_are_refused_and_order_is_kept(spark, tmp_path):
    put(tmp_path / "x_shard_1.csv", "a\n3\n2\n")
    put(tmp_path / "x_shard_0.csv", "a\n9\n")
    rows, _ = tables.read_shards(spark, str(tmp_path / "*.csv"), ["a"])
    assert [r.a for r in rows.orderBy("shard", "at").collect()] == ["9", "3", "2"]
    put(tmp_path / "x_shard_2.csv", "")
    with pytest.raises(ValueError, match="x_shard_2"):
        tables.read_shards(spark, str(tmp_path / "*.csv"), ["a"])


def test_frame_rms_of_ragged_signals(spark):
    rows = [(1, 8, [1.0, 1.0, 3.0, 3.0, 5.0]), (2, 8, [2.0]), (3, 4, [0.0, 4.0]), (4, 8, []), (5, 8, None)]
    frame = spark.createDataFrame(rows, "segment_id int, sample_rate int, samples array<float>")
    got = {(r.segment_id, r.frame_idx): (r.center, round(r.rms, 4), r.length) for r in tempo.frame_rms(frame, frame=0.25, hop=0.25).collect()}
    assert got == {(1, 0): (0.125, 1.0, 0.625), (1, 1): (0.375, 3.0, 0.625), (2, 0): (0.0625, 2.0, 0.125), (3, 0): (0.125, 0.001, 0.5), (3, 1): (0.375, 4.0, 0.5)}


def test_pitch_states(spark):
    clips = spark.createDataFrame([("a", 0.0, 1.0, True), ("b", 0.5, 0.5, True), ("c", 0.0, 0.01, True), ("d", 0.0, 1.0, False), ("e", 0.0, 1.0, True)], "segment_id string, s double, e double, fine boolean")
    state = pitch.segment_state(F.col("s"), F.col("e"), F.lit(3.0), F.col("fine"))
    frames = spark.createDataFrame([("a", 100.0), ("a", 0.0), ("e", 0.0)], "segment_id string, f0 double")
    out = pitch.pitch_stats(frames, segments=clips.withColumn("state", state), state="state")
    got = {r.segment_id: (r.status_prosody, r.voiced_ratio) for r in out.collect()}
    assert got == {"a": ("OK", 0.5), "b": ("SEGMENT_INVALID_FOR_PITCH", None), "c": ("SEGMENT_TOO_SHORT_FOR_PITCH", None), "d": ("PITCH_ANALYSIS_FAILED", None), "e": ("NO_VOICED_FRAMES", 0.0)}
