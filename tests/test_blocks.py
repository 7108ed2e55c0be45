import random

import numpy as np
from pyspark.sql import functions as F

from dyadspark.functions import audio
from dyadspark.operators import blocks, intervals, tempo


def recordings(seed=0):
    rng = np.random.default_rng(seed)
    lengths = {"a": 1000, "b": 64, "c": 65, "d": 3, "e": 130, "f": 0}
    return {k: [float(x) for x in rng.normal(size=n).astype(np.float32)] for k, n in lengths.items()}


def frames(spark, whole, size):
    rnd, rows = random.Random(1), []
    for path, x in whole.items():
        at = 0
        while at < len(x):
            n = rnd.randrange(1, 150)
            rows.append((path, at, x[at : at + n]))
            at += n
    pieces = spark.createDataFrame(rows, "path string, offset long, samples array<float>").repartition(3)
    known = spark.createDataFrame([(p, 64 if p != "d" else 8, len(x)) for p, x in whole.items()], "path string, sample_rate int, n_frames long")
    return blocks.to_blocks(pieces, size), known


def test_blocks_are_bounded_and_whole(spark):
    whole = recordings()
    own, _ = frames(spark, whole, 64)
    found = {}
    for r in own.orderBy("path", "block").collect():
        assert len(r.samples) <= 64 and len(found.get(r.path, [])) == r.block * 64
        found.setdefault(r.path, []).extend(r.samples)
    assert found == {k: x for k, x in whole.items() if x}


def test_clips_equal_slices_of_whole_arrays(spark):
    whole = recordings()
    own, known = frames(spark, whole, 64)
    rnd = random.Random(2)
    rows = [(i, rnd.choice("abcdefg"), rnd.randrange(-1, 40) / 8, rnd.randrange(0, 60) / 8) for i in range(200)] + [(900, "a", None, 1.0), (901, "a", 0.0, 15.625), (902, "a", 0.0, 15.64), (903, "c", 1.0, 65 / 64)]
    segments = spark.createDataFrame(rows, "segment_id int, path string, start double, end double")
    got = {r.segment_id: (r.status, r.samples) for r in blocks.clips(segments, own, known, 64).collect()}
    arrays = spark.createDataFrame([(p, 64 if p != "d" else 8, x) for p, x in whole.items()], "path string, sample_rate int, samples array<float>")
    want = segments.join(arrays, "path", "left").select("segment_id", audio.slice_samples(F.col("samples"), F.col("sample_rate"), F.col("start"), F.col("end")).alias("s"))
    assert got == {r.segment_id: (r.s.status, r.s.samples) for r in want.collect()}
    assert max(len(r.samples) for r in blocks.parts_of(spark.createDataFrame([("a", 3, 900)], "path string, a long, b long"), own, 64).collect()) <= 64


def test_frames_cross_block_edges(spark):
    whole = recordings()
    arrays = spark.createDataFrame([(p, 64 if p != "d" else 8, x) for p, x in whole.items()], "segment_id string, sample_rate int, samples array<float>")
    want = {(r.segment_id, r.frame_idx): (r.center, round(r.rms, 9), r.length) for r in tempo.frame_rms(arrays, frame=0.5, hop=0.2).collect()}
    for size in (32, 64, 5000):
        own, known = frames(spark, whole, size)
        got = {(r.path, r.frame_idx): (r.center, round(r.rms, 9), r.length) for r in blocks.frame_rms(own, known, size, frame=0.5, hop=0.2).collect()}
        assert got == want


def plain_chunks(speech, longest, shortest):
    ticks = [t for a, b in sorted(speech) for t in range(a, b)]
    out = []
    for k in range(0, len(ticks), longest):
        part = ticks[k : k + longest]
        if len(part) < shortest:
            continue
        runs = []
        for t in part:
            if runs and runs[-1][1] == t:
                runs[-1][1] = t + 1
            else:
                runs.append([t, t + 1])
        out += [(k // longest, i, a, b) for i, (a, b) in enumerate(runs)]
    return out


def test_pieces_of_chunks(spark):
    rnd = random.Random(3)
    given = {}
    for key in range(12):
        at, own = 0, []
        for _ in range(rnd.randrange(0, 9)):
            at += rnd.randrange(1, 20)
            n = rnd.randrange(1, 60)
            own.append((at, at + n))
            at += n
        given[key] = own
    rows = [(k, a, b) for k, own in given.items() for a, b in own] + [(1, 5, 5), (2, None, 4)]
    speech = spark.createDataFrame(rows, "k int, start long, end long")
    got = {}
    for r in intervals.chunk_pieces(speech, ["k"], "start", "end", longest=30, shortest=7).orderBy("k", "chunk_idx", "piece_idx").collect():
        got.setdefault(r.k, []).append((r.chunk_idx, r.piece_idx, r.start, r.end))
    assert got == {k: c for k, own in given.items() if (c := plain_chunks(own, 30, 7))}
    chunks = intervals.speech_chunks(speech.where("end > start"), ["k"], "start", "end", longest=30, shortest=7).collect()
    assert {(r.k, r.chunk_idx): r.chunk_end - r.chunk_start for r in chunks} == {(k, c): sum(b - a for i, _, a, b in own if i == c) for k, own in got.items() for c, *_ in own}


def test_chunk_samples_from_blocks(spark):
    whole = recordings()
    own, _ = frames(spark, whole, 64)
    pieces = intervals.chunk_pieces(spark.createDataFrame([("a", 10, 200), ("a", 230, 700), ("e", 0, 130)], "path string, start long, end long"), ["path"], "start", "end", longest=300, shortest=50)
    got = {(r.path, r.chunk_idx): r.samples for r in blocks.chunk_samples(pieces, own, 64).collect()}
    said = whole["a"][10:200] + whole["a"][230:700]
    assert got == {("a", 0): said[:300], ("a", 1): said[300:600], ("a", 2): said[600:], ("e", 0): whole["e"]}


def test_sweep_equals_arrays_and_buckets(spark):
    rnd = random.Random(4)
    rows, vad = [], []
    for key in range(6):
        at = 0
        for _ in range(60 if key else 2000):  # key 0 lasts a day
            at += rnd.randrange(1, 40_000 if key == 0 else 900)
            n = rnd.randrange(1, 40_000 if key == 0 else 3000)
            vad.append((key, at, at + n))
            at += n
        rows += [(key, i, s, s + rnd.randrange(0, 1500)) for i, s in enumerate(rnd.randrange(0, at + 2000) for _ in range(120))]
        rows += [(key, 1000 + i, a - 500 - (i % 2), a - 500 - (i % 2)) for i, (_, a, _) in enumerate(vad[-20:])]
    rows.append((99, 1, 5, 9))
    spans = spark.createDataFrame(rows, "k int, i int, start long, end long")
    speech = spark.createDataFrame(vad, "k int, start long, end long")
    arrays = spans.join(intervals.as_arrays(speech, ["k"], "start", "end"), "k", "left").withColumn("r", intervals.refine_bounds(F.col("start"), F.col("end"), F.col("vad"), 500))
    want = {(r.k, r.i): (r.r and r.r.start, r.r and r.r.end) for r in arrays.select("k", "i", "r").collect()}
    swept = intervals.refine_by_sweep(spans, speech, ["k"], tolerance=500)
    assert swept.columns == [*spans.columns, "refined_start", "refined_end"]
    assert {(r.k, r.i): (r.refined_start, r.refined_end) for r in swept.collect()} == want
    met = intervals.refine_by_join(spans.withColumn("span_id", F.concat_ws("|", "k", "i")), speech, ["k"], tolerance=500, bucket=60_000)
    assert {(r.k, r.i): (r.refined_start, r.refined_end) for r in met.collect()} == want
