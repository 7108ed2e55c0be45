"""Hand cases of timelines, bounds and refinement, and a plain model over random timelines."""

import random

import pytest
from pyspark.sql import functions as F

from dyadspark.functions import audio, text
from dyadspark.operators import intervals, pairs

WORDS = "interaction long, participant string, turn long, seg_idx int, word_idx int, word string, start double, end double"
VAD = "interaction long, participant string, start double, end double"


def words(rows):
    """(participant, start, end, text) segments -> word rows; the words share the time evenly."""
    out = []
    for seg, (who, start, end, said) in enumerate(rows):
        tokens = said.split()
        step = (end - start) / max(1, len(tokens))
        out += [(1, who, seg, 0, i, t, float(start + i * step), float(start + (i + 1) * step)) for i, t in enumerate(tokens)]
    return out


def build(spark, rows, vad=None, **options):
    vad = [(k, who, float(s), float(e)) for k, who, s, e in (vad if vad is not None else [(1, *r[:3]) for r in rows])]
    return pairs.build_pairs(spark.createDataFrame(words(rows), WORDS), spark.createDataFrame(vad, VAD), **options).orderBy("turn_index").collect()


LONG = "this is a long enough turn to count"


def test_backchannel_parts_its_neighbours(spark):
    assert len(build(spark, [("A", 0, 4, LONG), ("B", 4.5, 8.5, LONG)])) == 1
    assert build(spark, [("A", 0, 4, LONG), ("B", 4.1, 4.3, "yeah."), ("A", 4.5, 8.5, LONG)]) == []
    rows = build(spark, [("A", 0, 4, LONG), ("B", 4.1, 4.3, "oh yeah right"), ("B", 8, 12, LONG)], merge_gap=1.0)
    assert rows == []


def test_thresholds_are_inclusive(spark):
    ok = [("A", 0, 4, LONG), ("B", 5.0, 9, LONG)]
    assert build(spark, ok)[0].latency == 1.0
    assert build(spark, [("A", 0, 4, LONG), ("B", 5.001, 9, LONG)]) == []
    assert build(spark, [("A", 0, 4, LONG), ("B", 3.75, 9, LONG)])[0].overlap == 0.25
    assert build(spark, [("A", 0, 4, LONG), ("B", 3.74, 9, LONG)]) == []
    assert build(spark, [("A", 0, 3, LONG), ("B", 3, 5.9, LONG)]) == []


def test_gap_exactly_at_the_threshold_merges(spark):
    rows = build(spark, [("A", 0, 2, LONG), ("A", 3.0, 5, LONG), ("B", 5.2, 9, LONG)])
    assert rows[0].prompt_start == 0 and rows[0].prompt_word_count == 16
    rows = build(spark, [("A", 0, 2, LONG), ("A", 3.01, 7, LONG), ("B", 7.2, 11, LONG)])
    assert rows[0].prompt_start == 3.01


def test_long_turns_are_clipped_on_both_sides(spark):
    row = build(spark, [("A", 0, 20, LONG), ("B", 20, 45, LONG)])[0]
    assert (row.prompt_start, row.prompt_end, row.response_start, row.response_end) == (5, 20, 20, 35)
    assert row.prompt_word_count == 6 and row.response_word_count == 4


def test_words_can_all_lie_outside_the_refined_bounds(spark):
    row = build(spark, [("A", 0, 4, LONG), ("B", 5, 9, LONG)], vad=[(1, "A", 0, 4), (1, "B", 9.4, 13.0)], max_latency=10.0)[0]
    assert (row.response_start, row.response_transcript, row.response_word_count) == (9.4, "", 0)


@pytest.mark.parametrize(
    ("vad", "want"),
    [
        ([(0.0, 1.0)], (0.0, 1.0)),  # touches by a point
        ([(0.0, 0.5), (2.5, 3.0)], (0.0, 0.5)),  # equally near: the earlier one
        ([(0.0, 0.49)], None),
        ([(0.5, 1.5), (1.8, 2.2), (5.0, 6.0)], (0.5, 2.2)),
        ([], None),
        (None, None),
    ],
)
def test_refinement(spark, vad, want):
    df = spark.createDataFrame([(1.0, 2.0, vad)], "start double, end double, vad array<struct<start: double, end: double>>")
    got = df.select(intervals.refine_bounds(F.col("start"), F.col("end"), F.col("vad")).alias("r")).first().r
    assert (got and (got.start, got.end)) == want
    if vad is not None:
        spans = spark.createDataFrame([(1, 1.0, 2.0)], "span_id int, start double, end double").withColumn("k", F.lit(1))
        other = spark.createDataFrame([(1, *v) for v in vad], "k int, start double, end double")
        row = intervals.refine_by_join(spans, other, ["k"], bucket=0.7).first()
        assert ((row.refined_start, row.refined_end) if row.refined_start is not None else None) == want


def plain_pairs(rows, vad):
    def merged(items, gap=1.0):
        out = []
        for s, e, w in sorted(items, key=lambda x: x[0]):
            if out and s - out[-1][1] <= gap:
                out[-1] = (out[-1][0], max(out[-1][1], e), out[-1][2] + w)
            else:
                out.append((s, e, list(w)))
        return out

    turns = []
    for who in ("A", "B"):
        turns += [(s, e, who, w) for s, e, w in merged([(s, e, t.split()) for p, s, e, t in rows if p == who])]
    turns.sort(key=lambda x: x[:3])
    areas = {who: [(s, e) for s, e, _ in merged([(s, e, []) for p, s, e in vad if p == who])] for who in ("A", "B")}

    def refine(s, e, who):
        hit = [(a, b) for a, b in areas[who] if b >= s and a <= e]
        if hit:
            return min(a for a, _ in hit), max(b for _, b in hit)
        near = sorted((max(s - b, a - e), a, b) for a, b in areas[who] if max(s - b, a - e) <= 0.5)
        return near[0][1:] if near else None

    replies = {"yeah", "ok.", "right"}
    short = lambda w: len(w) <= 3 and all(x in replies for x in w)
    out = []
    for p, r in zip(turns, turns[1:], strict=False):
        if p[2] == r[2] or short(p[3]) or short(r[3]):
            continue
        a, b = refine(*p[:3]), refine(*r[:3])
        if not a or not b:
            continue
        a, b = (max(a[0], a[1] - 15), a[1]), (b[0], min(b[1], b[0] + 15))
        if min(a[1] - a[0], b[1] - b[0]) >= 3 and a[1] - b[0] <= 0.25 and b[0] - a[1] <= 1:
            out.append((p[2], *a, *b))
    return out


def test_random_timelines_against_a_plain_model(spark):
    rnd = random.Random(7)
    all_words, all_vad, want = [], [], {}
    for k in range(25):
        rows, vad, at = [], [], 0.0
        for i in range(30):
            who = rnd.choice("AB")
            length = rnd.choice([0.5, 2.0, 4.0, 8.0, 18.0])
            said = rnd.choice(["yeah", "ok. right", LONG, LONG, LONG + " " + LONG])
            at += rnd.choice([-0.25, 0.0, 0.125, 0.5, 1.0, 1.25])
            rows.append((who, at, at + length, said))
            if rnd.random() < 0.9:
                shift = rnd.choice([0.0, -0.125, 0.25, length + 0.375])
                vad.append((who, at + shift, at + shift + length))
            at += length
        all_words += [(k, *w[1:]) for w in words(rows)]
        all_vad += [(k, *v) for v in vad]
        want[k] = plain_pairs(rows, vad)
    got = {k: [] for k in want}
    for r in pairs.build_pairs(spark.createDataFrame(all_words, WORDS), spark.createDataFrame(all_vad, VAD)).orderBy("interaction", "turn_index").collect():
        got[r.interaction].append((r.prompt_participant_id, r.prompt_start, r.prompt_end, r.response_start, r.response_end))
        assert r.turn_index == len(got[r.interaction])
    assert sum(map(len, want.values())) > 20
    assert got == want


def test_text_functions(spark):
    row = spark.createDataFrame([("dir/V1_S2_I3_P4.wav", "P12", " P9: x P10: y", "|P1| P2 ", 5.0e-4, 12345678.5)], "path string, who string, said string, speakers string, a double, b double").select(
        text.parse_stem(text.stem_of(F.col("path"))).alias("stem"), text.canonical_participant_id(F.col("who")).alias("who"), text.first_speaker(F.col("said")).alias("first"), text.last_speaker(F.col("said")).alias("last"),
        text.participant_fallback(F.col("speakers"), 1).alias("second"), text.participant_fallback(F.col("speakers"), 5).alias("none"), text.number_text(F.col("a")).alias("a"), text.number_text(F.col("b")).alias("b"),
        text.number_text(F.lit(3)).alias("c"), text.word_count(F.lit("it's déjà-vu 3x")).alias("n"), text.turn_index_of(F.lit("a_b_012")).alias("turn"), text.resolve_path("/r", F.lit("x")).alias("p"),
    ).first()
    assert tuple(row.stem) == ("V1", "2", "3", "4") and row.who == "P12" and (row.first, row.last) == ("P9", "P10")
    assert (row.second, row.none, row.a, row.b, row.c, row.n, row.turn, row.p) == ("P2", "", "0.0005", "12345678.5", "3.0", 4, 12, "/r/x")


def test_key_text_of_null_signed_and_large_numbers(spark):
    """As SQL's ``||`` and ``printf('%.6f')``: a part that is null makes the key null."""
    rows = [(1, None), (2, -1e-9), (3, 6452785714.285714), (4, 1e10 + 1 / 3), (5, -2.5e-6), (6, 0.9999999), (None, 1.0), (8, float("nan")), (9, float("-inf")), (10, 1e300), (11, 4503599627370495.5)]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k long, start double").select("k", text.merge_key(["k", "start"], ["start"]).alias("t")).collect()}
    import duckdb

    sql = "SELECT k, k || '|' || regexp_replace(printf('%.6f', round(start, 6)), '(\\.\\d+?)0+$', '\\1') FROM (VALUES " + ", ".join(f"({'NULL' if k is None else k}, {'NULL' if x is None else repr(str(x))}::DOUBLE)" for k, x in rows) + ") v(k, start)"
    want = dict(duckdb.sql(sql).fetchall())
    assert got[1] is None and got[None] is None and got[2] == "2|-0.0" and got[6] == "6|1.0"
    assert {k: v for k, v in got.items() if k != 10} == {k: v for k, v in want.items() if k != 10}  # 1e300: digits of the shortest text
    assert float(got[10].split("|")[1]) == 1e300


def test_slices(spark):
    df = spark.createDataFrame([([float(i) for i in range(10)], 4)], "s array<float>, r int")
    cut = lambda a, b: df.select(audio.slice_samples(F.col("s"), F.col("r"), F.lit(a), F.lit(b)).alias("x")).first().x
    assert cut(0.5, 1.0).samples == [2.0, 3.0]
    assert cut(0.0, 9.0).status == "AUDIO_SEGMENT_INVALID" and cut(1.0, 1.0).samples is None
