import hashlib
import random

from pyspark.sql import types as T

from dyadspark.llm import suffix_dedup

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain(rows, length):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}"""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def made_rows(n=60, seed=3):
    rnd = random.Random(seed)
    words = ["the", "of", "déjà", "日本", "x", "longerword", "aa"]
    make = lambda k: " ".join(rnd.choice(words) + str(rnd.randrange(30)) for _ in range(k))
    shared = [make(30) for _ in range(4)]
    rows = []
    for i in range(n):
        text = make(rnd.randrange(80))
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(60)
            text += s[a : a + rnd.randrange(200)] + make(3)
        rows.append((i * 3, text))
    rows += [(1, None), (2, ""), (4, "ab" * 500), (5, "ab" * 30), (7, rows[9][1]), (8, rows[9][1]), (10, "z" * 99), (11, "z" * 100), (13, "z" * 101), (14, make(9000)), (1000, rows[3][1] + rows[4][1])]
    return rows


def check(spark, rows, **options):
    got = suffix_dedup.removal_report(spark.createDataFrame(rows, DOC).repartition(3), **options).collect()
    want = plain(rows, options.get("length", 100))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert len(got) == len(rows)


def test_against_brute_force(spark):
    check(spark, made_rows())


def test_hot_anchors_and_short_windows(spark):
    """Anchors dealt out to several tasks, and many small blocks, give the same ranges."""
    check(spark, made_rows(40, 5), length=30, k=8, hot=3, block=2000)


def test_nulls_repeats_empty_and_other_columns(spark):
    assert suffix_dedup.removal_report(spark.createDataFrame([], DOC)).count() == 0
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(None, text), (None, text), (3, text), (3, text), (4, text)]
    got = sorted(((r.doc_id, r.n_removed) for r in suffix_dedup.removal_report(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == [(3, 0), (3, 0), (4, len(text)), (None, 0), (None, 0)]
    odd = spark.createDataFrame([(1, text, "p", 1), (2, text, "q", 2), (5, None, None, None)], "doc_id int, text string, h string, a int")
    out = suffix_dedup.deduplicate(odd)
    assert out.columns == odd.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: text, 2: "", 5: None}


def test_rows_that_share_an_id_lose_only_their_own_bytes(spark):
    """Rows of one id with different texts are documents of their own."""
    rng = random.Random(4)
    p, x, y = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(40)) for c in "pxy")
    rows = [(1, p), (5, p + x), (5, y), (9, y + " tail")]
    out = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOC))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, p), (5, x), (5, y), (9, out.where("doc_id = 9").first().text)])
    assert len(out.where("doc_id = 9").first().text) < 10
    texts = spark.createDataFrame([("a", p), ("b", p), ("b", y)], "doc_id string, text string")
    assert sorted((r.doc_id, r.text) for r in suffix_dedup.deduplicate(texts).collect()) == sorted([("a", p), ("b", ""), ("b", y)])


def test_a_frequent_phrase_with_many_surroundings(spark):
    """Contexts of a hot anchor go on by second anchors and still find every repeat."""
    rng = random.Random(5)
    line = "all of these texts hold this one line of words"
    make = lambda n: " ".join(f"{rng.randrange(10**7)}" for _ in range(n))
    tails = [make(20) for _ in range(12)]
    rows = [(i, make(20) + " " + line + " " + (rng.choice(tails) if i % 2 else make(20))) for i in range(120)]
    check(spark, rows, hot=4)


def test_pieces_of_a_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(700_000))  # over the piece of 4 MB
    assert len(long) > 4 << 20
    mid = long[(4 << 20) - 150 : (4 << 20) + 150]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removal_report(spark.createDataFrame([(1, long), (2, mid), (3, long[:500])], DOC)).collect()}
    assert got == {1: 0, 2: 300, 3: 500}
