import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from dyadspark.llm import substring_dedup

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(given, length=13):
    """By brute force: ``(id, words, removed, digest)`` of each row."""
    first = {}
    for i, text in given:
        words = WORD.findall(text or "")
        for a in range(len(words) - length + 1):
            w = tuple(words[a : a + length])
            if i is not None and (w not in first or i < first[w]):
                first[w] = i
    out = []
    for i, text in given:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for a in range(len(words) - length + 1):
            if i is not None and first[tuple(words[a : a + length])] < i:
                gone[a : a + length] = [True] * length
        left = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed=0):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"wörd{i}" * (1 + i % 3) for i in range(60)]
    passages = [[rnd.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 20, 40, 90)]
    line = passages[0]  # one word short of a window, in many surroundings
    out = []
    for i in range(220):
        words = []
        for _ in range(rnd.randrange(0, 5)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))]
            words += rnd.choice(passages) if rnd.random() < 0.6 else line
        out.append((i * 3, rnd.choice([" ", "\n", "\t  "]).join(words)))
    out += [(1000 + i, out[7][1]) for i in range(30)]  # copies
    out += [(2000, " ".join(["same"] * 60)), (2001, " ".join(["same"] * 20)), (2002, " ".join(["a", "b"] * 40)), (2003, " ".join(["b", "a"] * 20))]
    out += [(3000, " ".join(passages[5] * 3)), (3001, None), (3002, ""), (3003, " \n "), (None, out[7][1]), (5, out[9][1]), (5, out[12][1]), (5, out[12][1])]
    out += [(4000, " ".join(rnd.choice(vocabulary) for _ in range(20000))), (3999, "x" * 5000 + " " + " ".join(passages[4]))]
    return out


def got(frame, **options):
    return sorted((tuple(r) for r in substring_dedup.removal_report(frame, **options).collect()), key=str)


def test_against_brute_force(spark):
    given = rows()
    frame = spark.createDataFrame(given, DOC).repartition(3)
    assert got(frame) == plain(given)


def test_hot_anchors_and_small_shards(spark):
    given = rows(1)
    want = plain(given)
    frame = spark.createDataFrame(given, DOC).repartition(3)
    assert got(frame, wide=3, hot=5, shard_words=300) == want
    assert got(frame, wide=1 << 30, hot=8) == want
    assert got(frame, length=3, wide=5, hot=9) == plain(given, 3)


def test_text_ids_extra_columns_and_cut_texts(spark):
    given = rows(2)[:120]
    frame = spark.createDataFrame([(None if i is None else f"é{i}", t, "x", 1, 2, i) for i, t in given], "doc_id string, text string, h string, _a int, t int, i long")
    want = {(i, n, r, s) for i, n, r, s in plain([(None if i is None else f"é{i}", t) for i, t in given])}
    assert {tuple(r) for r in substring_dedup.removal_report(frame).collect()} == want
    out = substring_dedup.deduplicate(frame)
    assert out.columns == frame.columns
    digest = {i: s for i, _, _, s in want}
    n_removed = {i: n for i, _, n, _ in want}
    for r in out.collect():
        if n_removed[r.doc_id]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == digest[r.doc_id]
        else:
            assert r.text == dict((f"é{i}", t) for i, t in given)[r.doc_id]


def test_empty(spark):
    assert got(spark.createDataFrame([], DOC)) == []
    assert got(spark.createDataFrame([(1, None), (None, "a b")], DOC)) == plain([(1, None), (None, "a b")])


def test_matching_statistics():
    rnd = random.Random(3)
    texts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 30))] for _ in range(12)]
    a = substring_dedup.Automaton()
    for rank, t in enumerate(texts):
        a.add(t, rank)
    m = substring_dedup.Matcher.of(a, 3)
    asked = [([rnd.randrange(-1, 4) for _ in range(25)], rnd.randrange(13)) for _ in range(40)]
    asked = [([-1 if c > 2 else c for c in t], r) for t, r in asked]
    codes, offsets = np.array([c for t, _ in asked for c in t]), np.arange(len(asked) + 1) * 25
    found = m.statistics(codes, offsets, np.array([r for _, r in asked])).reshape(-1, 25)
    for (t, rank), row in zip(asked, found, strict=True):
        for j in range(25):
            best = max((n for n in range(1, j + 2) if any(t[j + 1 - n : j + 1] == s[x : x + n] for s in texts[:rank] for x in range(len(s)))), default=0)
            assert row[j] == best


def test_a_shard_builds_only_what_may_repeat(monkeypatch):
    rnd = random.Random(4)
    alone = [[f"u{i}-{j}" for j in range(20)] for i in range(300)]
    mixed = [[rnd.choice("abc") for _ in range(rnd.randrange(4, 12))] for _ in range(80)]
    shown = [(rnd.randrange(40), words) for words in [*alone, *mixed] for _ in range(rnd.randrange(1, 5))]
    for kind in (int, lambda i: f"d{i:03}é"):
        first = {}
        for i, words in shown:
            first[" ".join(words)] = min(i, first.get(" ".join(words), i))
        reference = pa.table({"first": [kind(i) for i in first.values()], "text": list(first)})
        passages = pa.table({"doc_id": [kind(i) for i, _ in shown], "t": list(range(len(shown))), "s0": pa.array([7] * len(shown), pa.int32()), "text": [" ".join(w) for _, w in shown]})
        built, add = [], substring_dedup.Automaton.add
        monkeypatch.setattr(substring_dedup.Automaton, "add", lambda self, codes, rank, add=add, built=built: (built.append(len(codes)), add(self, codes, rank))[1])
        found = substring_dedup._streamed(reference, passages, 4)
        monkeypatch.undo()
        assert 0 < sum(built) <= sum(map(len, mixed))  # 6,000 more words stand alone
        gone = {(t, j) for t, a, b in zip(*[found.column(c).to_pylist() for c in ("t", "a", "b")], strict=True) for j in range(a, b)}
        starts = {}
        for i, words in shown:
            for a in range(len(words) - 3):
                starts[tuple(words[a : a + 4])] = min(i, starts.get(tuple(words[a : a + 4]), i))
        wanted = {(t, 7 + j) for t, (i, words) in enumerate(shown) for a in range(len(words) - 3) if starts[tuple(words[a : a + 4])] < i for j in range(a, a + 4)}
        assert gone == wanted and len(wanted) > 1000
        assert found.column("doc_id").to_pylist() == [kind(shown[t][0]) for t in found.column("t").to_pylist()]
