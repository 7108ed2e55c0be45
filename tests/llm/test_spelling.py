import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import types as T

from dyadspark.llm import spelling

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(given, shortest=6, fewest=5, every=199):
    n = Counter()
    for i, text in given:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= shortest and c >= fewest}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def rows(seed=0, docs=700):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdeéÉüß×oO") for _ in range(rnd.randrange(6, 11))) for _ in range(80)] + ["language", "languages", "banguage", "anguage", "égalité", "Straße", "abcdefgh"]
    words = list(stems)
    for s in stems:
        for _ in range(6):
            i = rnd.randrange(len(s))
            words.append(rnd.choice([s[:i] + s[i + 1 :], s[:i] + rnd.choice("aeé") + s[i:], s[:i] + rnd.choice("aeé") + s[i + 1 :], s[:i] + s[i : i + 1].swapcase() + s[i + 1 :]]))
    weights = [rnd.choice([1, 2, 4, 30, 200]) for _ in words]
    out = [(i, rnd.choice([" ", "-", "1", "ā", "中"]).join(rnd.choices(words, weights, k=rnd.randrange(0, 60)))) for i in range(docs)]
    return out + [(None, "Language language"), (5, None), (6, ""), (7, "x" * 500 + " " + "Y" * 300), (7, "y" * 300 + " abcdefgh"), (8, out[8][1]), (8, out[8][1]), (9, "Ã¿éèêë " * 9), (10, "chained " * 2500 + "chainede " * 300 + "chainedes " * 20)]


def got(frame, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame, **options).collect()}


def test_against_brute_force(spark):
    given = rows()
    frame = spark.createDataFrame(given, DOC).repartition(3)
    want = plain(given)
    assert len(want) > 150 and any(f is not None and r != f for f, r, *_ in want.values())
    assert got(frame) == want
    assert got(frame, depth=2, most_words=7, most_visitors=5) == want


def test_many_slips_and_other_columns(spark):
    given = rows(1, 300)
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in given], "doc_id long, text string, n int, word string, path int")
    assert got(frame, every=3) == plain(given, every=3)


def test_empty(spark):
    assert got(spark.createDataFrame([], DOC)) == {}
    assert got(spark.createDataFrame([(1, None), (2, "short words only")], DOC)) == {}


def test_trie_visits_few_nodes():
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(6, 12))) for _ in range(4000)} | {"abcdef", "abcdeg", "abcdefg", "bacdef"})
    array = pa.array(words)
    trie = spelling.Trie(array)
    q, w = trie.search(array, few=1)
    pairs = {frozenset((words[i], words[j])) for i, j in zip(q.tolist(), w.tolist(), strict=True)}
    assert pairs == {frozenset((a, b)) for a in words for b in words if a < b and one_edit(a, b)}
    assert {frozenset((words[i], words[j])) for i, j in zip(*(x.tolist() for x in trie.search(array)), strict=True)} == pairs
    trie.visited = 0
    trie.search(array.slice(0, 20), few=1)
    assert trie.visited < 3000  # of over 15,000 nodes
