import re

import numpy as np
import xxhash
from pyspark.sql import types as T

from dyadspark.llm import simhash

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=2):
    """fps: {id: fingerprint} -> {id: smallest id reachable}"""
    ids = sorted(fps)
    arr = np.array([fps[i] for i in ids], np.uint64)
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for n, i in enumerate(ids):
        near = np.flatnonzero(np.bitwise_count(arr[n + 1 :] ^ arr[n]) <= radius)
        for m in near:
            a, b = sorted((find(i), find(ids[n + 1 + m])))
            low[b] = a
    return {i: find(i) for i in ids}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, rng.integers(1, 60))) for _ in range(120)]
    for i in range(60):
        words = texts[i].split()
        words[int(rng.integers(len(words)))] = "changed"
        texts.append(" ".join(words))
    texts += ["", None, " \n\t", "A b", "a B", "é É x", texts[0], texts[0].upper()] + ["word " * 4000]
    rows = list(enumerate(texts)) + [(None, "x y z")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(fps)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.fp % (1 << 64) == fps[r.doc_id]
            assert r.component_id == want[r.doc_id]


def test_small_and_split_buckets_agree(spark):
    """A bucket dealt out in parts, and wider keys, lose no link."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {}
    for i in range(600):
        x = int(base[i % 40])
        for b in rng.integers(0, 64, int(rng.integers(0, 4))):
            x ^= 1 << int(b)
        fps[i] = x
    first = {}
    for i, x in fps.items():
        first.setdefault(x, i)
    want = plain_components({i: x for x, i in first.items()})
    signed = [(x - (1 << 64) if x >> 63 else x, i) for x, i in first.items()]
    classes = spark.createDataFrame(signed, "fp long, rep long")
    for options in ({}, {"bucket_rows": 3}, {"blocks": 6}, {"blocks": 6, "bucket_rows": 2}):
        out = simhash.connected_components(simhash.links(classes, **options)).collect()
        got = {i: i for i in want} | {r.node: r.component for r in out}
        assert got == want


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(1, "a b c", "x", 3), (2, "a b c", "y", 4), (3, "q r s", "z", 5)], "doc_id int, text string, fp string, component_id int")
    kept = simhash.deduplicate(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.columns == odd.columns
