import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm import hard_negatives
from tests.llm.test_vectors import VEC, good, rows


def plain(given, is_anchor, positives=5, negatives=5, low=80, high=100, scale=256):
    ok = [(i, y, [int(np.floor(scale * float(x))) for x in v]) for i, v, y in given if i is not None and y is not None and good(v)] + [(i, y, []) for i, v, y in given if v == [] and y is not None]
    out = []
    for a, label, v in ok:
        if not is_anchor(a):
            continue
        scored = sorted(((-sum(x * z for x, z in zip(v, w, strict=True)), i, y) for i, y, w in ok if i != a and len(w) == len(v)), key=lambda t: t[:2])
        for p, i, _ in [t for t in scored if t[2] == label][:positives]:
            fit = [(n, j) for n, j, y in scored if y != label and low * -p <= 100 * -n <= high * -p]
            out += [(a, i, r + 1, j, -p, -n) for r, (n, j) in enumerate(fit[:negatives])]
    return sorted(out)


def got(frame, is_anchor, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(frame, is_anchor, **options).collect())


def test_against_brute_force(spark):
    given = rows(260, seed=4) + [(None, [1.0] * 16, 1)] + [(9300 + i, [0.5] * 16, i % 3) for i in range(12)]
    frame = spark.createDataFrame(given, VEC).repartition(3)
    want = plain(given, lambda i: i % 10 == 0)
    assert len(want) > 300
    assert got(frame, F.col("vec_id") % 10 == 0) == want
    assert got(frame, F.col("vec_id") % 10 == 0, block=40, lot=7, focus=2) == want


def test_repeated_ids_other_bands_and_columns(spark):
    given = rows(150, seed=5)
    given += given[3:9]
    frame = spark.createDataFrame([(*r, 1, "x", 0) for r in given], T.StructType([*VEC.fields, T.StructField("row", T.IntegerType()), T.StructField("n", T.StringType()), T.StructField("part", T.IntegerType())]))
    options = {"positives": 3, "negatives": 2, "low": 30, "high": 90}
    assert got(frame, F.col("vec_id") % 7 == 0, block=50, **options) == plain(given, lambda i: i % 7 == 0, **options)


def test_empty_and_too_long(spark):
    assert got(spark.createDataFrame([], VEC), F.col("vec_id") % 7 == 0) == []
    assert got(spark.createDataFrame([(7, None, 1), (14, [1.0], None), (21, [1.0], 2)], VEC), F.col("vec_id") % 7 == 0) == []
    with pytest.raises(Exception, match="64 bits"):
        got(spark.createDataFrame([(7, [1e18], 1), (8, [1e18], 1)], VEC), F.col("vec_id") % 7 == 0)


def test_ranges_prune_and_keep_all_that_reach():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * 0.05
    x = np.floor(1000 * x / np.sqrt((x**2).sum(axis=1))[:, None]).astype(np.int64)  # a length bucket
    block = hard_negatives.Block(x, np.arange(2000))
    for i in range(0, 200, 10):
        true = x @ x[i]
        bar = int(np.sort(true)[-6])
        rows_ = block.reaching(x[i], bar, 4)
        assert set(np.flatnonzero(true >= bar)) <= set(rows_.tolist())
        block.verified += len(rows_)
        for low in (-5000, 0, 7):
            assert set(np.flatnonzero(true >= low)) <= set(block.reaching(x[i], low, 3).tolist())
    assert block.verified < 20 * 2000 / 4
