import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm import cover_tree, topk

VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def rows(n=500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dim))
    x = base[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.2, 1.0], n)[:, None]
    out = [(int(i), [float(v) for v in x[i].astype(np.float32)], int(rng.integers(0, 3))) for i in range(n)]
    out += [(n + i, out[5][1], out[5][2]) for i in range(30)]  # copies
    nan, inf = float("nan"), float("inf")
    out += [(9000, None, 1), (9001, [0.0] * dim, 1), (9002, [nan] * dim, 1), (9003, [inf] + [1.0] * (dim - 1), 1), (9004, [None] + [1.0] * (dim - 1), 1), (9005, out[0][1], None), (9006, [1.0, 2.0], 1), (9007, [], 1), (9100, out[7][1], out[7][2])]
    return out


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


def plain_links(given, cosine):
    ok = [(i, np.array(v, np.float64), y) for i, v, y in given if y is not None and good(v) and any(v)]
    near = {i: set() for i, _, _ in given}
    for a in range(len(ok)):
        for b in range(a):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[i].add(j)
                near[j].add(i)
    low = {}
    for i in sorted(near):
        if i in low:
            continue
        todo = [i]
        low[i] = i
        while todo:
            for j in near[todo.pop()]:
                if j not in low:
                    low[j] = i
                    todo.append(j)
    return {i: (len(near[i]), low[i], low[i] == i) for i in near}


def test_links_against_brute_force(spark):
    given = rows()
    want = plain_links(given, 0.93)
    frame = spark.createDataFrame(given, VEC).repartition(3)
    for options in ({}, {"cell_rows": 20, "pivots": 8}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(frame, cosine=0.93, **options).collect()}
        assert got == want


def test_top_k_against_brute_force(spark):
    given = rows(seed=2)
    ok = [(i, np.floor(1024 * np.array(v, np.float64)).astype(np.int64)) for i, v, _ in given if good(v)]
    want = []
    for i, q in ok:
        if i % 100 == 0:
            best = sorted(((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q)))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    frame = spark.createDataFrame(given, VEC).repartition(3)
    for options in ({}, {"block": 60, "query_block": 2}):
        got = topk.top_k(frame, F.col("vec_id") % 100 == 0, k=10, **options)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_index_stops_on_proof_only():
    rng = np.random.default_rng(5)
    v = rng.integers(-1024, 1024, (3000, 24)) * (rng.random((3000, 24)) < 0.2)
    q = rng.integers(-1024, 1024, (7, 24))
    none = np.zeros((7, 3000), bool)
    i, j, s = topk.ImpactIndex(v).search(q, none, np.arange(3000), 10)
    full = q @ v.T
    for a in range(7):
        want = sorted(((-int(full[a, b]), b) for b in range(3000)))[:10]
        assert [(-int(x), int(b)) for x, b in zip(s[i == a], j[i == a])] == want


def test_empty(spark):
    empty = spark.createDataFrame([], VEC)
    assert cover_tree.near_duplicates(empty).count() == 0
    assert topk.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0
    odd = empty.withColumn("n", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("v", F.lit(2))
    assert cover_tree.near_duplicates(odd).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_bounds_spare_most_postings_where_vectors_have_neighbourhoods():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(16, 32))
    v = base[rng.integers(0, 16, 4000)] + 0.02 * rng.normal(size=(4000, 32))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    ids = np.arange(4000)
    block = topk.Block(v, ids, cell_rows=250)
    q, c, s = block.search(v[::100], ids[::100], 10)
    scores = v[::100] @ v.T
    scores[np.arange(40), ids[::100]] = -(10**12)
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :10]
    assert sorted(zip(q.tolist(), c.tolist(), s.tolist(), strict=True)) == sorted((i, int(j), int(scores[i, j])) for i in range(40) for j in order[i])
    assert block.touched < 0.35 * 40 * v.size


def test_top_k_ignores_other_columns(spark):
    frame = spark.createDataFrame([(100 * i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    more = frame.selectExpr("*", "1 AS score", "2 AS n", "'x' AS side", "3 AS c", "4 AS q", "5 AS rank", "6 AS v", "7 AS query_id")
    want = sorted(topk.top_k(frame, F.col("vec_id") % 100 == 0).collect(), key=str)
    assert len(want) == 12 and sorted(topk.top_k(more, F.col("vec_id") % 100 == 0).collect(), key=str) == want


def test_distances_follow_the_walk_where_vectors_have_neighbourhoods():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    v = base[rng.integers(0, 60, 3000)] + 0.02 * rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tree, seen = cover_tree.CoverTree(v), []
    reach = float(np.sqrt(2 - 2 * 0.93))
    found = {(int(i), int(j)) for a, b in cover_tree.close_pairs(tree, tree, reach, seen=seen) for i, j in zip(a, b, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.93, 1)), strict=True)}
    assert want <= found and len(found) < 1.5 * len(want)
    assert sum(seen) < 0.25 * 3000 * 3000 / 2


def test_top_k_of_repeated_ids_and_very_long_vectors(spark):
    given = [(10, [1.0, 2.0], 1), (10, [3.0, 1.0], 2), (20, [1.0, 1.0], 1), (20, [1.0, 1.0], 1), (30, [2.0, 2.0], 1)]
    rows = topk.top_k(spark.createDataFrame(given, VEC), F.col("vec_id") == 30, k=10).orderBy("rank").collect()
    assert [(r.vec_id, r.score >> 20) for r in rows] == [(10, 8), (10, 6), (20, 4), (20, 4)]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(100, [1e18], 1), (101, [1e18], 1)], VEC), F.col("vec_id") == 100).collect()


def test_links_join_labels_through_a_repeated_id(spark):
    given = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [0.0, 1.0], 2), (3, [0.01, 1.0], 2), (4, [1.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, 5, "x") for r in given], T.StructType([*VEC.fields, T.StructField("component", T.IntegerType()), T.StructField("cell", T.StringType())]))
    got = sorted((r.vec_id, r.component_id, r.kept) for r in cover_tree.near_duplicates(frame, cosine=0.93).collect())
    assert got == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]
