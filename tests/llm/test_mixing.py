import random

import duckdb
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.llm import mixing

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            return goal | {s: share * weight[s] for s in open_}
        goal |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= over
    return goal


def rows():
    rnd = random.Random(1)
    out = [(i, " ".join(["word"] * rnd.randrange(1, 200)), rnd.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(800)]
    return out + [(9001, "tiny", "d"), (9002, None, "b"), (9003, "", None), (9004, " \n", "e"), (None, "x y z", "a")]


def test_targets_and_takes(spark):
    given = rows()
    size = {r[0]: len((r[1] or "").split()) for r in given}
    sizes = {}
    for i, _, s in given:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = plain_targets(sizes)
    frame = spark.createDataFrame(given, DOC).repartition(3)
    got = mixing.report(frame).collect()
    assert len(got) == len(given)
    source = {r[0]: r[2] for r in given}
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 100
    assert sorted(map(str, mixing.report(frame.repartition(5)).collect())) == sorted(map(str, got))


def test_mix_repeats_rows(spark):
    given = rows()
    frame = spark.createDataFrame(given, DOC)
    plan = {r.doc_id: r.taken // r.size for r in mixing.report(frame).collect() if r.size}
    out = mixing.mix(frame.withColumn("size", frame.doc_id))
    assert out.columns == ["doc_id", "text", "source", "size"]
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert all(copies.get(i, 0) == n for i, n in plan.items())


def near_target(spark, given, most):
    """Taken words of each source are within ``most`` of its target; :func:`mix` takes what :func:`report` says."""
    frame = spark.createDataFrame(given, DOC).repartition(3)
    got = mixing.report(frame).collect()
    assert len(got) == len(given)
    size, taken, source = {}, {}, {}
    for i, text, s in given:
        n = len((text or "").split())
        size[s] = size.get(s, 0) + n
        source.setdefault((i, n), set()).add(s)
    want = plain_targets(size)
    for r in got:
        own = [s for s in source[r.doc_id, r.size] if size[s] == r.source_size]
        assert len(own) == 1 and r.taken <= 3 * r.size
        taken[own[0]] = taken.get(own[0], 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= most for s in size), (taken, want)
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.report(frame.repartition(5)).collect()) == key(got)
    mixed = {}
    for r in mixing.mix(frame).collect():
        mixed[r.source] = mixed.get(r.source, 0) + len((r.text or "").split())
    assert {s: mixed.get(s, 0) for s in taken} == taken


def test_one_id_null_ids_and_repeated_rows(spark):
    text = lambda n, w: " ".join([w] * n)
    near_target(spark, [(7, text(20, "a"), "a") for _ in range(100)] + [(i, text(21, "b"), "b") for i in range(30)], 11)
    near_target(spark, [(None, text(20, f"w{i}"), "a") for i in range(100)] + [(None, text(25, "b"), "b") for _ in range(40)], 13)
    near_target(spark, [(i % 5, text(10 + i % 3, f"w{i % 7}"), "abc"[i % 3]) for i in range(300)], 6)
    near_target(spark, [(1, text(20, "a"), "a") for _ in range(10_000)] + [(2, text(19, "b"), None) for _ in range(10)], 10)


def test_rows_that_differ_in_other_columns_only(spark):
    rows = [(1, " ".join(["a"] * 20), "a", i) for i in range(90)] + [(i, " ".join(["b"] * 20), "b", i) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, note int").repartition(4)
    want = sum(r.taken for r in mixing.report(frame).collect() if r.source_size == 1800) // 20
    mixed = [r for r in mixing.mix(frame).collect() if r.source == "a"]
    assert len(mixed) == want and len({r.note for r in mixed}) == min(want, 90)


def test_weight_of_the_caller(spark):
    rows = [(i, "one two three four", "ab"[i % 2]) for i in range(400)]
    frame = spark.createDataFrame(rows, DOC)
    good = F.when(F.col("doc_id") < 200, 50.0).otherwise(0.02)
    taken = {r.doc_id: r.taken for r in mixing.report(frame, weight=good).collect()}
    first, last = (sum(taken[i] for i in ids if i % 2 == 0) for ids in (range(200), range(200, 400)))
    assert first > 1.5 * last


def test_same_rows_as_sql(spark, tmp_path):
    given = [*rows(), *[(7, "x y z", "a")] * 40, *[(None, f"n {i % 3}", "b") for i in range(60)], *[(8, f"t{i % 4} u", "c") for i in range(50)]]
    spark.createDataFrame(given, DOC).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = sorted((str(a), b, c, round(d, 5), e) for a, b, c, d, e in con.execute(mixing.report_sql()).fetchall())
    got = sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 5), r.taken) for r in mixing.report(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == want


def test_empty(spark):
    assert mixing.report(spark.createDataFrame([], DOC)).count() == 0
    assert mixing.report(spark.createDataFrame([(1, None, None), (2, "", "a")], DOC)).count() == 2
