import threading

import pytest
from pyspark.sql import functions as F

from dyadspark.operators.checkpoints import scratch, stored
from dyadspark.sources import commits, tables


def rows(spark, ids, v):
    return spark.createDataFrame([(i, "prompt", v) for i in ids], "merge_key long, role string, v int")


def held(spark, path):
    return sorted((r.merge_key, r.v) for r in commits.committed(spark, path).collect())


def folders(path):
    return {p.name for p in (path / "data").iterdir() if p.name.startswith("commit=")}


def test_failed_and_repeated_runs_add_nothing(spark, tmp_path):
    at, keys = tmp_path / "t", ["merge_key", "role"]
    assert commits.committed(spark, str(at)) is None
    assert commits.append(rows(spark, range(0, 50), 1), str(at), keys, buckets=8)
    bad = rows(spark, range(0, 100), 2).repartition(4).withColumn("v", F.when(F.col("merge_key") == 77, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        commits.append(bad, str(at), keys)
    assert held(spark, str(at)) == [(i, 1) for i in range(50)] and len(folders(at)) == 1
    assert commits.append(rows(spark, range(0, 100), 3), str(at), keys)
    assert not commits.append(rows(spark, range(0, 100), 4), str(at), keys)
    want = [(i, 1 if i < 50 else 3) for i in range(100)]
    assert held(spark, str(at)) == want and len(folders(at)) == 2
    # what a driver left that ended before its commit is never read
    rows(spark, [500], 9).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{at}/data/commit=dead")
    assert held(spark, str(at)) == want and commits.vacuum(spark, str(at)) == ["commit=dead"] and len(folders(at)) == 2


def test_two_drivers_at_once(spark, tmp_path, monkeypatch):
    at, keys = str(tmp_path / "t"), ["merge_key"]
    commits.append(rows(spark, range(10), 1), at, keys, buckets=4)
    real, first = commits.rename_new, []

    def late(*args):
        if not first:  # just before the first commit, another one gets its number
            first.append(True)
            commits.append(rows(spark, range(5, 20), 2), at, keys)
        return real(*args)

    monkeypatch.setattr(commits, "rename_new", late)
    assert commits.append(rows(spark, range(8, 30), 3), at, keys)
    assert held(spark, at) == [(i, 1 if i < 10 else 2 if i < 20 else 3) for i in range(30)]
    assert len(commits.manifests(spark, at)) == 3


def test_only_touched_buckets_are_read(spark, tmp_path):
    at = str(tmp_path / "t")
    commits.append(rows(spark, range(2000), 1), at, ["merge_key"], buckets=16)
    new = rows(spark, [5000], 2).withColumn("bucket", F.pmod(F.xxhash64("merge_key"), F.lit(16)).cast("int"))
    plan = commits._lacking(new, commits.committed(spark, at), ["merge_key"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_pairs_have_their_name_only_when_complete(spark, tmp_path):
    df = rows(spark, range(9), 1).withColumn("split", F.lit("test"))
    to = str(tmp_path / "p")
    with pytest.raises(Exception, match="lost"):
        tables.write_pairs(df.withColumn("v", F.raise_error(F.lit("lost")).cast("int")), to, ["v", "split"])
    assert not list(tmp_path.iterdir())
    tables.write_pairs(df, to, ["v", "split"])
    with pytest.raises(FileExistsError):
        tables.write_pairs(df, to, ["v", "split"])
    assert spark.read.parquet(to).count() == 9 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["p"]


def test_scopes_of_threads_are_apart(spark):
    ready, done, got = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            df = stored(spark.range(10))
            ready.set()
            done.wait(60)
            got.append(df.count())

    thread = threading.Thread(target=other)
    thread.start()
    ready.wait(60)
    with scratch(spark):
        stored(spark.range(5))
    done.set()
    thread.join()
    assert got == [10]
