import uuid

import pytest
from pyspark.sql import functions as F

from dyadspark.operators import merge, quality


def table(spark, rows, column):
    return spark.createDataFrame([(k, v) for k, v in rows], f"merge_key string, {column} int")


def test_three_tables_join_without_a_shuffle(spark):
    save = lambda df: merge.save_bucketed(df, f"t_{uuid.uuid4().hex}", buckets=4)
    sides = [save(table(spark, [(f"k{i}", i * m) for i in range(a, b)], c)) for a, b, m, c in ((0, 50, 1, "metrics"), (5, 60, 2, "voice"), (3, 40, 3, "vectors"))]
    out = merge.merge_bucketed(sides)
    assert out.columns == ["merge_key", "metrics", "voice", "vectors"]
    assert sorted((r.merge_key, r.metrics, r.voice, r.vectors) for r in out.collect()) == sorted((f"k{i}", i, 2 * i, 3 * i) for i in range(5, 40))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    twice = save(table(spark, [("k7", 1), ("k7", 2)], "more"))
    with pytest.raises(Exception, match="more than once: k7"):
        merge.merge_bucketed([sides[0], twice]).collect()


def test_buckets_grow_with_the_table(spark):
    assert [merge.bucket_count(spark.range(n), rows=100, least=4) for n in (0, 400, 401, 5000)] == [4, 4, 5, 50]


def test_a_table_is_checked_by_the_job_that_writes_it(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 10).alias("a"), F.lit(5).alias("b")).repartition(3)
    checks = {"interval": F.col("b") >= F.col("a"), "key": F.col("k").isNotNull()}
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "one job writes and checks")
    found = quality.write_checked(df, str(tmp_path / "some"), checks, unique=["k"], fail=False)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found == {"rows": 100, "interval": 40, "key": 0, "unique_key": 0}
    assert spark.read.parquet(str(tmp_path / "some")).columns == ["k", "a", "b"]
    assert len(jobs.getJobIdsForGroup("checked")) <= 3  # adaptive execution runs each shuffle as a job of its own
    with pytest.raises(ValueError, match="interval: 40 of 100 rows; unique_key: 100 of 100"):
        quality.write_checked(df, str(tmp_path / "bad"), checks, unique=["b"])
    with pytest.raises(ValueError, match="no rows"):
        quality.write_checked(df.limit(0), str(tmp_path / "none"), checks)
    with pytest.raises(FileExistsError):
        quality.write_checked(df, str(tmp_path / "some"), {})
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["some"]
