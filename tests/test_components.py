import random

from dyadspark.operators.graph import connected_components, star_forest


def _jobs(spark, work):
    """What ``work`` returns, and how many jobs it took."""
    sc = spark.sparkContext
    spark.range(1).count()  # so that the ids of jobs are known
    sc.setJobGroup("counted", "")
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    return out, len(sc.statusTracker().getJobIdsForGroup("counted"))


def test_forest_ends_with_the_round_that_leaves_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, rng.randrange(200, 260)) for _ in range(80)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 9)]
    low = {}
    for a, b in edges:
        if a is not None:
            x, y = low.setdefault(a, a), low.setdefault(b, b)
            low.update({k: min(x, y) for k, v in low.items() if v in (x, y)})
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {(r.node, r.component) for r in connected_components(df).collect()} == set(low.items())
    assert {(r.u, r.v) for r in star_forest(df).collect()} == {(k, v) for k, v in low.items() if k != v}
    # a star: the distinct pairs, one round of two steps, and the look at its rows
    _, n = _jobs(spark, lambda: star_forest(df.where("src = 7")))
    assert n <= 16  # 22 with a second round that only shows that nothing changes
