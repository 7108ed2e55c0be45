"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.operators.checkpoints import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step on ``(u, v)`` rows with ``u > v``.

    Large star: every node links its larger neighbours to its smallest neighbour (or itself); one row for each row given.
    Small star: every node links itself and its smaller neighbours to the smallest of them; equal rows become one.
    """
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _settled(links: DataFrame) -> bool:
    """Whether distinct ``(u, v)`` are stars: every ``u`` is in one row and is never a ``v``."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 AND n > 1").agg(F.count("*")).first()[0] == 0


def _pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    return cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _forest(pairs: DataFrame, max_rounds: int) -> DataFrame:
    links = pairs.where("u > v")
    for _ in range(max_rounds):
        # either step is written by itself: as one plan, the small star has the large one in it three times
        links = cut(_star(cut(_star(links, large=True)), large=False))
        if _settled(links):
            return links
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def star_forest(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(u, v)``: every node but the smallest of its component, with that smallest one."""
    return _forest(_pairs(edges, a, b), max_rounds)


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that an edge touches; component = smallest node reachable.

    Edges with a null end and self-loops add nothing but the node itself. Every step is written to the
    checkpoint folder, so a lost executor costs one step at most. A round keeps one row per (node, smaller
    node) and the edge count never grows, so hubs cost partial aggregates and a splittable join. Rounds end
    with the first that leaves stars only.
    """
    pairs = _pairs(edges, a, b)
    nodes = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct()
    return nodes.join(_forest(pairs, max_rounds), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
