"""Splits that keep speakers apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.constants import SPLIT_FRACTIONS
from dyadspark.operators.graph import connected_components


def speaker_components(dyads: DataFrame, a: str = "participant1_id", b: str = "participant2_id") -> DataFrame:
    """``(speaker, component)``: speakers that are linked by conversations."""
    return connected_components(dyads, a, b).withColumnRenamed("node", "speaker")


def component_weights(dyads: DataFrame, components: DataFrame, a: str = "participant1_id") -> DataFrame:
    """``(component, weight, n_speakers)``: rows of dyads and speakers of each component."""
    rows = dyads.join(components, F.col(a) == F.col("speaker")).groupBy("component").agg(F.count("*").alias("weight"))
    return rows.join(components.groupBy("component").agg(F.count("*").alias("n_speakers")), "component")


def _greedy_runs(histogram: list[tuple[int, int]], fractions: dict[str, float]) -> list[tuple[int, int, int, str]]:
    """``(weight, first rank, last rank, split)`` of the greedy choice over ``(weight, count)`` in descending weight.

    A split that is chosen comes nearer its target until it is full, so it is chosen again for all components of
    the weight up to the point where another one is nearer: a run takes one step, however long it is.
    """
    total = sum(w * n for w, n in histogram)
    names = list(fractions)
    held = dict.fromkeys(names, 0)
    out = []
    for weight, count in histogram:
        at = 1
        while at <= count:
            away = {s: abs(held[s] + weight - fractions[s] * total) for s in names}
            best = min(names, key=away.get)
            others = [away[s] for s in names if s != best]
            room = fractions[best] * total + min(others) - held[best] if others else float("inf")
            steps = count - at + 1 if room == float("inf") else max(1, min(count - at + 1, int(room // weight) - 1)) if weight else count - at + 1
            held[best] += steps * weight
            if out and out[-1][0] == weight and out[-1][3] == best:
                out[-1] = (weight, out[-1][1], at + steps - 1, best)
            else:
                out.append((weight, at, at + steps - 1, best))
            at += steps
    return out


def assign_components(weights: DataFrame, *, fractions: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """``(component, split)``: greedy by descending weight into the part whose size comes nearest its target.

    Each choice depends on the sizes of all before it, but not on which components these were. So the driver sees how
    many components there are of each weight (distinct weights grow with the square root of the rows at most) and
    decides ranges of ranks; components find their rank among those of equal weight, in the order of an md5 of
    seed and component, through counts of the md5's first digits, so one frequent weight is not one sort.
    """
    fractions = fractions or SPLIT_FRACTIONS
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("component").cast("string")))
    own = weights.select("component", "weight", order.alias("_o")).withColumn("_b", F.substring("_o", 1, 3))
    in_bucket = own.groupBy("weight", "_b").count()
    before = in_bucket.select("weight", "_b", (F.sum("count").over(W.partitionBy("weight").orderBy("_b")) - F.col("count")).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("weight", "_b").orderBy("_o", "component"))
    ranked = own.join(before, ["weight", "_b"]).select("component", "weight", place.alias("_rank"))
    histogram = [(r.weight, r["count"]) for r in weights.groupBy("weight").count().orderBy(F.col("weight").desc()).collect()]
    runs = weights.sparkSession.createDataFrame(_greedy_runs(histogram, fractions), "_w long, _first long, _last long, split string")
    met = ranked.join(F.broadcast(runs), (F.col("weight") == F.col("_w")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    return met.select("component", "split")
