"""History windows and evaluation summaries over prediction and rating tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.constants import RESPONSE_TARGETS
from dyadspark.operators.checkpoints import cut


def history(pairs: DataFrame, features: Sequence[str], length: int, *, interaction: str = "interaction_id", order: str = "turn_index") -> DataFrame:
    """``history``: up to ``length`` earlier pairs of the interaction, oldest first, padded in front with nulls; ``history_mask`` is 1 where there is one."""
    by = W.partitionBy(interaction).orderBy(order).rowsBetween(-length, -1)
    seen = F.collect_list(F.struct(*features)).over(by)
    out = pairs.withColumn("_seen", seen)
    pad = F.lit(length) - F.size("_seen")
    empty = F.struct(*[F.lit(None).cast(pairs.schema[f].dataType).alias(f) for f in features])
    return out.withColumn("history", F.concat(F.array_repeat(empty, pad), F.col("_seen"))).withColumn("history_mask", F.concat(F.array_repeat(F.lit(0), pad), F.transform("_seen", lambda _: F.lit(1)))).drop("_seen")


def zscore(df: DataFrame, columns: Sequence[str], train) -> DataFrame:
    """Columns scaled with mean and SD of the rows that ``train`` marks; a constant column becomes 0."""
    facts = df.where(train).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])  # one row
    out = df.join(F.broadcast(facts))
    scaled = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns}
    return out.withColumns(scaled).select(*df.columns)


def regression_scores(predictions: DataFrame, by: Sequence[str], *, y: str = "y", mu: str = "mu") -> DataFrame:
    """``(by, n, mse, r2)``; R2 is null where y does not vary."""
    own = predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(y) - F.col(mu)) ** 2).alias("mse"), F.var_pop(y).alias("_var"))
    return own.select(*by, "n", "mse", F.when(F.col("_var") > 0, 1 - F.col("mse") / F.col("_var")).alias("r2"))


def target_average(scores: DataFrame, by: Sequence[str], values: Sequence[str] = ("mse", "r2")) -> DataFrame:
    return scores.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def c_index(predictions: DataFrame, by: Sequence[str], *, y: str = "y", mu: str = "mu", block_rows: int = 100_000, most_blocks: int = 1024) -> DataFrame:
    """Share of pairs with different ``y`` that ``mu`` orders alike; ties of ``mu`` count one half.

    Rows with equal ``(y, mu)`` are counted once with their number. If the largest group has over ``block_rows`` of them,
    groups are cut into ranges of ``y`` and ranges of ``mu``, as many as that group has blocks. Pairs of one ``y`` range
    are counted in its task, pairs of one ``mu`` range in its task, and pairs that share neither are decided by the counts
    of the grid of ranges, so no task sees a whole group.
    """
    by = list(by)
    kinds = ", ".join(f"{c} {predictions.schema[c].dataType.simpleString()}" for c in by)
    distinct = predictions.where(F.col(y).isNotNull() & F.col(mu).isNotNull()).groupBy(*by, F.col(y).cast("double").alias("_y"), F.col(mu).cast("double").alias("_mu")).agg(F.count("*").alias("_n"))
    schema = f"{kinds}, good long, tied long, comparable long"

    def pairs(first: str, second: str, ties: bool):
        def run(key, frame):
            good, tied, comparable = ordered_pairs(frame[first].to_numpy(), frame[second].to_numpy(), frame["_n"].to_numpy())
            return pd.DataFrame([[*key[: len(by)], good, tied, comparable] if ties else [*key[: len(by)], good, 0, comparable - tied]], columns=[*by, "good", "tied", "comparable"])

        return run

    largest = cut(distinct.groupBy(*by).agg(F.count("*").alias("_rows"))).agg(F.max("_rows")).first()[0] or 0
    ranges = min(most_blocks, -(-largest // block_rows))
    if ranges <= 1:
        total = distinct.groupBy(*by).applyInPandas(pairs("_y", "_mu", True), schema)
    else:
        steps = [i / ranges for i in range(1, ranges)]
        edge = lambda c: F.percentile_approx(c, steps, 10 * ranges)
        edges = distinct.groupBy(*by).agg(edge("_y").alias("_ye"), edge("_mu").alias("_me"))
        place = lambda c, e: F.size(F.filter(e, lambda x: x < F.col(c)))
        keyed = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
        same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
        dealt = distinct.join(edges.select(*keyed, "_ye", "_me"), reduce(and_, same)).select(*by, "_y", "_mu", "_n", place("_y", "_ye").alias("_yb"), place("_mu", "_me").alias("_mb"))
        in_y = dealt.groupBy(*by, "_yb").applyInPandas(pairs("_y", "_mu", True), schema)
        in_mu = dealt.groupBy(*by, "_mb").applyInPandas(pairs("_yb", "_mu", True), schema)
        grid = dealt.groupBy(*by, "_yb", "_mb").agg(F.sum("_n").alias("_n")).groupBy(*by).applyInPandas(pairs("_yb", "_mb", False), schema)
        total = in_y.unionByName(in_mu).unionByName(grid).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("good", "tied", "comparable")])
    return total.select(*by, "comparable", F.try_divide(F.col("good") + 0.5 * F.col("tied"), F.col("comparable")).alias("c_index"))


def ordered_pairs(y: np.ndarray, mu: np.ndarray, n: np.ndarray) -> tuple[int, int, int]:
    """``(concordant, tied in mu, comparable)`` counts of pairs with different y; row i stands for ``n[i]`` rows.

    Two rows part at the highest bit in which their ranks of mu differ: they share the bits above, and the smaller
    has a zero where the other has a one. So for each bit, rows with equal bits above it are read in the order of y, and
    every one meets the zeros before it, by one running sum.
    """
    y, mu = (np.unique(x, return_inverse=True)[1].astype(np.int64) for x in (y, mu))
    n = n.astype(np.int64)
    squares = lambda of: int((np.bincount(of, weights=n).astype(np.int64) ** 2).sum()) if len(of) else 0
    both = np.unique(np.stack([y, mu]), axis=1, return_inverse=True)[1].ravel() if len(y) else y
    comparable, tied = (int(n.sum()) ** 2 - squares(y)) // 2, (squares(mu) - squares(both)) // 2
    order = np.argsort(y, kind="stable")
    y, mu, n = y[order], mu[order], n[order]
    good = 0
    for bit in range(int(mu.max(initial=0)).bit_length()):
        above = mu >> (bit + 1)
        order = np.argsort(above, kind="stable")
        group, one, own = above[order], (mu[order] >> bit) & 1, n[order]
        zeros = np.concatenate([[0], np.cumsum(own * (1 - one))])
        at = np.arange(len(group))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_y = new_group | np.concatenate([[True], y[order][1:] != y[order][:-1]])
        begin, same_y = (np.maximum.accumulate(np.where(new, at, 0)) for new in (new_group, new_y))
        good += int((own * one * (zeros[same_y] - zeros[begin])).sum())
    return good, tied, comparable


def log_likelihood(predictions: DataFrame, *, y: str = "y", mu: str = "mu", sigma: str = "sigma", into: str = "ll") -> DataFrame:
    """Log density of y under a normal with mean mu and SD sigma; null where sigma is not over zero."""
    z = F.try_divide(F.col(y) - F.col(mu), F.col(sigma))
    return predictions.withColumn(into, F.when(F.col(sigma) > 0, -0.5 * F.log(F.lit(2) * F.pi()) - F.log(F.col(sigma)) - 0.5 * z * z))


def delta_ll(scored: DataFrame, by: Sequence[str], *, dataset: str = "dataset", natural: str = "natural_test", probe: str = "probe") -> DataFrame:
    """Mean log-likelihood of natural rows, of probe rows, and the difference."""
    mean = lambda d: F.avg(F.when(F.col(dataset) == d, F.col("ll")))
    return scored.groupBy(*by).agg(mean(natural).alias("natural_ll"), mean(probe).alias("probe_ll")).withColumn("delta_ll", F.col("natural_ll") - F.col("probe_ll"))


def balanced_scores(sweep: DataFrame, *, error: str = "mse", gain: str = "delta_ll") -> DataFrame:
    """Mean of two normalised ranks: small errors and large gains come near 1. One row for each condition of a sweep."""
    a, b = W.orderBy(F.col(error).desc()), W.orderBy(gain)
    return sweep.withColumn("balanced", (F.percent_rank().over(a) + F.percent_rank().over(b)) / 2)


def winners(scores: DataFrame, condition: str, target: str = "target", *, error: str = "mse", gain: str = "delta_ll") -> DataFrame:
    """For each target the condition with the least error and the one with the largest gain; ties go to the smaller name."""
    return scores.groupBy(target).agg(F.min_by(condition, F.struct(error, condition)).alias("least_error"), F.min_by(condition, F.struct((-F.col(gain)).alias("g"), condition)).alias("largest_gain"))


def clip_ratings(ratings: DataFrame, scales: Sequence[str], *, clip: str = "clip_id", condition: str = "condition", style: Sequence[str] = ()) -> DataFrame:
    """Ratings without foils averaged by clip; ``style_avg`` is the mean of the style scales."""
    out = ratings.where(~F.col("is_foil")).groupBy(clip, condition).agg(*[F.avg(s).alias(s) for s in scales])
    return out.withColumn("style_avg", sum((F.col(s) for s in style[1:]), F.col(style[0])) / len(style)) if style else out


def condition_summary(clips: DataFrame, values: Sequence[str], *, condition: str = "condition", pools: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Number of clips, mean and SD of each condition, and of pooled groups of conditions."""
    rows = clips
    if pools:
        groups = F.array(F.col(condition), *[F.when(F.col(condition).isin(*members), F.lit(name)) for name, members in pools.items()])
        rows = clips.withColumn(condition, F.explode(F.array_compact(groups)))
    return rows.groupBy(condition).agg(F.count("*").alias("n"), *[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp))])


#: Ranges of values that prefix sums are cut into.
_RANGES = 200


def mann_whitney(rows: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """``(n_a, n_b, u, z, p)`` of two groups: average ranks for ties, normal approximation with tie correction.

    Ranks come from the counts of distinct values. These are cut into ranges; sums run inside each range, and over
    the totals of the ranges (``_RANGES`` rows at most), so no window sees all values. Without two rows z is null.
    """
    per = rows.where(F.col(group).isin(a, b) & F.col(value).isNotNull()).groupBy(value).agg(F.count_if(F.col(group) == a).alias("a"), F.count("*").alias("t"))
    edges = per.agg(F.percentile_approx(F.col(value).cast("double"), [i / _RANGES for i in range(1, _RANGES)], 10 * _RANGES).alias("_edges"))  # one row
    per = per.join(F.broadcast(edges)).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(value).cast("double")))).drop("_edges")
    ranges = per.groupBy("_range").agg(F.sum("t").alias("_t")).select("_range", (F.sum("_t").over(W.orderBy("_range")) - F.col("_t")).alias("_before"))
    per = per.join(F.broadcast(ranges), "_range")
    before = F.col("_before") + F.sum("t").over(W.partitionBy("_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0)) - F.col("t")
    ranked = per.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("a").alias("n_a"), (F.sum("t") - F.sum("a")).alias("n_b"), F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n = F.col("n_a") + F.col("n_b")
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    out = s.withColumn("u", u).withColumn("z", F.when(sd > 0, (u - F.col("n_a") * F.col("n_b") / 2) / sd))
    return out.select("n_a", "n_b", "u", "z", _two_sided("z").alias("p"))


def _two_sided(z: str):
    """Two-sided normal tail: Abramowitz and Stegun 26.2.17, error below 7.5e-8."""
    x = F.abs(F.col(z))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return 2 * poly * F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def response_table(pairs: DataFrame, key: str = "merge_key", targets: Sequence[str] = RESPONSE_TARGETS, role: str = "response") -> DataFrame:
    """``(key, target, value)`` of the response measurements."""
    own = pairs.select(key, *[F.col(f"{role}_{t}").cast("double").alias(t) for t in targets])
    return own.unpivot([key], list(targets), "target", "value")
