"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources in code point order, null last, weigh
1, 2, 3, repeating, and share the words of all documents; a target stops at ``most_epochs`` times its source's
size and the excess is shared again by weight until none is above. That end state is a water level: with
sources by cap over weight, the level is the first ``(total - caps before) / weights from here`` not above the
source's own ratio.

A source is taken whole as often as it fits its target; the rest comes from one more epoch in the order of
exponential keys ``-ln(u) / weight``, where ``u`` is a hash of the id and the weight is the quality of the text (its
characters per word, or any expression that the caller gives). Prefix sums run over a histogram of the keys first and
then inside the one bucket of each source where the budget ends, so no task sorts a whole source. Rows of one key stand in
the order of their ids and of a hash of their texts; equal rows are counted as one run, and the run where the budget ends
gives as many of its rows as bring the source nearest to its target. What remains is one cut point for each
source: rows before and after it decide for themselves, and the equal rows at it, however many, are counted and dealt
out again.

Defined results: a null text has size 0; null ids hash as the empty text; null sources are one source; rows that
repeat an id share a key and are told apart by their texts, rows that repeat both by the budget alone; of equal keys the
smaller id comes first; documents without a word are taken ``most_epochs`` times at most; very long texts are only
counted and never moved; an empty table gives an empty result; other columns, whatever their names, are carried by
:func:`mix` (maps cannot be, as Spark does not group by them) and ignored by :func:`report`. Up to 10,000 sources the plan
is broadcast, beyond that Spark joins by source; the rows are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.llm._common import partitions
from dyadspark.operators.checkpoints import cut

_BUCKETS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def _quality(size: Column) -> Column:
    """1 for texts of 3 to 9 characters for each word, else a half."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    return F.when((chars >= 3 * size) & (chars <= 9 * size), 1.0).otherwise(0.5)


def _measured(docs: DataFrame, seed: str, weight: Column | None) -> DataFrame:
    """``docs`` with ``_size``, the key ``_key``, its bucket ``_b``, which grows with the key, and a hash ``_th`` of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    out = docs.withColumn("_size", size).withColumn("_w", _quality(F.col("_size")) if weight is None else weight.cast("double")).withColumn("_u", u)
    out = out.withColumn("_key", -F.log("_u") / F.col("_w")).withColumn("_b", F.floor((1 - F.pow("_u", 1 / F.col("_w"))) * _BUCKETS).cast("int"))
    return out.withColumn("_th", F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 16)).drop("_u", "_w")


def targets(sizes: DataFrame, *, most_epochs: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``: one row for each source.

    The windows have no partition: they see one row for each source of the mixture, not its documents.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    every = W.partitionBy()
    out = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", most_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    out = out.withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")).withColumn("from_here", F.sum("weight").over(every) - F.sum("weight").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) + F.col("weight"))
    out = out.withColumn("level", (F.sum("source_size").over(every) - F.col("before")) / F.col("from_here"))
    out = out.withColumn("water", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"])
    return out.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("water", F.lit(0.0)) * F.col("weight")).alias("target"))


def plan(own: DataFrame, *, most_epochs: int = 3) -> DataFrame:
    """One row for each source of ``own`` (:func:`_measured` rows): size, target, complete epochs, and the cut point of the
    fractional one, which is a run of equal rows with the number of them that are taken."""
    bins = own.groupBy("source", "_b").agg(F.sum("_size").alias("in_bin"))
    goal = targets(bins.groupBy("source").agg(F.sum("in_bin").alias("source_size")), most_epochs=most_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0).cast("int"))
    goal = cut(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    # where the budget of the last epoch ends: the bucket whose words pass it
    run = W.partitionBy("source").orderBy("_b")
    at = bins.withColumn("start", F.sum("in_bin").over(run) - F.col("in_bin")).withColumnRenamed("source", "of")
    at = at.join(goal.select("source", "rest"), F.col("of").eqNullSafe(F.col("source"))).where("start <= rest AND start + in_bin > rest").select("of", F.col("_b").alias("cut_b"), "start", "rest")
    inside = own.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("_b") == F.col("cut_b")))
    runs = inside.groupBy("of", "cut_b", "start", "rest", "_key", "doc_id", "_th", "_size").agg(F.count("*").alias("n"))
    order = W.partitionBy("of", "cut_b").orderBy("_key", "doc_id", "_th").rowsBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("ahead", F.col("start") + F.sum(F.col("_size") * F.col("n")).over(order) - F.col("_size") * F.col("n"))
    # row j of a run is taken if that brings the source nearer: 2 * (ahead + j * size) + size <= 2 * rest
    fit = F.floor((2 * F.col("rest") - 2 * F.col("ahead") - F.col("_size")) / (2 * F.col("_size"))) + 1
    fit = F.when(F.col("_size") == 0, F.when(F.col("ahead") <= F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.least("n", F.greatest(fit, F.lit(0))))
    last = runs.withColumn("fit", fit.cast("long")).where("fit > 0").groupBy("of", "cut_b").agg(F.max(F.struct("_key", "doc_id", "_th", "fit")).alias("last"))
    ends = at.select("of", "cut_b").join(last.withColumnRenamed("of", "of2").withColumnRenamed("cut_b", "b2"), F.col("of").eqNullSafe(F.col("of2")) & (F.col("cut_b") == F.col("b2")), "left")
    ends = ends.select("of", "cut_b", F.col("last._key").alias("cut_key"), F.col("last.doc_id").alias("cut_id"), F.col("last._th").alias("cut_th"), F.col("last.fit").alias("cut_rows"))
    return goal.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "source_size", "target", "epochs", "cut_b", "cut_key", "cut_id", "cut_th", "cut_rows")


def _small(own: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """The plan under names of its own, broadcast if it is counted to be small.

    Texts are then not shuffled at all, and a source that holds a third of them stays where it is. With more sources
    than ``most_broadcast`` Spark joins by source.
    """
    own = cut(own.select([F.col(c).alias(f"_p_{c}") for c in own.columns]))
    return F.broadcast(own) if own.count() <= most_broadcast else own


def _decided(rows: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(apart, tied)``: measured rows with the plan of their source and, apart from the run at the cut, ``_copies``."""
    met = rows.join(own, F.col("source").eqNullSafe(F.col("_p_source")))
    key, i, th = (F.col("_b") == F.col("_p_cut_b")) & (F.col("_key") == F.col("_p_cut_key")), F.col("doc_id"), F.col("_th")
    same_id = i.eqNullSafe(F.col("_p_cut_id"))
    tied = key & same_id & (th == F.col("_p_cut_th"))
    sooner = F.coalesce(i < F.col("_p_cut_id"), i.isNull() & F.col("_p_cut_id").isNotNull()) | (same_id & (th < F.col("_p_cut_th")))
    before = (F.col("_b") < F.col("_p_cut_b")) | ((F.col("_b") == F.col("_p_cut_b")) & (F.col("_key") < F.col("_p_cut_key"))) | (key & sooner)
    apart = met.where(~F.coalesce(tied, F.lit(False))).withColumn("_copies", F.col("_p_epochs") + F.coalesce(before, F.lit(False)).cast("int"))
    return apart, met.where(tied)


def _dealt(runs: DataFrame, n: str, number: str, most: int = 4096) -> DataFrame:
    """Every row ``n`` times, numbered from 1; long runs are dealt to several tasks."""
    parts = runs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / most)))).repartition(partitions(runs))
    return parts.withColumn(number, F.explode(F.sequence(F.col("_part") * most + 1, F.least(F.col(n), (F.col("_part") + 1) * most)))).drop("_part")


def report(docs: DataFrame, *, most_epochs: int = 3, seed: str = "mix:", weight: Column | None = None) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row."""
    own = cut(_measured(docs, seed, weight).select("doc_id", "source", "_size", "_key", "_b", "_th"))
    apart, tied = _decided(own, _small(plan(own, most_epochs=most_epochs)))
    given = ["doc_id", "_size", "_p_source_size", "_p_target"]
    runs = tied.groupBy(*given, "_p_source", "_p_epochs", "_p_cut_rows").agg(F.count("*").alias("_n"))
    one = _dealt(runs, "_n", "_i").withColumn("_copies", F.col("_p_epochs") + (F.col("_i") <= F.col("_p_cut_rows")).cast("int"))
    out = apart.select(*given, "_copies").unionByName(one.select(*given, "_copies"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_p_source_size").alias("source_size"), F.col("_p_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, *, most_epochs: int = 3, seed: str = "mix:", weight: Column | None = None) -> DataFrame:
    """The mixture: every row of ``docs`` as often as it is taken, ``most_epochs`` times at most.

    ``weight`` is an expression over the columns of ``docs``: the weight of a row in its source's fractional epoch.
    """
    given = docs if weight is None else docs.withColumn("_weight", weight)
    given = given.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *(["_weight"] if weight is not None else []))
    by = None if weight is None else F.col("_weight")
    measured = _measured(given, seed, by)
    own = cut(measured.select("doc_id", "source", "_size", "_key", "_b", "_th"))
    goal = _small(plan(own, most_epochs=most_epochs))
    apart, _ = _decided(measured, goal)
    # only rows of the id at the cut are measured once more
    at = F.col("source").eqNullSafe(F.col("_p_source")) & F.col("doc_id").eqNullSafe(F.col("_p_cut_id")) & F.col("_p_cut_th").isNotNull()
    _, tied = _decided(_measured(given.join(goal.select("_p_source", "_p_cut_id", "_p_cut_th"), at, "left_semi"), seed, by), goal)
    most = lambda copies: F.least(copies, F.lit(most_epochs))  # noqa: E731  documents of size 0 fit any budget
    once = apart.where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), most(F.col("_copies")))).alias("_copy")).select("_row.*")
    # the run at the cut: equal rows are counted, and those that differ in other columns follow each other
    runs = tied.groupBy("_row", "_p_source", "_p_epochs", "_p_cut_rows").agg(F.count("*").alias("_n"))
    order = W.partitionBy("_p_source").orderBy(F.xxhash64("_row")).rowsBetween(W.unboundedPreceding, 0)
    runs = runs.withColumn("_left", F.col("_p_cut_rows") - F.sum("_n").over(order) + F.col("_n"))
    more = F.when(F.col("_p_epochs") < most_epochs, F.least("_n", F.greatest("_left", F.lit(0)))).otherwise(0)
    runs = runs.withColumn("_all", F.col("_p_epochs") * F.col("_n") + more)
    return once.unionByName(_dealt(runs.where("_all > 0"), "_all", "_i").select("_row.*"))


def report_sql() -> str:
    """DuckDB SQL for :func:`report` over ``documents``."""
    return f"""
WITH m AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, coalesce(length(text), 0) AS chars, substr(md5(coalesce(text, '')), 1, 16) AS th,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u
  FROM documents),
k AS (
  SELECT *, -ln(u) / w AS key, floor((1 - pow(u, 1 / w)) * {_BUCKETS})::INT AS b
  FROM (SELECT *, CASE WHEN chars >= 3 * size AND chars <= 9 * size THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS w FROM m)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () - (sum(cap) OVER o - cap))::DOUBLE / (sum(weight) OVER () - sum(weight) OVER o + weight)::DOUBLE AS level
  FROM r WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), 0) * weight) AS target FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::INT ELSE 0 END AS epochs FROM t),
c AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.b, k.key, k.doc_id, k.th ROWS UNBOUNDED PRECEDING) - k.size AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * ahead + size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
