"""Joining independently produced feature tables one to one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.constants import MERGE_KEY_COLUMNS
from dyadspark.functions.text import merge_key


def rounded_keys(df: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """Floating key columns rounded, so that typed columns can be joined and no text has to match."""
    kinds = dict(df.dtypes)
    return df.withColumns({k: F.round(k, digits) for k in keys if kinds[k] in ("double", "float")})


def merge_tables(left: DataFrame, right: DataFrame, keys: Sequence[str] = MERGE_KEY_COLUMNS, *, key_text: Sequence[str] | None = None, one_to_one: bool = True) -> DataFrame:
    """Inner join on typed keys: all columns of ``left`` and those that only ``right`` has.

    Unless ``one_to_one`` is off, a key that either side has twice fails the query when it runs: the number of rows
    of a key is counted over the partitioning that the join needs anyway.

    ``key_text`` adds ``merge_key`` over these columns and keeps an old ``pair_id`` as ``pair_id_old``.
    """
    keys = list(keys)
    own = [c for c in right.columns if c in keys or c not in left.columns]
    sides = [rounded_keys(left, keys), rounded_keys(right.select(*own), keys)]
    if one_to_one:
        sides = [_checked_unique(side, keys, name) for side, name in zip(sides, ("left", "right"), strict=True)]
    out = sides[0].join(sides[1], keys)
    if key_text is None:
        return out
    out = out.withColumn("merge_key", merge_key(list(key_text)))
    return out.withColumnRenamed("pair_id", "pair_id_old") if "pair_id" in out.columns else out


def bucket_count(df: DataFrame, rows: int = 250_000, least: int = 8) -> int:
    """Buckets of about ``rows`` rows for tables as large as ``df``, so that a task's memory does not grow with them."""
    return max(least, -(-df.count() // rows))


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str] = ("merge_key",), *, buckets: int = 200) -> DataFrame:
    """``df`` as a table of the session's warehouse, dealt to buckets by its keys and sorted in them.

    Tables with the same keys and buckets join, and are checked for repeated keys, without a shuffle: each task reads
    the same bucket of all of them. Floating keys are rounded before they are dealt.
    """
    keys = list(keys)
    own = rounded_keys(df, keys).repartition(buckets, *keys)  # one file for each bucket
    own.write.bucketBy(buckets, *keys).sortBy(*keys).mode("errorifexists").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def merge_bucketed(tables: Sequence[DataFrame], keys: Sequence[str] = ("merge_key",)) -> DataFrame:
    """Inner join of any number of tables of :func:`save_bucketed` on their common keys, each key once in each: all columns
    of the first, and those that only a later one has."""
    keys, out = list(keys), _checked_unique(tables[0], list(keys), "first")
    for i, table in enumerate(tables[1:], 2):
        own = [c for c in table.columns if c in keys or c not in out.columns]
        out = out.join(_checked_unique(table.select(*own), keys, f"number {i}").hint("merge"), keys)
    return out


def _checked_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``df``, which raises at a key that is not unique; the check sits in a filter, so no optimisation drops it."""
    many = F.count(F.lit(1)).over(W.partitionBy(*keys))
    counted = df.withColumn("_many", many)
    fail = F.raise_error(F.concat_ws(" ", F.lit(f"the {name} table has a key more than once:"), *[F.col(k).cast("string") for k in keys])).cast("boolean")
    return counted.where(F.when(F.col("_many") == 1, F.lit(True)).otherwise(fail)).drop("_many")


def key_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with ``side`` left or right."""
    keys = list(keys)
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def shared_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).distinct().join(right.select(*keys), list(keys), "left_semi")


def duplicate_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows with a key that is not unique, and the number of such keys."""
    many = df.groupBy(*keys).count().where("count > 1")
    return many.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"), F.count("*").alias("duplicate_keys"))


def shared_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(column, mismatches, compared)`` for every shared column, over the joined keys, in one pass; nulls are equal."""
    keys = list(keys)
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    both = left.select(*keys, *shared).join(right.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in shared]), keys)
    sums = both.agg(F.count("*").alias("compared"), *[F.coalesce(F.sum((~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).cast("long")), F.lit(0)).alias(f"_n_{i}") for i, c in enumerate(shared)])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_n_{i}").alias("mismatches")) for i, c in enumerate(shared)]))
    return sums.select("compared", rows.alias("_row")).select("_row.column", "_row.mismatches", "compared")


def ordered(df: DataFrame, keys: Sequence[str], limit: int = 0) -> DataFrame:
    """Sorted by the keys; the first ``limit`` rows unless it is 0."""
    out = df.orderBy(*keys)
    return out.limit(limit) if limit else out
