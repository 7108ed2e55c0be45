"""Checks that return their violations as rows ``(check, key, detail)``."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.functions.text import canonical_participant_id
from dyadspark.sources import commits


def _rows(df: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    many = df.groupBy(*keys).count().where("count > 1")
    return _rows(many, "unique_key", F.concat_ws("|", *keys), F.concat(F.col("count"), F.lit(" rows")))


def non_empty_key(df: DataFrame, key: str) -> DataFrame:
    return _rows(df.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == ""), "non_empty_key", F.lit(key), F.lit("empty"))


def shared_columns_agree(mismatches: DataFrame) -> DataFrame:
    return _rows(mismatches.where("mismatches > 0"), "shared_columns", F.col("column"), F.concat(F.col("mismatches"), F.lit(" of "), F.col("compared")))


def schema(df: DataFrame, required: Sequence[str], *, exact: bool = False) -> DataFrame:
    """Missing (and, if ``exact``, further) columns; read from the schema, no job runs."""
    found = [("schema", c, "missing") for c in required if c not in df.columns]
    found += [("schema", c, "unexpected") for c in df.columns if exact and c not in required]
    return df.sparkSession.createDataFrame(found, "check string, key string, detail string")


def dyads_consistent(dyads: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Rows whose two participants disagree in vendor, session, interaction or source split, or whose stated
    participants are not those of the file names (checked where both columns are there)."""
    parts = ("vendor", "session", "interaction", "source_split")
    bad = [F.when(~F.col(f"p1_{c}").eqNullSafe(F.col(f"p2_{c}")), F.lit(c)) for c in parts]
    for n in (1, 2):
        if {f"participant{n}_id", f"p{n}_participant"} <= set(dyads.columns):
            named = canonical_participant_id(F.col(f"p{n}_participant"))
            bad.append(F.when(~F.col(f"participant{n}_id").eqNullSafe(named), F.lit(f"participant{n}")))
    return _rows(dyads.withColumn("_bad", F.concat_ws(",", *bad)).where("_bad <> ''"), "dyad_consistent", F.col(key), F.col("_bad"))


def intervals_sane(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    bad = df.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(end) < F.col(start)))
    return _rows(bad, "interval", F.concat_ws("|", *keys), F.when(F.col(start).isNull() | F.col(end).isNull(), "null bound").otherwise("inverted"))


def shards_complete(shards: DataFrame, expected: int, index: str = "shard", *, allow_partial: bool = False) -> DataFrame:
    """``shards`` has a row for each file with its index (null if its name has none); 0 expected means no count check."""
    spark = shards.sparkSession
    found = [_rows(shards.where(F.col(index).isNull()), "shard", F.lit(""), F.lit("unindexed"))]
    found.append(_rows(shards.where(F.col(index).isNotNull()).groupBy(index).count().where("count > 1"), "shard", F.col(index), F.lit("duplicate")))
    if expected:
        all_ = spark.range(expected).select(F.col("id").cast(shards.schema[index].dataType).alias(index))
        if not allow_partial:
            found.append(_rows(all_.join(shards, index, "left_anti"), "shard", F.col(index), F.lit("missing")))
        found.append(_rows(shards.where((F.col(index) >= expected) | (F.col(index) < 0)).select(index).distinct(), "shard", F.col(index), F.lit("extra")))
    return reduce(DataFrame.unionByName, found)


def not_empty(df: DataFrame, name: str) -> DataFrame:
    found = [("not_empty", name, "no rows")] if df.isEmpty() else []
    return df.sparkSession.createDataFrame(found, "check string, key string, detail string")


def fail_on_violation(violations: DataFrame, show: int = 5) -> None:
    found = violations.limit(show).collect()
    if found:
        raise ValueError("; ".join(f"{r.check}: {r.key}: {r.detail}" for r in found))


def observed(df: DataFrame, checks: Mapping[str, Column], *, unique: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df`` with counts of its violations taken while it is written: rows for which a check is not true.

    ``unique`` adds the count ``unique_key`` of rows whose key stands more than once. The counts, and ``rows``, are in the
    observation after the one job that writes ``df``.
    """
    seen = Observation()
    rows = df if not unique else df.withColumn("_many", F.count(F.lit(1)).over(W.partitionBy(*unique)))
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()]
    counts += [F.count_if(F.col("_many") > 1).alias("unique_key")] if unique else []
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).drop("_many"), seen


def write_checked(df: DataFrame, path: str, checks: Mapping[str, Column], *, unique: Sequence[str] = (), fail: bool = True) -> dict[str, int]:
    """Write ``df`` as a table and check it in the same job; the counts by check, with ``rows``.

    With ``fail`` a table with violations, or without a row, is an error and never gets its name.
    """
    spark = df.sparkSession
    rows, seen = observed(df, checks, unique=unique)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(staged)
        found = dict(seen.get)
        bad = [f"{name}: {n} of {found['rows']} rows" for name, n in found.items() if name != "rows" and n]
        if fail and (bad or not found["rows"]):
            raise ValueError("; ".join(bad) or "no rows")
        if not commits.rename_new(spark, staged, path):
            raise FileExistsError(path)
    finally:
        commits.delete(spark, staged)
    return found
