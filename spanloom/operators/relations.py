"""Joins and set operations with a stated contract."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, failing the job where a key repeats; counts are combined before the shuffle."""
    twice = rows.groupBy(key).agg(F.count("*").alias("_n"))
    checked = twice.filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit(f"{key} repeats: "), F.col(key).cast("string"))).isNull())
    return rows.join(checked.select(key), key, "left_semi")


def join_one_to_one(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Inner join that fails the job if the key repeats on either side."""
    return unique(a, key).join(unique(b, key), key)


def missing(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def first_found(rows: DataFrame, sides: list[DataFrame], key: str, col: str) -> DataFrame:
    """Adds col from the first of the sides that has the key; null if none has."""
    found = reduce(lambda df, k: df.join(sides[k].select(key, F.col(col).alias(f"_{k}")), key, "left"), range(len(sides)), rows)
    return found.withColumn(col, F.coalesce(*(F.col(f"_{k}") for k in range(len(sides))))).drop(*(f"_{k}" for k in range(len(sides))))


def overwrite(base: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """base with cols replaced where new has the key."""
    fresh = new.select(key, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in cols))
    return base.join(fresh, key, "left").withColumns({c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).drop("_new", *(f"_{c}" for c in cols))


def has_all(have: Column, need: list[str]) -> Column:
    return F.forall(F.array(*map(F.lit, need)), lambda k: F.array_contains(have, k))


def mirror_diff(local: DataFrame, remote: DataFrame, key: str, value: str) -> DataFrame:
    """key and status: only_local, only_remote, differs or same."""
    a, b = local.select(F.col(key).alias("_a"), F.col(value).alias("_v")), remote.select(F.col(key).alias("_b"), F.col(value).alias("_w"))
    status = F.when(F.col("_a").isNull(), "only_remote").when(F.col("_b").isNull(), "only_local").when(~F.col("_v").eqNullSafe(F.col("_w")), "differs").otherwise("same")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def merge_report(staging: DataFrame, canonical: DataFrame, key: str, value: str) -> DataFrame:
    """key and status of each staged row: added, conflict or known. Nothing is ever overwritten."""
    known = canonical.select(key, F.lit(True).alias("_known"), F.col(value).alias("_v"))
    status = F.when(F.col("_known").isNull(), "added").when(~F.col(value).eqNullSafe(F.col("_v")), "conflict").otherwise("known")
    return staging.join(known, key, "left").select(key, status.alias("status"))
