"""Incremental batches: what changed between two snapshots, what to keep of failures, what to prune."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows of now that before lacks or holds with another value in a common column; null equals null."""
    columns = [c for c in now.columns if c != key and c in before.columns]
    old = before.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], F.lit(True))
    return now.join(old, (F.col(key) == F.col("_key")) & same, "left_anti")


def keep_last_good(new: DataFrame, before: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """New records, but for failed ones (a boolean column of new) the record before, where there is one."""
    good = new.filter(~F.col(failed)).drop(failed)
    kept = before.join(new.filter(failed).select(key), key, "left_semi").select(good.columns)
    first = new.filter(failed).join(before.select(key), key, "left_anti").drop(failed)
    return good.unionByName(kept).unionByName(first)


def prune(records: DataFrame, listed: DataFrame, complete_owners: DataFrame, key: str = "id", owner: str = "owner") -> DataFrame:
    """Records without those of completely listed owners that the listing no longer holds; other owners are untouched."""
    gone = records.join(complete_owners.select(owner).distinct(), owner, "left_semi").join(listed.select(key), key, "left_anti")
    return records.join(gone.select(key), key, "left_anti")
