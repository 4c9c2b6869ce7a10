"""Sinks: tables as Parquet clustered by their lookup key, records as JSON, lists as CSV; unchanged data is not rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell

#: The column that each table is mostly looked up by.
LOOKUP = {"dependencies": "norm_name", "repo_links": "depends_on", "ai_assets": "id", "repos": "id"}


def write_table(df: DataFrame, path: str, name: str) -> None:
    """Range-partitioned and sorted by the lookup column, so that min and max of row groups prune point lookups."""
    key = LOOKUP.get(name)
    out = df.repartitionByRange(F.col(key)).sortWithinPartitions(key) if key else df
    out.write.mode("overwrite").parquet(f"{path}/{name}")


def digest(df: DataFrame, key: str) -> DataFrame:
    rest = [c for c in sorted(df.columns) if c != key]
    return df.withColumn("_digest", F.xxhash64(*[F.to_json(F.struct(c)) for c in rest]))


def changed_rows(df: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows that the stored table lacks or holds with other contents."""
    old = digest(stored, key).select(key, "_digest")
    return digest(df, key).join(old, [key, "_digest"], "left_anti").drop("_digest")


def write_json(df: DataFrame, path: str, by: str = "owner") -> None:
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Cells guarded against formulas. Quoting is done here, since the writer would not know of the guard."""
    cells = [F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode("overwrite").text(path, lineSep="\r\n")
