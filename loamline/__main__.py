"""python -m loamline build|search|assets|blocks|deps|flags|repo|links|sql: JSON lines on standard output."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loamline", description=__doc__)
    p.add_argument("--tables", required=True, help="folder of the built tables")
    p.add_argument("--limit", type=int, default=15)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("checkouts", help="folder with one folder for each owner, holding one for each repository")
    for name in ("search", "assets", "blocks"):
        sub.add_parser(name).add_argument("query", nargs="?", default="")
    for name in ("deps", "repo", "links", "sql"):
        sub.add_parser(name).add_argument("what")
    sub.add_parser("flags").add_argument("--severity")
    a = p.parse_args(argv)

    from .inventory import Inventory

    spark = SparkSession.builder.appName("loamline").getOrCreate()
    inventory = Inventory(spark, a.tables)
    if a.command == "build":
        from .build import build
        from .sources.checkouts import files

        listed = files(spark, a.checkouts, depth=2)
        listed.write.mode("overwrite").parquet(f"{a.tables}/files")
        stored = spark.read.parquet(f"{a.tables}/files")
        repos = stored.select("repo_id").distinct().select("repo_id", F.col("repo_id").alias("id"), F.element_at(F.split("repo_id", "/"), -1).alias("name"), F.get(F.split("repo_id", "/"), F.lit(0)).alias("owner"), F.lit(False).alias("archived"), F.lit(None).cast("timestamp").alias("pushed_at"), F.lit(None).cast("string").alias("description"))
        build(stored, repos, a.tables)
        return 0
    run = {
        "search": lambda: inventory.search_repos(a.query, limit=a.limit), "assets": lambda: inventory.search_assets(a.query, limit=a.limit), "blocks": lambda: inventory.find_building_blocks(a.query, limit=a.limit),
        "deps": lambda: inventory.dependency_usage(a.what, limit=a.limit), "flags": lambda: inventory.list_flags(severity=a.severity, limit=a.limit), "repo": lambda: inventory.get_repo(a.what), "links": lambda: inventory.relationships(a.what, a.limit), "sql": lambda: inventory.sql(a.what, a.limit),
    }
    out = run[a.command]()
    rows = [r.asDict(recursive=True) for r in out.collect()] if isinstance(out, DataFrame) else out if isinstance(out, list) else [out]
    for row in rows:
        print(json.dumps(row, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
