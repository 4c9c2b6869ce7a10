"""Export shapes: SBOM components, AI bill of materials, component descriptors, slim lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .usage import SCOPE_RANK, rank_of


def sbom_components(deps: DataFrame) -> DataFrame:
    """One component per package of a repository, with its strongest scope. deps: repo_id, ecosystem, name, scope."""
    ref = F.concat(F.lit("pkg:"), F.lower("ecosystem"), F.lit("/"), F.col("name"))
    return deps.groupBy("repo_id", ref.alias("ref")).agg(F.min_by("scope", rank_of("scope", SCOPE_RANK, 5)).alias("scope"), F.count("*").alias("n"))


def ai_bom(models: DataFrame, sdks: DataFrame, assets: DataFrame) -> DataFrame:
    """Components of three sources (ref, name, kind), the first source that names a ref wins."""
    each = None
    for place, df in enumerate((models, sdks, assets)):
        one = df.select("ref", "name", "kind", F.lit(place).alias("place"))
        each = one if each is None else each.union(one)
    return each.groupBy("ref").agg(F.min(F.struct("place", "name", "kind")).alias("x")).select("ref", "x.name", "x.kind")


def component_names(repos: DataFrame) -> DataFrame:
    """A component name for each repository: its declared or own name in the permitted letters, with the owner where two repositories share it.

    repos: id, name, owner, declared (nullable).
    """
    clean = lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^a-z0-9\-_.]+", "-"), 1, 63)
    named = repos.withColumn("component", clean(F.coalesce("declared", "name")))
    alone = F.count("*").over(W.partitionBy("component")) == 1
    return named.select("id", F.when(alone | F.col("declared").isNotNull(), F.col("component")).otherwise(clean(F.concat_ws("-", "owner", "name"))).alias("component"))


def slim(repos: DataFrame, deps: DataFrame, links: DataFrame) -> DataFrame:
    """Repositories with the derived columns that list views show."""
    names = deps.filter("scope <> 'transitive'").groupBy("repo_id").agg(F.array_sort(F.collect_set("name")).alias("dependency_names"))
    used = links.groupBy(F.col("dst").alias("repo_id")).agg(F.count_distinct("src").alias("used_by_count"))
    out = repos.join(names, "repo_id", "left").join(used, "repo_id", "left")
    return out.withColumns({"dependency_names": F.coalesce("dependency_names", F.array().cast("array<string>")), "used_by_count": F.coalesce("used_by_count", F.lit(0))})
