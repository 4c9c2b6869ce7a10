"""Known vulnerabilities of resolved dependencies: joins with an advisory table, one finding for each issue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.packages import cvss3, cvss_severity
from ..functions.versions import sort_key
from .links import alias_groups
from .usage import SEVERITY_RANK, norm_name, rank_of


def severities(advisories: DataFrame) -> DataFrame:
    """id, severity: the label, else the highest CVSS v3 or plain score, else medium."""
    label = F.upper(F.coalesce("severity_label", F.lit("")))
    named = F.when(label.isin("CRITICAL", "HIGH"), "high").when(label.isin("MODERATE", "MEDIUM"), "medium").when(label == "LOW", "low")
    score = F.array_max(F.transform(F.coalesce("cvss", F.array().cast("array<string>")), lambda v: F.when(F.startswith(v, F.lit("CVSS:3")), cvss3(v)).otherwise(F.try_to_number(v, F.lit("99.9")).cast("double"))))
    return advisories.select("id", F.coalesce(named, cvss_severity(score), F.lit("medium")).alias("severity"))


def affected(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """repo_id, ecosystem, name, resolved, id, fixed: dependencies at a version that an advisory names, one row each."""
    each = advisories.select("id", F.explode("affected").alias("a")).select("id", "a.ecosystem", norm_name(F.col("a.ecosystem"), F.col("a.name")).alias("norm"), "a.fixed", F.explode("a.versions").alias("resolved"))
    used = deps.filter("resolved is not null").withColumn("norm", norm_name(F.col("ecosystem"), F.col("name")))
    return used.join(each, ["ecosystem", "norm", "resolved"]).select("repo_id", "ecosystem", "name", "resolved", "id", "fixed").distinct()


def findings(deps: DataFrame, advisories: DataFrame, most: int = 50) -> DataFrame:
    """At most `most` findings of a repository, worst first: one for each package version and issue.

    Advisories that share an alias are one issue with the worst severity; fixed versions are listed in version order.
    """
    groups = alias_groups(advisories.select("id", "aliases"))
    hits = affected(deps, advisories).join(groups, "id").join(severities(advisories), "id")
    rank = rank_of("severity", SEVERITY_RANK, 1)
    # distinct fixed versions of the issue, collected from its few advisories
    fixed = F.array_distinct(F.flatten(F.collect_list("fixed")))
    ordered = F.transform(F.array_sort(F.transform(fixed, lambda v: F.struct(sort_key(v).alias("k"), v.alias("v")))), lambda s: s["v"])
    per = hits.groupBy("repo_id", "ecosystem", "name", "resolved", "group_id").agg(F.min_by("severity", rank).alias("severity"), F.array_join(F.array_sort(F.collect_set("id")), " ").alias("ids"), ordered.alias("fixed"))
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(rank, "name", "resolved", "group_id"))
    return per.withColumn("place", place).filter(F.col("place") <= most).drop("place")
