"""Usage aggregates over dependencies, technologies, findings and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of severities and scopes.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
SCOPE_RANK = {"runtime": 0, "peer": 0, "optional": 1, "dev": 2, "build": 3, "transitive": 4}


def rank_of(column: str | Column, ranks: dict[str, int], other: int) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    out = None
    for value, rank in ranks.items():
        out = F.when(col == value, rank) if out is None else out.when(col == value, rank)
    return out.otherwise(other)


def norm_name(ecosystem: Column, name: Column) -> Column:
    """The name a package is looked up by: lower case, and for PyPI runs of - _ . as one hyphen."""
    return F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(F.lower(name))


def technology_usage(tech: DataFrame) -> DataFrame:
    return tech.groupBy("category", "name").agg(F.count_distinct("repo_id").alias("repo_count"))


def flag_summary(flags: DataFrame) -> DataFrame:
    out = flags.groupBy("flag_id", "severity").agg(F.count("*").alias("n"), F.count_distinct("repo_id").alias("repos"))
    return out.withColumn("severity_rank", rank_of("severity", SEVERITY_RANK, 3)).orderBy("severity_rank", F.desc("n"), "flag_id")


def dependency_usage(deps: DataFrame) -> DataFrame:
    """Repositories and declared versions of every package."""
    versions = F.array_join(F.array_sort(F.collect_set("version")), ",")
    return deps.groupBy("ecosystem", "name").agg(F.count_distinct("repo_id").alias("repo_count"), versions.alias("versions"), F.min(norm_name(F.col("ecosystem"), F.col("name"))).alias("norm_name"))


def dependency_versions(deps: DataFrame) -> DataFrame:
    """Versions in use of packages that several repositories depend on directly."""
    used = deps.filter("scope <> 'transitive'").withColumn("v", F.coalesce("resolved", "version")).filter("v is not null")
    versions = F.collect_set("v")
    out = used.groupBy("ecosystem", "name").agg(F.count_distinct("repo_id").alias("repo_count"), F.size(versions).cast("long").alias("version_count"), F.array_join(F.array_sort(versions), ",").alias("versions"))
    return out.filter("repo_count > 1")


def major(version: Column) -> Column:
    """The part of a version that marks breaking changes: the major number, 0.minor below 1.0."""
    first = F.regexp_extract(version, r"(\d+)", 1)
    return F.when(first == "0", F.concat(F.lit("0."), F.coalesce(F.nullif(F.regexp_extract(version, r"\d+\.(\d+)", 1), F.lit("")), F.lit("0")))).otherwise(F.nullif(first, F.lit("")))


def version_drift(deps: DataFrame, repos: DataFrame, limit: int = 15) -> DataFrame:
    """Packages that live repositories use directly in several majors, widest use first.

    Two aggregations on nested keys: distinct (package, major, repository) first, so that neither step sees duplicates.
    """
    live = repos.filter("not archived").select("repo_id")
    used = deps.filter("scope <> 'transitive' and ecosystem <> 'github-actions'").join(live, "repo_id")
    each = used.select("ecosystem", "name", "repo_id", major(F.coalesce("resolved", "version")).alias("major")).filter("major is not null").distinct()
    by_major = each.groupBy("ecosystem", "name", "major").agg(F.count("*").alias("n"))
    repos_of = each.groupBy("ecosystem", "name").agg(F.count_distinct("repo_id").alias("repo_count"))
    spread = by_major.groupBy("ecosystem", "name").agg(F.count("*").alias("major_count"), F.array_join(F.array_sort(F.collect_list(F.concat("major", F.lit(":"), "n"))), ",").alias("majors"))
    both = spread.join(repos_of, ["ecosystem", "name"]).filter("major_count > 1 and repo_count > 1")
    return both.orderBy(F.desc("repo_count"), F.desc("major_count"), "ecosystem", "name").limit(limit)


def dependency_lookup(deps: DataFrame, repos: DataFrame, name: str, *, ecosystem: str | None = None, version_prefix: str | None = None, include_transitive: bool = True, limit: int = 200) -> DataFrame:
    """Who depends on a package, live repositories first: names compare as their ecosystem compares them."""
    wanted = norm_name(F.col("ecosystem"), F.lit(name))
    hits = deps.filter(norm_name(F.col("ecosystem"), F.col("name")) == wanted)
    if ecosystem is not None:
        hits = hits.filter(F.col("ecosystem") == ecosystem)
    if version_prefix is not None:
        hits = hits.filter(F.lower(F.coalesce("resolved", "version")).startswith(version_prefix.lower()))
    if not include_transitive:
        hits = hits.filter("scope <> 'transitive'")
    out = hits.join(repos.select("repo_id", "id", "lifecycle", "archived"), "repo_id")
    order = ["archived", "id", "scope", "name", "manifest", "version"]
    return out.orderBy(*order).select("id", "ecosystem", "name", "version", "resolved", "scope", "manifest", "lifecycle", "archived").limit(max(1, min(limit, 2000)))


def repos_using(tech: DataFrame, deps: DataFrame, repos: DataFrame, name: str, limit: int = 500) -> DataFrame:
    """Repositories with a technology or package of that name, without regard to case, with what matched."""
    t = tech.filter(F.lower("name") == name.lower()).select("repo_id", "category", F.col("name").alias("matched"))
    category = F.when(F.col("scope") == "transitive", "transitive dependency").otherwise("dependency")
    d = deps.filter(F.lower("name") == name.lower()).select("repo_id", category.alias("category"), F.concat_ws(" ", "name", F.coalesce("resolved", "version")).alias("matched"))
    hits = t.union(d).distinct().join(repos.select("repo_id", "id"), "repo_id")
    return hits.select("id", "category", "matched").orderBy("id", "category", "matched").limit(limit)


def dependency_summary(deps: DataFrame) -> DataFrame:
    """Per repository: direct and transitive counts, share of direct dependencies with a resolved version, ecosystems."""
    direct = F.col("scope") != "transitive"
    return deps.groupBy("repo_id").agg(
        F.count_if(direct).alias("direct"),
        F.count_if(~direct).alias("transitive"),
        F.count_distinct("ecosystem").alias("ecosystems"),
        F.bround(F.count_if(direct & F.col("resolved").isNotNull()) / F.count_if(direct), 3).alias("lockfile_coverage"),
    )


def practice_score(checks: DataFrame) -> DataFrame:
    """Weighted share of passed checks, rounded half to even, with its grade. checks: repo_id, passed, weight."""
    score = F.bround(100.0 * F.sum(F.col("weight") * F.col("passed").cast("int")) / F.sum("weight"), 0).cast("int")
    out = checks.groupBy("repo_id").agg(score.alias("score"))
    grade = F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return out.withColumn("grade", grade)


def language_stats(files: DataFrame) -> DataFrame:
    """Lines and their share by language. files: repo_id, language, lines."""
    per = files.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))
    total = F.sum("lines").over(W.partitionBy("repo_id"))
    return per.withColumn("percent", F.bround(100.0 * F.col("lines") / total, 1))


def contributors(history: DataFrame, top: int = 10) -> DataFrame:
    """Most active authors of each repository."""
    per = history.groupBy("repo_id", "author").agg(F.count("*").alias("commits"), F.min("at").alias("first_commit"), F.max("at").alias("last_commit"))
    order = W.partitionBy("repo_id").orderBy(F.desc("commits"), "author")
    return per.withColumn("place", F.row_number().over(order).cast("int")).filter(F.col("place") <= top)


#: How accounts of bots are named.
BOTS = r"(?i)\[bot\]|-bot$|^(dependabot|renovate|github-actions)\b"


def bus_factor(history: DataFrame, least: int = 30, share: float = 0.9) -> DataFrame:
    """Repositories where one author holds `share` of at least `least` commits, and that share. Bots are no authors."""
    people = history.filter(~F.rlike(F.coalesce(F.col("author").cast("string"), F.lit("")), F.lit(BOTS)))
    per = people.groupBy("repo_id", "author").agg(F.count("*").alias("commits"))
    out = per.groupBy("repo_id").agg(F.sum("commits").alias("total"), F.max("commits").alias("top"))
    return out.withColumn("percent", F.floor(100.0 * F.col("top") / F.col("total")).cast("long")).withColumn("flagged", (F.col("total") >= least) & (F.col("top") >= share * F.col("total")))


def file_history(history: DataFrame) -> DataFrame:
    """Per path: number of changes, first and last change, and who made the last one."""
    last = F.max(F.struct("at", "commit_id", "author"))
    return history.groupBy("repo_id", "path").agg(F.count("*").alias("changes"), F.min("at").alias("added"), F.max("at").alias("modified"), last["author"].alias("modified_by"))


def lifecycle(as_of: Column, last_change: Column, archived: Column, deprecated: Column) -> Column:
    """Archived, deprecated, stale after a year, maintained after ninety days, else active."""
    age = F.datediff(as_of, last_change)
    return F.when(archived, "archived").when(deprecated, "deprecated").when(last_change.isNull(), "active").when(age > 365, "stale").when(age > 90, "maintained").otherwise("active")


def eol_severity(as_of: Column, ends: Column) -> Column:
    """Severity of a support end: more than a year ago high, past medium, within 180 days low, else null."""
    days = F.datediff(as_of, ends)
    return F.when(days > 365, "high").when(days > 0, "medium").when(days >= -180, "low")
