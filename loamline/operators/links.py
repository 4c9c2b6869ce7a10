"""Links between repositories: publishers, owners, routes, caps and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .usage import SCOPE_RANK, norm_name, rank_of


def owners(packages: DataFrame, repos: DataFrame) -> DataFrame:
    """ecosystem, norm, dst: the one repository that a package comes from.

    Live publishers come before archived ones; several of the same standing leave the owner open, and no row.
    """
    named = packages.select("repo_id", "ecosystem", norm_name(F.col("ecosystem"), F.col("name")).alias("norm")).distinct()
    known = named.join(repos.select("repo_id", "archived"), "repo_id")
    per = known.groupBy("ecosystem", "norm").agg(
        F.count_if(~F.col("archived")).alias("live"), F.count("*").alias("n"), F.max(F.when(~F.col("archived"), F.col("repo_id"))).alias("live_one"), F.max("repo_id").alias("any_one")
    )
    dst = F.when(F.col("live") == 1, F.col("live_one")).when((F.col("live") == 0) & (F.col("n") == 1), F.col("any_one"))
    return per.select("ecosystem", "norm", dst.alias("dst")).filter("dst is not null")


def routes(deps: DataFrame, packages: DataFrame, repos: DataFrame, top: int = 5) -> DataFrame:
    """src, dst, via, scope_rank: at most `top` routes of each pair, strongest scope first.

    Consumers that publish the package themselves are no consumers of it. Dependencies on packages without an owner, which are no
    links, go before anything is grouped: a package has one owner at most, so that the join adds no rows. The hash is one more key,
    so that the owners are shuffled anew after their aggregation and a package with very many consumers can be split.
    """
    norm = norm_name(F.col("ecosystem"), F.col("name"))
    key = F.xxhash64("ecosystem", "norm").alias("key")
    asked = deps.select(F.col("repo_id").alias("src"), "ecosystem", norm.alias("norm"), rank_of("scope", SCOPE_RANK, 0).alias("scope_rank")).select("*", key)
    owned = asked.join(owners(packages, repos).select("*", key), ["ecosystem", "norm", "key"]).filter("src <> dst")
    used = owned.groupBy("src", "dst", "ecosystem", "norm").agg(F.min("scope_rank").alias("scope_rank"))
    own = packages.select(F.col("repo_id").alias("src"), "ecosystem", norm.alias("norm")).distinct()
    linked = used.join(own, ["src", "ecosystem", "norm"], "left_anti")
    via = linked.select("src", "dst", F.concat_ws(" ", "ecosystem", "norm").alias("via"), "scope_rank")
    merged = via.groupBy("src", "dst", "via").agg(F.min("scope_rank").cast("int").alias("scope_rank"))
    place = F.row_number().over(W.partitionBy("src", "dst").orderBy("scope_rank", "via"))
    return merged.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def by_reference(references: DataFrame, repos: DataFrame) -> DataFrame:
    """src, dst, via, scope_rank of references (repo_id, kind, target as owner/repo in any case) to known repositories; none to itself."""
    asked = references.select(F.col("repo_id").alias("src"), "kind", F.lower("target").alias("target")).distinct()
    known = repos.select(F.col("repo_id").alias("dst"), F.lower("id").alias("target"))
    return asked.join(known, "target").filter("src <> dst").select("src", "dst", F.concat_ws(" ", "kind", "target").alias("via"), F.lit(0).alias("scope_rank"))


def most_relevant(links: DataFrame, repos: DataFrame, side: str, other: str, cap: int = 200) -> DataFrame:
    """At most `cap` links of each `side`: strongest scope, live repositories, name, route; with the true total."""
    standing = repos.select(F.col("repo_id").alias(other), F.col("archived").alias("other_archived"), F.lower("id").alias("other_id"))
    order = W.partitionBy(side).orderBy("scope_rank", "other_archived", "other_id", "via")
    ranked = links.join(standing, other).withColumns({"place": F.row_number().over(order).cast("int"), "total": F.count("*").over(W.partitionBy(side))})
    return ranked.filter(F.col("place") <= cap)


def used_by_totals(links: DataFrame) -> DataFrame:
    return links.groupBy("dst").agg(F.count("*").alias("links"), F.count_distinct("src").alias("used_by"))


def relationships(links: DataFrame, repo_id: int) -> DataFrame:
    """Both directions of one repository's links, labelled."""
    out = links.filter(F.col("src") == repo_id).select(F.lit("depends_on").alias("direction"), F.col("dst").alias("other"), "via", "scope_rank")
    inn = links.filter(F.col("dst") == repo_id).select(F.lit("used_by").alias("direction"), F.col("src").alias("other"), "via", "scope_rank")
    return out.union(inn)


def longest_prefix(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module: the longest known module that is the path or a parent of it (a/b/c, a/b, a), by equi-join on prefixes."""
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select("path").distinct().select("path", F.explode(prefixes).alias("module"))
    hits = each.join(modules.select("module").distinct(), "module")
    return hits.groupBy("path").agg(F.max_by("module", F.length("module")).alias("module"))


def duplicates(assets: DataFrame, least_words: int = 10, shown: int = 20) -> DataFrame:
    """id, duplicate_count, duplicates: other assets with the same content; counts exact, ids the first `shown`.

    Ids of a group come from its `shown` + 1 smallest, so that a group of any size passes through no task as a whole.
    """
    fit = assets.filter(F.col("content_sha").isNotNull() & (F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")) >= least_words)).select("id", "content_sha")
    sizes = fit.groupBy("content_sha").agg(F.count("*").alias("n")).filter("n > 1")
    place = F.row_number().over(W.partitionBy("content_sha").orderBy("id"))
    heads = fit.withColumn("place", place).filter(F.col("place") <= shown + 1).groupBy("content_sha").agg(F.array_sort(F.collect_list("id")).alias("heads"))
    others = F.slice(F.array_except("heads", F.array("id")), 1, shown)
    return fit.join(sizes, "content_sha").join(heads, "content_sha").select("id", (F.col("n") - 1).alias("duplicate_count"), F.array_join(others.cast("array<string>"), ",").alias("duplicates"))


def alias_groups(advisories: DataFrame, rounds: int = 60) -> DataFrame:
    """id, group_id: advisories that share an alias, directly or through others, are one group. advisories: id, aliases.

    Every round takes the smallest label of all that share an alias and then jumps to that label's own label, so that long
    chains settle in few rounds; labels that have not settled after `rounds` are an error, not a result. Only aliases of two
    advisories and more link any; they are found once, and the rounds read these alone.
    """
    pairs = advisories.select("id", F.explode(F.array_union(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).distinct()
    shared = pairs.groupBy("alias").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("alias")
    linked = pairs.join(shared, "alias").checkpoint()
    labels = linked.select("id").distinct().withColumn("group_id", F.col("id"))
    for _ in range(rounds):
        own = linked.join(labels, "id")
        by_alias = own.groupBy("alias").agg(F.min("group_id").alias("low"))
        near = own.join(by_alias, "alias").groupBy("id").agg(F.min("low").alias("low"), F.min("group_id").alias("before"))
        jump = labels.select(F.col("id").alias("low"), F.col("group_id").alias("far"))
        lower = F.least("low", "far")
        new = near.join(jump, "low", "left").select("id", lower.alias("group_id"), (lower < F.col("before")).alias("moved")).checkpoint()
        labels = new.select("id", "group_id")
        if new.filter("moved").isEmpty():
            return advisories.select("id").filter("id is not null").distinct().join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    raise RuntimeError("alias groups did not settle")
