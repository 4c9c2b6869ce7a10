"""Containment and nearness of paths, and servers behind configured names.

A path is taken apart into the folders above it, so that "lies in" is an equi-join instead of a comparison of all pairs. The path
that shares most leading folders is found the same way: each deeper shared folder is one more key, and the deepest hit counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left join right on keys, where right is aggregated by the same keys: a hash of them as one more key shuffles it anew, so that
    adaptive execution can split a key that many rows of left share."""
    extra = F.xxhash64(*keys)
    return left.withColumn("__key", extra).join(right.withColumn("__key", extra), [*keys, "__key"], how).drop("__key")


def folders(path: Column) -> Column:
    """The folders above a path, the root ("") first, none with a closing slash; the path itself is not among them."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def owning_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (repo_id, path, ...) with `root`: the deepest of roots (repo_id, root) that the path lies in, null if there is none.

    A root lies in itself only if it is a folder above the path: "a/b" holds "a/b/c" and neither "a/b" nor "a/bc". Repeated rows stay.
    """
    paths = files.select("repo_id", "path").distinct()
    known = roots.select("repo_id", F.array_join(F.filter(F.split("root", "/"), lambda p: p != ""), "/").alias("root")).distinct()
    above = paths.withColumn("root", F.explode(folders(F.col("path"))))
    best = _split_join(above, known, ["repo_id", "root"]).groupBy("repo_id", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return _split_join(files, best, ["repo_id", "path"], "left")


def closest(files: DataFrame, places: DataFrame) -> DataFrame:
    """repo_id, path, place, shared for each distinct path of files: the place (repo_id, place) that shares most leading parts with it.

    Of places alike the smallest counts. A place in another branch shares the root only (shared = 0); null without any place. A folder
    keeps one place, its smallest, so that however many lie below it a path meets one row for each of its folders.
    """
    paths = files.select("repo_id", "path").distinct()
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    steps = lambda c: F.transform(F.sequence(F.lit(0), F.size(c)), lambda n: F.struct(n.alias("shared"), F.array_join(F.slice(c, 1, n), "/").alias("at")))
    least = places.select("repo_id", "place", F.explode(steps(F.filter(F.split("place", "/"), lambda p: p != ""))).alias("s"))
    least = least.groupBy("repo_id", "s.shared", "s.at").agg(F.min("place").alias("place"))
    asked = paths.withColumn("s", F.explode(steps(parts))).select("repo_id", "path", "s.shared", "s.at")
    near = _split_join(asked, least, ["repo_id", "shared", "at"]).groupBy("repo_id", "path").agg(F.max_by(F.struct("place", "shared"), "shared").alias("p"))
    return paths.join(near, ["repo_id", "path"], "left").select("repo_id", "path", "p.place", "p.shared")


def configured_servers(configs: DataFrame, publishers: DataFrame, providers: DataFrame) -> DataFrame:
    """repo_id, server, target for each server that a repository of ours stands behind.

    configs: repo_id, server, ecosystem, package (null where no package is launched), url. publishers: repo_id, ecosystem, package, the
    owner of each package. providers: repo_id, server. A launched package decides, and if nobody of ours publishes it, or several do, there
    is no target; a URL leads elsewhere; else the name decides if exactly one repository provides it. Nothing links to itself.
    """
    lone = lambda df, keys: df.groupBy(*keys).agg(F.min("repo_id").alias("target"), F.max("repo_id").alias("last")).filter("target = last").drop("last")
    rows = configs.select("repo_id", "server", "ecosystem", "package", "url").distinct()
    by_package = _split_join(rows.filter("package is not null"), lone(publishers.filter("package is not null"), ["ecosystem", "package"]), ["ecosystem", "package"])
    folded = providers.filter("server is not null").select("repo_id", F.lower("server").alias("low"))
    by_name = _split_join(rows.filter("package is null and url is null").withColumn("low", F.lower("server")), lone(folded, ["low"]), ["low"])
    out = ["repo_id", "server", "target"]
    return by_package.select(out).union(by_name.select(out)).filter("repo_id <> target").distinct()
