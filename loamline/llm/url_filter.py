"""URL filters by a sort-merge range join, in DataFrame operations only.

A rule (host, path) stands for the interval of keys that start with its key: the host's labels reversed, then the path. A
URL has a key for its host and for each parent domain of as many labels as some rule has, since a rule also fits
subdomains. Rules open and close intervals; openings, closings and keys are sorted together and swept. Prefix
intervals nest, so the sweep needs a stack only: the number of open intervals is the stack's height, and its top is the
last rule that opened at that height. Both are window functions over the sorted rows.

Keys, openings and closings are range-partitioned together, so that a partition sweeps the rules that lie in it and, opened anew
at its start, those that reach into it from before: at any place no more than nest there. Keys alike go on by a hash of
the URL, so that a key which many hosts share (a parent domain with a common path) is split as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_split, spread

#: (host, path, verdict) of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: both empty where the URL is null or has no ://."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(text, _PARTS, 2)


def _key(labels: Column, path: Column) -> Column:
    """Binary, as bytes sort like prefixes: reversed labels, each with a closing dot, a slash mark, the path."""
    return F.concat(F.concat_ws(".", F.reverse(labels)), F.lit("\x01"), path).cast("binary")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url).

    rules: (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with its path; the
    longest host and path win; of rules alike, block wins. Without a rule, rule is null and the verdict is `default`.
    Rules with null host or path fit nothing. Repeated pages are judged once and returned each. URLs of any length are
    judged whole; other columns of pages are not read.
    """
    host, path = url_parts(F.col("url"))
    asked = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.filter("host is not null and path is not null").groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    levels = rules.select(F.size(F.split("host", r"\.")).alias("n")).distinct()
    depths = sorted(r.n for r in levels.collect())  # one number for each depth that rules have, of however many labels
    labels = F.split("host", r"\.")
    distinct = asked.groupBy("host", "path").agg(F.count("*").alias("n"))
    # one key for each parent domain of a depth that rules have
    n = F.size(labels)
    parents = F.transform(F.filter(F.array(*[F.lit(d) for d in depths]) if depths else F.array().cast("array<int>"), lambda d: d <= n), lambda d: F.slice(labels, n - d + 1, d))
    keys = distinct.select("host", "path", F.explode(parents).alias("of"))
    none, no_rule = F.lit(None).cast("string"), F.lit(None).cast("struct<rule:string,verdict:string>")
    found = keys.select(_key(F.col("of"), F.col("path")).alias("at"), F.lit(1).alias("turn"), F.xxhash64("host", "path").alias("salt"), F.lit(0).alias("step"), "host", "path", F.lit(None).cast("binary").alias("key"), no_rule.alias("opened"))

    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    edges = rules.select(_key(labels, F.col("path")).alias("key"), rule.alias("opened"))
    edge = lambda at, step, opened: edges.select(at.alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("salt"), F.lit(step).alias("step"), none.alias("host"), none.alias("path"), "key", opened.alias("opened"))
    # 0xFF is no byte of UTF-8, so a closing lies behind every key with the prefix; a longer key's closing sorts before its
    # parent's, as 0xFF is larger than any byte that follows the parent's prefix
    rows = spread(found.union(edge(F.col("key"), 1, F.col("opened"))).union(edge(F.concat("key", F.unhex(F.lit("FF"))), -1, no_rule)), "at", "turn", "salt")
    reach = rows.filter("turn = 0").groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.max("opened").alias("opened")).filter("first < last")
    again = reach.select("key", "opened", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("part"))
    again = again.select(F.col("key").alias("at"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("salt"), F.lit(1).alias("step"), none.alias("host"), none.alias("path"), "key", "opened", "part")
    height = rows.union(again).withColumn("height", F.sum("step").over(W.partitionBy("part").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)))
    stack = W.partitionBy("part", "height").orderBy("at", "turn").rowsBetween(W.unboundedPreceding, 0)
    swept = height.withColumn("top", F.last("opened", ignorenulls=True).over(stack)).filter("turn = 1 and height > 0")
    best = swept.groupBy("host", "path").agg(F.max_by("top", F.struct(F.length("top.rule"), "top.rule")).alias("top"))
    judged = join_split(asked, best, ["host", "path"], "left")  # URLs without a host, or repeated ones, are one key
    return judged.select("page_id", "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    """A few rules given as literals."""
    text = lambda v, name: F.lit(v).cast("string").alias(name)
    return spark.range(1).select(F.inline(F.array(*[F.struct(text(h, "host"), text(p, "path"), text(v, "verdict")) for h, p, v in rules])))
