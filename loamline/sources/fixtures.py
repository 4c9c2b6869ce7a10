"""Bindings: repository-shaped tables over the driver's tables, and the same bindings as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier as a repository of its nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey)), s.s_nationkey == n.n_nationkey)
    owner = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    return joined.select(
        F.col("s_suppkey").alias("repo_id"),
        F.concat(owner, F.lit("/"), F.col("s_name")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("owner"),
        F.col("r_name").alias("lifecycle"),
        F.floor(F.abs("s_acctbal") / 100.0).cast("int").alias("practices_score"),
        (F.col("s_acctbal") < 0).alias("archived"),
    )


REPOS = """repos AS (
  SELECT s.s_suppkey AS repo_id, concat(lower(replace(n.n_name, ' ', '-')), '/', s.s_name) AS id, s.s_name AS name, n.n_name AS owner,
    r.r_name AS lifecycle, CAST(floor(abs(s.s_acctbal) / 100.0) AS INT) AS practices_score, s.s_acctbal < 0 AS archived
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey)"""

def _scope() -> Column:
    return F.when(F.col("l_returnflag") == "N", "runtime").when(F.col("l_returnflag") == "A", "dev").otherwise("transitive")


def deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a dependency of its supplier on its part."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    version = F.concat(F.col("l_linenumber").cast("string"), F.lit("."), F.col("l_quantity").cast("int").cast("string"))
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("repo_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("ecosystem"),
        version.alias("version"),
        F.when(F.col("l_linestatus") == "F", F.concat(version, F.lit(".0"))).alias("resolved"),
        _scope().alias("scope"),
        F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("manifest"),
    )


DEPS = """deps AS (
  SELECT l.l_suppkey AS repo_id, p.p_name AS name, p.p_type AS ecosystem,
    concat(CAST(l.l_linenumber AS VARCHAR), '.', CAST(CAST(l.l_quantity AS INT) AS VARCHAR)) AS version,
    CASE WHEN l.l_linestatus = 'F' THEN concat(CAST(l.l_linenumber AS VARCHAR), '.', CAST(CAST(l.l_quantity AS INT) AS VARCHAR), '.0') END AS resolved,
    CASE l.l_returnflag WHEN 'N' THEN 'runtime' WHEN 'A' THEN 'dev' ELSE 'transitive' END AS scope,
    concat('order-', CAST(l.l_orderkey AS VARCHAR)) AS manifest
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same line items as dependencies on packages that suppliers publish."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    name = F.concat(F.lit("pkg-"), (F.col("l_partkey") % 1450).cast("string"))
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("repo_id"), F.col("p_type").alias("ecosystem"), name.alias("name"), _scope().alias("scope"))


PACKAGE_DEPS = """package_deps AS (
  SELECT l.l_suppkey AS repo_id, p.p_type AS ecosystem, concat('pkg-', CAST(l.l_partkey % 1450 AS VARCHAR)) AS name,
    CASE l.l_returnflag WHEN 'N' THEN 'runtime' WHEN 'A' THEN 'dev' ELSE 'transitive' END AS scope
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)"""


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a package published by one of the suppliers; some names are published twice."""
    n = table(spark, sf_dir, "supplier").count()
    name = F.concat(F.lit("pkg-"), (F.col("p_partkey") % 1450).cast("string"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % n).alias("repo_id"), F.col("p_type").alias("ecosystem"), name.alias("name"))


PACKAGES = """packages AS (
  SELECT p_partkey % (SELECT count(*) FROM supplier) AS repo_id, p_type AS ecosystem, concat('pkg-', CAST(p_partkey % 1450 AS VARCHAR)) AS name FROM part)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as an asset of its source."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("source").alias("repo"), F.col("lang").alias("kind"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_sha"))


ASSETS = "assets AS (SELECT doc_id AS id, source AS repo, lang AS kind, text AS content, sha256(text) AS content_sha FROM documents)"


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a finding in its user's repository."""
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("event_type") == "error", "high").when(F.col("event_type") == "purchase", "medium").otherwise("low")
    return e.select("event_id", F.col("user_id").alias("repo_id"), F.col("event_type").alias("flag_id"), severity.alias("severity"), "ts")


FLAGS = """flags AS (
  SELECT event_id, user_id AS repo_id, event_type AS flag_id,
    CASE event_type WHEN 'error' THEN 'high' WHEN 'purchase' THEN 'medium' ELSE 'low' END AS severity, ts FROM events)"""


def tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's nation as a technology of the customer, by market segment."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("repo_id"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("name"))


TECH = "tech AS (SELECT c_custkey AS repo_id, c_mktsegment AS category, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a commit of its customer, on a path made of its priority."""
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("repo_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("commit_id"))


HISTORY = "history AS (SELECT o_custkey % 50 AS repo_id, o_custkey AS author, o_orderdate AS at_, o_orderpriority AS path, o_orderkey AS commit_id FROM orders)"
