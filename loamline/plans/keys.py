"""Registered queries of the search box's keys: each key is asked once or more, and its rows stand beside what was asked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filter_keys
from ..sources import fixtures as fx
from .tables import with_

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: What is asked of repositories, and the condition that says the same.
REPOS = {
    "lang:LANG-1": "primary_language = 'lang-1'",
    "anylang:machinery": "repo_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
    "fw:nation_3": "repo_id IN (SELECT repo_id FROM tech WHERE category = 'BUILDING' AND name = 'NATION_3')",
    "data:nation_1*": "repo_id IN (SELECT repo_id FROM tech WHERE category = 'MACHINERY' AND name LIKE 'NATION!_1%' ESCAPE '!')",
    "infra:NATION_2": "repo_id IN (SELECT repo_id FROM tech WHERE category = 'HOUSEHOLD' AND name = 'NATION_2')",
    "tech:tion_1 -lang:lang-0": "repo_id IN (SELECT repo_id FROM tech WHERE contains(name, 'TION_1')) AND primary_language <> 'lang-0'",
    'tech:"=small ring" is:archived': "archived AND repo_id IN (SELECT repo_id FROM deps WHERE lower(name) = 'small ring' AND scope <> 'transitive')",
    "type:type-2 type:type-3": "repo_id % 4 IN (2, 3)",
    "grade:a": "practices_score >= 70",
    "cap:nation_4 cap:nation_5": "repo_id IN (SELECT repo_id FROM tech WHERE name IN ('NATION_4', 'NATION_5'))",
    "topic:building -topic:=automobile": "repo_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "owner:team-1 owner:furni": "repo_id % 6 = 1 OR repo_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')",
    "-owner:nation_2": "NOT contains(owner, 'NATION_2')",
    "lifecycle:asia": "lifecycle = 'ASIA'",
    "ai:yes": "repo_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8)",
    "-ai:yes": "repo_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8)",
    "ai:no uses:building uses:1-urgent": "repo_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8) AND repo_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "missing:nation_1*": "repo_id IN (SELECT repo_id FROM tech JOIN customer ON c_custkey = repo_id WHERE name LIKE 'NATION!_1%' ESCAPE '!' AND c_acctbal < 3000)",
    "has:nation_6": "repo_id IN (SELECT repo_id FROM tech JOIN customer ON c_custkey = repo_id WHERE name = 'NATION_6' AND c_acctbal >= 3000)",
    "is:archived is:fork": "archived OR repo_id % 3 = 0",
    "is:private -is:monorepo": "repo_id % 2 = 0 AND repo_id % 7 <> 0",
    "minscore:55": "practices_score >= 55",
    "minscore:many": "true",
    "flag:error sev:low": "repo_id IN (SELECT repo_id FROM flags WHERE flag_id = 'error') AND repo_id IN (SELECT repo_id FROM flags WHERE severity = 'low')",
    "-sev:none -flag:login*": "repo_id NOT IN (SELECT repo_id FROM flags WHERE flag_id LIKE 'login%')",
    "reuse:brand#12": "repo_id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#12')",
    "usedby:no": "repo_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')",
    'dep:"small ring" dep:"red widget" grade:A': "practices_score >= 70 AND repo_id IN (SELECT repo_id FROM deps WHERE lower(name) IN ('small ring', 'red widget') AND scope <> 'transitive')",
    "depeco:economy*": "repo_id IN (SELECT repo_id FROM deps WHERE lower(ecosystem) LIKE 'economy%')",
    "vuln:yes": "repo_id IN (SELECT repo_id FROM deps WHERE resolved = '7.50.0')",
    "america nation_1": "contains(lower(concat_ws(' ', name, owner, lifecycle)), 'america') AND contains(lower(concat_ws(' ', name, owner, lifecycle)), 'nation_1')",
}
#: The same of assets, which are parts here.
ASSETS = {
    "kind:promo*": "lower(p_type) LIKE 'promo%'",
    "eco:brand#13": "p_brand = 'Brand#13'",
    "repo:brand#21 repo:o/brand#22": "p_brand IN ('Brand#21', 'Brand#22')",
    "tool:n model:f": "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_discount >= 0.09) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F' AND l_discount >= 0.09)",
    "tag:3 tag:cat-4": "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3 AND l_discount >= 0.09) OR p_size % 5 = 4",
    "-tag:3": "p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3 AND l_discount >= 0.09)",
    "conf:high -scope:plugin": "p_size < 25 AND p_size % 3 <> 0",
    "dup:yes": "p_size % 4 > 0",
    "minq:40.5": "p_size >= 40.5",
    "flag:a": "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.09)",
    "sev:o": "p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_discount >= 0.09)",
}
#: The same of building blocks, which are parts of repositories.
BLOCKS = {
    "kind:=standard": "lower(p_type) = 'standard'",
    "kind:stand*": "lower(p_type) LIKE 'stand%'",
    "repo:supplier#00000001*": "lower(s_name) LIKE 'supplier#00000001%'",
    "lang:lang-2": "repo_id % 5 = 2",
    "format:openapi": "p_size % 3 = 0",
    "format:copier format:composite": "p_size % 3 <> 0",
    "grade:f lifecycle:europe": "practices_score < 70 AND lifecycle = 'EUROPE'",
}


def _repo_items(spark, d) -> DataFrame:
    n = F.col("repo_id")
    return fx.repos(spark, d).withColumns({
        "primary_language": F.concat(F.lit("lang-"), (n % 5).cast("string")), "repo_type": F.concat(F.lit("type-"), (n % 4).cast("string")),
        "practices_grade": F.when(F.col("practices_score") >= 70, "A").otherwise("F"), "declared_owner": F.concat(F.lit("team-"), (n % 6).cast("string")),
        "fork": n % 3 == 0, "is_monorepo": n % 7 == 0, "visibility": F.when(n % 2 == 0, "private").otherwise("public"),
    })


def _repo_tables(spark, d) -> dict[str, DataFrame]:
    c, o = fx.table(spark, d, "customer").withColumnRenamed("c_custkey", "repo_id"), fx.table(spark, d, "orders").withColumnRenamed("o_custkey", "repo_id")
    tech, deps = fx.tech(spark, d), fx.deps(spark, d)
    kinds = F.when(F.col("category") == "BUILDING", "frameworks").when(F.col("category") == "MACHINERY", "messaging").when(F.col("category") == "HOUSEHOLD", "cloud").otherwise("other")
    return {
        "repo_tech": tech.withColumn("category", kinds), "repo_capabilities": tech, "dependencies": deps, "flags": fx.flags(spark, d),
        "repo_languages": c.withColumnRenamed("c_mktsegment", "language"), "repo_topics": c.withColumnRenamed("c_mktsegment", "topic"), "code_owners": c.withColumnRenamed("c_mktsegment", "owner"),
        "ai_assets": c.filter("c_nationkey < 8").withColumnRenamed("c_mktsegment", "ecosystem"), "sdk_usage": c.withColumnRenamed("c_name", "sdk"), "model_usage": o.withColumnRenamed("o_orderpriority", "model"),
        "practice_checks": tech.join(c, "repo_id").select("repo_id", F.col("name").alias("check"), (F.col("c_acctbal") >= 3000).alias("passed")),
        "reusables": fx.table(spark, d, "part").select(F.col("p_partkey").alias("repo_id"), F.col("p_brand").alias("kind")),
        "repo_links": o.filter(F.startswith("o_orderpriority", F.lit("1"))).withColumnRenamed("repo_id", "depends_on"),
        "vulnerable_dependencies": deps.filter("resolved = '7.50.0'"),
    }


def _asked(items: DataFrame, asked: dict[str, str], keys: dict, tables: dict[str, DataFrame], item: str, text: tuple[str, ...] = ()) -> DataFrame:
    rows = [filter_keys.restrict(items, q, keys, tables, item, text).select(F.lit(q).alias("asked"), F.col(item).alias("id")) for q in asked]
    return reduce(DataFrame.union, rows)


def _sql(ctes: str, table: str, item: str, asked: dict[str, str]) -> str:
    return ctes + " UNION ALL ".join(f"SELECT '{q}' AS asked, {item} AS id FROM {table} WHERE {test}" for q, test in asked.items())


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_ITEMS = "items AS (SELECT *, 'lang-' || (repo_id % 5) AS primary_language FROM repos)"


@query(_sql(with_(fx.REPOS, fx.TECH, fx.DEPS, fx.FLAGS, _ITEMS), "items", "repo_id", REPOS))
def filter_repo_keys(spark, d):
    return _asked(_repo_items(spark, d), REPOS, filter_keys.REPO_KEYS, _repo_tables(spark, d), "repo_id", ("name", "owner", "lifecycle"))


@query(_sql("", "part", "p_partkey", ASSETS))
def filter_asset_keys(spark, d):
    part = fx.table(spark, d, "part")
    items = part.select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_brand").alias("ecosystem"), F.concat(F.lit("o/"), "p_brand").alias("repo"), F.concat(F.lit("cat-"), (F.col("p_size") % 5).cast("string")).alias("category"),
        F.when(F.col("p_size") < 25, "high").otherwise("low").alias("confidence"), F.when(F.col("p_size") % 3 == 0, "plugin").otherwise("repo").alias("scope"), (F.col("p_size") % 4).alias("duplicate_count"), F.col("p_size").alias("quality_score"),
    )
    li = fx.table(spark, d, "lineitem").filter("l_discount >= 0.09").withColumnRenamed("l_partkey", "id")
    tables = {
        "asset_tools": li.select("id", F.col("l_returnflag").alias("tool")), "asset_models": li.select("id", F.col("l_linestatus").alias("model")), "asset_tags": li.select("id", F.col("l_linenumber").cast("string").alias("tag")),
        "asset_flags": li.select("id", F.col("l_returnflag").alias("flag_id"), F.col("l_linestatus").alias("severity")),
    }
    return _asked(items, ASSETS, filter_keys.ASSET_KEYS, tables, "id")


@query(_sql(with_(fx.REPOS, "blocks AS (SELECT p.*, r.repo_id, r.name AS s_name, r.practices_score, r.lifecycle FROM part p JOIN repos r ON r.repo_id = p.p_partkey % 100)"), "blocks", "p_partkey", BLOCKS))
def filter_block_keys(spark, d):
    repos = _repo_items(spark, d).select("repo_id", F.col("id").alias("repo"), "primary_language", "practices_grade", "lifecycle")
    kinds = F.array(F.lit("openapi 3.1"), F.lit(None), F.lit(None)), F.array(F.lit(None), F.lit("copier"), F.lit(None)), F.array(F.lit("x"), F.lit("x"), F.lit("composite"))
    n = (F.col("p_size") % 3).cast("int")
    part = fx.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("repo_id"), F.col("p_type").alias("kind"), F.get(kinds[0], n).alias("format"), F.get(kinds[1], n).alias("engine"), F.get(kinds[2], n).alias("using"))
    return _asked(part.join(repos, "repo_id"), BLOCKS, filter_keys.BLOCK_KEYS, {}, "id")
