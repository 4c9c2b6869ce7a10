"""Registered queries of package graphs and of paths within folders, over documents and paths made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import containment, package_graph
from ..sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# An order is a repository whose dependency graph holds its line items; lines lead to the next ones and some back.


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li, p = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), (F.col("p_partkey") % 3).cast("string"))
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("repo_id"), F.col("l_linenumber").alias("n"), name.alias("name"), version.alias("version"), "l_quantity", "l_partkey", "l_suppkey", "l_returnflag")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """repo_id, text: one SPDX document for each order."""
    ref = lambda n: F.concat(F.lit("SPDXRef-"), n.cast("string"))
    edge = lambda when, a, b: F.when(when, F.struct(ref(a).alias("spdxElementId"), F.lit("DEPENDS_ON").alias("relationshipType"), ref(b).alias("relatedSpdxElement")))
    n = F.col("n")
    edges = F.array_compact(F.array(edge(n <= 2, F.lit(0), n), edge(F.col("l_quantity") > 20, n, n + 1), edge(F.col("l_partkey") % 2 == 1, n, n + 2), edge(F.col("l_suppkey") % 3 == 0, n + 1, n)))
    address = F.concat(F.lit("pkg:pypi/"), "name", F.lit("@"), "version")
    package = F.struct(ref(n).alias("SPDXID"), "name", F.array(F.struct(F.lit("purl").alias("referenceType"), address.alias("referenceLocator"))).alias("externalRefs"))
    # a document holds the lines of one order
    per = _lines(spark, d).groupBy("repo_id").agg(F.collect_list(package).alias("packages"), F.flatten(F.collect_list(edges)).alias("relationships"))
    root = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), F.lit("SPDXRef-0").alias("relatedSpdxElement"))
    return per.select("repo_id", F.to_json(F.struct(F.struct("packages", F.array_append("relationships", root).alias("relationships")).alias("sbom"))).alias("text"))


@query("""WITH RECURSIVE li AS (
  SELECT l_orderkey AS repo_id, l_linenumber AS n, replace(p_name, ' ', '_') || '.' || (p_partkey % 3) AS name, lower(replace(p_name, ' ', '-')) || '-' || (p_partkey % 3) AS same,
    l_linenumber || '.' || CAST(l_quantity AS INT) AS version, l_quantity, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey),
edge AS (
  SELECT repo_id, 0 AS s, n AS t FROM li WHERE n <= 2 UNION SELECT repo_id, n, n + 1 FROM li WHERE l_quantity > 20 UNION
  SELECT repo_id, n, n + 2 FROM li WHERE l_partkey % 2 = 1 UNION SELECT repo_id, n + 1, n FROM li WHERE l_suppkey % 3 = 0),
reach(repo_id, e, d) AS (SELECT DISTINCT repo_id, 0, 0 FROM li UNION SELECT r.repo_id, t, d + 1 FROM reach r JOIN edge ON edge.repo_id = r.repo_id AND s = e WHERE d < 12),
depth AS (SELECT repo_id, e, min(d) AS d FROM reach GROUP BY repo_id, e),
fresh AS (SELECT li.*, d FROM li LEFT JOIN depth ON depth.repo_id = li.repo_id AND e = n WHERE NOT EXISTS (FROM li k WHERE k.repo_id = li.repo_id AND k.same = li.same AND k.l_returnflag = 'A')),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo_id, same ORDER BY coalesce(d, 1000), name, version) AS place FROM fresh)
SELECT repo_id, 'pypi' AS ecosystem, name, version, CASE WHEN d = 1 THEN 'runtime' ELSE 'transitive' END AS scope, coalesce(d, -1) AS depth FROM placed WHERE place = 1""")
def sbom_merge(spark, d):
    """Packages of each order's graph that its declared ones (lines of flag A) lack, with their depth below the root, -1 where nothing leads to them."""
    declared = _lines(spark, d).filter("l_returnflag = 'A'").select("repo_id", F.lit("pypi").alias("ecosystem"), F.upper("name").alias("name"))
    out = package_graph.merged(package_graph.read_documents(_documents(spark, d)), declared).drop("manifest")
    return out.withColumn("depth", F.coalesce("depth", F.lit(-1)))


# A page is a file; its folders are its host's labels from the last to the first, and those of its path.


def _files(spark: SparkSession, d: str) -> DataFrame:
    url = fx.table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", r"://[^/?#]*/?([^?#]*)", 1).alias("rest"))
    parts = F.filter(F.concat(F.reverse(F.split("host", r"\.")), F.split("rest", "/")), lambda p: p != "")
    return url.select(F.lit(1).alias("repo_id"), "page_id", F.array_join(parts, "/").alias("path"))


_FILES = r"""files AS (SELECT page_id, list_filter(list_concat(list_reverse(string_split(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '.')), string_split(coalesce(regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1), ''), '/')), lambda p: p <> '') AS p FROM pages),
paths AS (SELECT page_id, p, array_to_string(p, '/') AS path FROM files)"""


@query(f"""WITH {_FILES}, roots AS (SELECT DISTINCT root FROM (SELECT array_to_string(p[1:n], '/') AS root FROM (SELECT p, unnest(generate_series(1, len(p))) AS n FROM paths)) WHERE length(root) % 3 = 0)
SELECT page_id, path, (SELECT max_by(root, length(root)) FROM roots WHERE starts_with(path, root || '/')) AS root FROM paths""")
def plugin_roots(spark, d):
    """Each file's deepest root; roots are folders, and files, whose name's length is divisible by three."""
    files = _files(spark, d)
    parts = F.split("path", "/")
    roots = files.filter("path <> ''").select("repo_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    return containment.owning_root(files, roots.filter(F.length("root") % 3 == 0)).select("page_id", "path", "root")


@query(f"""WITH {_FILES}, places AS (SELECT DISTINCT p AS q, path AS place FROM paths WHERE page_id % 7 = 0), asked AS (SELECT DISTINCT p, path FROM paths),
pairs AS (SELECT path, place, len(list_filter(generate_series(1, least(len(p), len(q))), lambda i: p[1:i] = q[1:i])) AS shared FROM asked, places),
placed AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY shared DESC, place) AS n FROM pairs)
SELECT path, place, CAST(shared AS INT) AS shared FROM placed WHERE n = 1""")
def closest_server(spark, d):
    """For each path the one of every seventh page's paths that shares most leading folders with it."""
    files = _files(spark, d)
    return containment.closest(files, files.filter("page_id % 7 = 0").select("repo_id", F.col("path").alias("place"))).drop("repo_id")


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS repo_id, 'Server-' || (l_partkey % 211) AS server, CASE WHEN l_linenumber <= 3 THEN 'pkg-' || (l_partkey % 1450) END AS package, CASE WHEN l_linenumber = 7 THEN 'https://x' END AS url FROM lineitem),
pub AS (SELECT 'pkg-' || (p_partkey % 1450) AS package, min(p_partkey % 97) AS target FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey % 97) = 1),
prov AS (SELECT lower('SERVER-' || (s_suppkey % 150)) AS server, min(s_suppkey) AS target FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) = 1)
SELECT DISTINCT repo_id, server, target FROM (
  SELECT c.repo_id, c.server, target FROM c JOIN pub USING (package) UNION SELECT c.repo_id, c.server, target FROM c JOIN prov ON prov.server = lower(c.server) WHERE package IS NULL AND url IS NULL) WHERE repo_id <> target""")
def server_links(spark, d):
    """Line items as configured servers: some launch a package, some name a URL, some only a name."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    package = F.when(F.col("l_linenumber") <= 3, text("pkg-", F.col("l_partkey") % 1450))
    configs = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo_id"), text("Server-", F.col("l_partkey") % 211).alias("server"), F.lit("npm").alias("ecosystem"), package.alias("package"), F.when(F.col("l_linenumber") == 7, "https://x").alias("url"))
    published = fx.table(spark, d, "part").select((F.col("p_partkey") % 97).alias("repo_id"), F.lit("npm").alias("ecosystem"), text("pkg-", F.col("p_partkey") % 1450).alias("package"))
    provided = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("repo_id"), text("SERVER-", F.col("s_suppkey") % 150).alias("server"))
    return containment.configured_servers(configs, published, provided)
