"""The registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facets, links, search, usage
from ..sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_MAJOR = """CASE WHEN regexp_extract({v}, '([0-9]+)', 1) = '0' THEN '0.' || coalesce(nullif(regexp_extract({v}, '[0-9]+[.]([0-9]+)', 1), ''), '0')
  ELSE nullif(regexp_extract({v}, '([0-9]+)', 1), '') END"""

# ---------------------------------------------------------------- usage


@query(with_(fx.TECH) + "SELECT category, name, count(DISTINCT repo_id) AS repo_count FROM tech GROUP BY category, name")
def tech_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.technology_usage(fx.tech(spark, d))


@query(with_(fx.FLAGS) + """SELECT flag_id, severity, count(*) AS n, count(DISTINCT repo_id) AS repos,
  CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END AS INTEGER) AS severity_rank FROM flags GROUP BY flag_id, severity""")
def flag_summary(spark, d):
    return usage.flag_summary(fx.flags(spark, d))


@query(with_(fx.DEPS) + """SELECT ecosystem, name, count(DISTINCT repo_id) AS repo_count, array_to_string(list_sort(list_distinct(list(version))), ',') AS versions,
  min(CASE WHEN ecosystem = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') ELSE lower(name) END) AS norm_name FROM deps GROUP BY ecosystem, name""")
def dependency_usage_agg(spark, d):
    return usage.dependency_usage(fx.deps(spark, d))


@query(with_(fx.DEPS) + """SELECT ecosystem, name, count(DISTINCT repo_id) AS repo_count, count(DISTINCT coalesce(resolved, version)) AS version_count,
  array_to_string(list_sort(list_distinct(list(coalesce(resolved, version)))), ',') AS versions
  FROM deps WHERE scope <> 'transitive' AND coalesce(resolved, version) IS NOT NULL GROUP BY ecosystem, name HAVING count(DISTINCT repo_id) > 1""")
def dependency_versions(spark, d):
    return usage.dependency_versions(fx.deps(spark, d))


@query(with_(fx.DEPS) + "SELECT repo_id, ecosystem, name, resolved, scope, manifest FROM deps WHERE resolved IN ('1.1.0', '2.13.0', '7.50.0')")
def vulnerable_dependencies(spark, d):
    known = spark.createDataFrame([("1.1.0",), ("2.13.0",), ("7.50.0",)], "resolved string")
    return fx.deps(spark, d).join(F.broadcast(known), "resolved", "left_semi").select("repo_id", "ecosystem", "name", "resolved", "scope", "manifest")


@query(with_(fx.REPOS, fx.DEPS, f"""each AS (SELECT DISTINCT d.ecosystem, d.name, d.repo_id, {_MAJOR.format(v="coalesce(d.resolved, d.version)")} AS major
  FROM deps d JOIN repos r ON r.repo_id = d.repo_id WHERE NOT r.archived AND d.scope <> 'transitive'),
 per AS (SELECT ecosystem, name, major, count(*) AS n FROM each WHERE major IS NOT NULL GROUP BY ALL),
 total AS (SELECT ecosystem, name, count(DISTINCT repo_id) AS repo_count FROM each WHERE major IS NOT NULL GROUP BY ALL),
 spread AS (SELECT ecosystem, name, count(*) AS major_count, array_to_string(list_sort(list(major || ':' || CAST(n AS VARCHAR))), ',') AS majors FROM per GROUP BY ecosystem, name)""")
  + """SELECT s.ecosystem, s.name, major_count, majors, repo_count FROM spread s JOIN total t ON t.ecosystem = s.ecosystem AND t.name = s.name
  WHERE major_count > 1 AND repo_count > 1 ORDER BY repo_count DESC, major_count DESC, s.ecosystem, s.name LIMIT 15""")
def version_drift(spark, d):
    return usage.version_drift(fx.deps(spark, d), fx.repos(spark, d))


@query(with_(fx.REPOS, fx.DEPS) + """SELECT r.id, d.ecosystem, d.name, d.version, d.resolved, d.scope, d.manifest, r.lifecycle, r.archived FROM deps d JOIN repos r ON r.repo_id = d.repo_id
  WHERE lower(d.name) = (SELECT min(lower(name)) FROM deps) AND d.scope <> 'transitive' ORDER BY r.archived, r.id, d.scope, d.name, d.manifest, d.version LIMIT 200""")
def dependency_lookup(spark, d):
    name = fx.deps(spark, d).agg(F.min(F.lower("name")).alias("n")).first().n
    return usage.dependency_lookup(fx.deps(spark, d), fx.repos(spark, d), name, include_transitive=False)


@query(with_(fx.REPOS, fx.DEPS, fx.TECH, """hits AS (
  SELECT repo_id, category, name AS matched FROM tech WHERE lower(name) = 'nation_3'
  UNION SELECT repo_id, CASE WHEN scope = 'transitive' THEN 'transitive dependency' ELSE 'dependency' END, name || ' ' || coalesce(resolved, version) FROM deps WHERE lower(name) = 'nation_3')""")
  + "SELECT r.id, category, matched FROM hits h JOIN repos r ON r.repo_id = h.repo_id ORDER BY 1, 2, 3 LIMIT 500")
def repos_using(spark, d):
    return usage.repos_using(fx.tech(spark, d), fx.deps(spark, d), fx.repos(spark, d), "Nation_3")


@query(with_(fx.DEPS) + """SELECT repo_id, count(*) FILTER (WHERE scope <> 'transitive') AS direct, count(*) FILTER (WHERE scope = 'transitive') AS transitive, count(DISTINCT ecosystem) AS ecosystems,
  round_even(count(*) FILTER (WHERE scope <> 'transitive' AND resolved IS NOT NULL) / count(*) FILTER (WHERE scope <> 'transitive')::DOUBLE, 3) AS lockfile_coverage FROM deps GROUP BY repo_id""")
def dependency_summary(spark, d):
    return usage.dependency_summary(fx.deps(spark, d))


_CHECKS = """checks AS (SELECT d.source AS repo_id, l.quality = 1 AS passed, 1 + l.toxic AS weight FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query(with_(_CHECKS, """per AS (SELECT repo_id, CAST(round_even(100.0::DOUBLE * sum(CASE WHEN passed THEN weight ELSE 0 END) / sum(weight), 0) AS INTEGER) AS score FROM checks GROUP BY repo_id)""")
  + "SELECT repo_id, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM per")
def practice_score_grade(spark, d):
    joined = fx.table(spark, d, "documents").select("doc_id", "source").join(fx.table(spark, d, "labels"), "doc_id")
    return usage.practice_score(joined.select(F.col("source").alias("repo_id"), (F.col("quality") == 1).alias("passed"), (F.lit(1) + F.col("toxic")).alias("weight")))


@query("""WITH per AS (SELECT source AS repo_id, lang AS language, count(*) AS files, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents GROUP BY ALL)
SELECT repo_id, language, files, lines, round_even(100.0::DOUBLE * lines / sum(lines) OVER (PARTITION BY repo_id), 1) AS percent FROM per""")
def language_stats(spark, d):
    docs = fx.table(spark, d, "documents")
    return usage.language_stats(docs.select(F.col("source").alias("repo_id"), F.col("lang").alias("language"), T.line_count(F.col("text")).alias("lines")))


@query(with_(fx.HISTORY, """per AS (SELECT repo_id, author, count(*) AS commits, min(at_) AS first_commit, max(at_) AS last_commit FROM history GROUP BY ALL),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY commits DESC, author) AS INTEGER) AS place FROM per)""") + "SELECT * FROM ranked WHERE place <= 10")
def contributors_top10(spark, d):
    return usage.contributors(fx.history(spark, d))


@query("""WITH per AS (SELECT event_type AS repo_id, user_id AS author, count(*) AS commits FROM events GROUP BY ALL),
  t AS (SELECT repo_id, CAST(sum(commits) AS BIGINT) AS total, max(commits) AS top FROM per GROUP BY repo_id)
SELECT repo_id, total, top, CAST(floor(100.0 * top / total) AS BIGINT) AS percent, total >= 30 AND top >= 0.9 * total AS flagged FROM t""")
def bus_factor(spark, d):
    return usage.bus_factor(fx.table(spark, d, "events").select(F.col("event_type").alias("repo_id"), F.col("user_id").alias("author")))


@query(with_(fx.HISTORY, """ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id, path ORDER BY at_ DESC, commit_id DESC) AS place FROM history)""")
  + """SELECT repo_id, path, count(*) AS changes, min(at_) AS added, max(at_) AS modified, max(CASE WHEN place = 1 THEN author END) AS modified_by FROM ranked GROUP BY repo_id, path""")
def file_history(spark, d):
    return usage.file_history(fx.history(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'archived' WHEN o_orderpriority LIKE '5%' THEN 'deprecated'
  WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 365 THEN 'stale' WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 90 THEN 'maintained' ELSE 'active' END AS lifecycle FROM orders""")
def lifecycle(spark, d):
    state = usage.lifecycle(F.lit("1998-08-02").cast("date"), F.col("o_orderdate").cast("date"), F.col("o_orderstatus") == "P", F.startswith("o_orderpriority", F.lit("5")))
    return fx.table(spark, d, "orders").select("o_orderkey", state.alias("lifecycle"))


@query("""WITH eol AS (SELECT * FROM (VALUES ('1-URGENT', DATE '1995-01-01'), ('2-HIGH', DATE '1997-12-01'), ('3-MEDIUM', DATE '1998-12-01'), ('4-NOT SPECIFIED', DATE '2001-01-01')) t(runtime, ends)),
  dated AS (SELECT o_orderkey, runtime, date_diff('day', ends, CAST(o_orderdate AS DATE)) AS days FROM orders JOIN eol ON runtime = o_orderpriority)
SELECT o_orderkey, runtime, CASE WHEN days > 365 THEN 'high' WHEN days > 0 THEN 'medium' ELSE 'low' END AS severity FROM dated WHERE days >= -180""")
def eol_severity(spark, d):
    ends = spark.createDataFrame([("1-URGENT", "1995-01-01"), ("2-HIGH", "1997-12-01"), ("3-MEDIUM", "1998-12-01"), ("4-NOT SPECIFIED", "2001-01-01")], "runtime string, ends string")
    orders = fx.table(spark, d, "orders").join(F.broadcast(ends), F.col("o_orderpriority") == F.col("runtime"))
    severity = usage.eol_severity(F.col("o_orderdate").cast("date"), F.col("ends").cast("date"))
    return orders.select("o_orderkey", "runtime", severity.alias("severity")).filter("severity is not null")


# ---------------------------------------------------------------- links

_OWNERS = """owners AS (SELECT ecosystem, norm, CASE WHEN live = 1 THEN live_one WHEN live = 0 AND n = 1 THEN any_one END AS dst FROM (
  SELECT ecosystem, norm, count(*) FILTER (WHERE NOT archived) AS live, count(*) AS n, max(CASE WHEN NOT archived THEN repo_id END) AS live_one, max(repo_id) AS any_one
  FROM (SELECT DISTINCT p.repo_id, p.ecosystem, lower(p.name) AS norm, r.archived FROM packages p JOIN repos r ON r.repo_id = p.repo_id) x GROUP BY ecosystem, norm) y)"""
_LINKS = """used AS (SELECT repo_id AS src, ecosystem, lower(name) AS norm, min(CASE scope WHEN 'runtime' THEN 0 WHEN 'dev' THEN 2 ELSE 4 END) AS scope_rank FROM package_deps GROUP BY ALL),
  linked AS (SELECT u.src, o.dst, u.ecosystem || ' ' || u.norm AS via, u.scope_rank FROM used u JOIN owners o ON o.ecosystem = u.ecosystem AND o.norm = u.norm
    WHERE o.dst IS NOT NULL AND u.src <> o.dst AND NOT EXISTS (SELECT 1 FROM packages p WHERE p.repo_id = u.src AND p.ecosystem = u.ecosystem AND lower(p.name) = u.norm)),
  merged AS (SELECT src, dst, via, CAST(min(scope_rank) AS INTEGER) AS scope_rank FROM linked GROUP BY src, dst, via),
  links AS (SELECT src, dst, via, scope_rank FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY scope_rank, via) AS place FROM merged) x WHERE place <= 5)"""
_LINKED = with_(fx.REPOS, fx.PACKAGES, fx.PACKAGE_DEPS, _OWNERS, _LINKS)


def _links(spark, d):
    return links.routes(fx.package_deps(spark, d), fx.packages(spark, d), fx.repos(spark, d))


@query(with_(fx.REPOS, fx.PACKAGES, _OWNERS) + "SELECT ecosystem, norm, dst FROM owners WHERE dst IS NOT NULL")
def link_publishers(spark, d):
    return links.owners(fx.packages(spark, d), fx.repos(spark, d))


@query(_LINKED + "SELECT src, dst, via, scope_rank FROM links")
def link_routes_top5(spark, d):
    return _links(spark, d)


@query(_LINKED.rstrip() + """, ranked AS (SELECT l.*, CAST(row_number() OVER (PARTITION BY l.dst ORDER BY l.scope_rank, r.archived, lower(r.id), l.via) AS INTEGER) AS place, count(*) OVER (PARTITION BY l.dst) AS total
  FROM links l JOIN repos r ON r.repo_id = l.src) SELECT dst, src, via, scope_rank, place, total FROM ranked WHERE place <= 200""")
def link_cap_200(spark, d):
    return links.most_relevant(_links(spark, d), fx.repos(spark, d), "dst", "src").select("dst", "src", "via", "scope_rank", "place", "total")


@query(_LINKED + "SELECT dst, count(*) AS links, count(DISTINCT src) AS used_by FROM links GROUP BY dst")
def used_by_totals(spark, d):
    return links.used_by_totals(_links(spark, d))


@query(with_(fx.REPOS, """refs AS (SELECT o.o_custkey % 100 AS src, o.o_orderpriority AS kind, CASE WHEN o.o_orderstatus = 'P' THEN 'no/such' ELSE lower(r.id) END AS target
  FROM orders o JOIN repos r ON r.repo_id = o.o_orderkey % 100)""") + """SELECT DISTINCT src, repo_id AS dst, kind || ' ' || target AS via, 0 AS scope_rank FROM refs JOIN repos ON lower(id) = target WHERE src <> repo_id""")
def link_references(spark, d):
    r, o = fx.repos(spark, d), fx.table(spark, d, "orders")
    target = F.when(F.col("o_orderstatus") == "P", "no/such").otherwise(F.upper("id"))
    refs = o.join(r.select(F.col("repo_id").alias("named"), "id"), F.col("o_orderkey") % 100 == F.col("named")).select((F.col("o_custkey") % 100).alias("repo_id"), F.col("o_orderpriority").alias("kind"), target.alias("target"))
    return links.by_reference(refs, r)


@query(_LINKED + """SELECT 'depends_on' AS direction, dst AS other, via, scope_rank FROM links WHERE src = 7 UNION ALL SELECT 'used_by', src, via, scope_rank FROM links WHERE dst = 7""")
def repo_relationships(spark, d):
    return links.relationships(_links(spark, d), 7)


_PATHS = "paths AS (SELECT DISTINCT regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"


@query(with_(_PATHS, """parts AS (SELECT path, string_split(path, '/') AS p FROM paths), each AS (SELECT path, unnest(range(1, len(p) + 1)) AS n, p FROM parts),
  prefixes AS (SELECT path, array_to_string(list_slice(p, 1, CAST(n AS BIGINT)), '/') AS module FROM each),
  modules AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*/[^/?#]*)', 1) AS module FROM pages WHERE page_id % 3 = 0 UNION SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) FROM pages WHERE page_id % 2 = 0),
  hits AS (SELECT p.path, p.module, row_number() OVER (PARTITION BY p.path ORDER BY length(p.module) DESC) AS place FROM prefixes p JOIN modules m ON m.module = p.module)""")
  + "SELECT path, module FROM hits WHERE place = 1")
def go_prefix_join(spark, d):
    pages = fx.table(spark, d, "pages")
    long = pages.filter("page_id % 3 = 0").select(F.regexp_extract("url", "://([^/?#]*/[^/?#]*)", 1).alias("module"))
    short = pages.filter("page_id % 2 = 0").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("module"))
    return links.longest_prefix(pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path")), long.union(short))


@query(with_(fx.ASSETS, """fit AS (SELECT id, content_sha FROM assets WHERE len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) >= 10),
  sized AS (SELECT id, content_sha, count(*) OVER (PARTITION BY content_sha) AS n, row_number() OVER (PARTITION BY content_sha ORDER BY id) AS place FROM fit),
  heads AS (SELECT content_sha, list_sort(list(id)) AS ids FROM sized WHERE place <= 21 AND n > 1 GROUP BY content_sha)""")
  + "SELECT s.id, s.n - 1 AS duplicate_count, array_to_string(list_slice(list_filter(h.ids, lambda x: x <> s.id), 1, 20), ',') AS duplicates FROM sized s JOIN heads h ON h.content_sha = s.content_sha WHERE s.n > 1")
def mark_duplicates(spark, d):
    return links.duplicates(fx.assets(spark, d))


@query("""WITH a AS (SELECT 'A' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey - CASE WHEN o_custkey % 4 = 1 THEN 1 ELSE 0 END END AS class FROM orders)
  SELECT id, CASE WHEN class IS NULL THEN id ELSE min(id) OVER (PARTITION BY class) END AS group_id FROM a""")
def advisory_groups(spark, d):
    """Orders as advisories: those of a customer share an alias, those of some pairs of customers a second one, some have none."""
    customer = F.col("o_custkey")
    alias = lambda c: F.concat(F.lit("C"), c.cast("string"))
    aliases = F.when(F.col("o_orderkey") % 7 == 0, None).when(customer % 4 == 0, F.array(alias(customer), alias(customer + 1))).otherwise(F.array(alias(customer)))
    return links.alias_groups(fx.table(spark, d, "orders").select(F.concat(F.lit("A"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"), aliases.alias("aliases")))


# ---------------------------------------------------------------- search

_TOKENS = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def _bm25_sql(words: list[str], mode: str) -> str:
    freq = ", ".join(f"8.0 * len(list_filter(a, lambda x: starts_with(x, '{w}'))) + 1.0 * len(list_filter(b, lambda x: starts_with(x, '{w}'))) AS f{i}" for i, w in enumerate(words))
    dfs = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(words)))
    parts = " - ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * length / avg_length))" for i in range(len(words)))
    hit = f" {mode} ".join(f"f{i} > 0" for i in range(len(words)))
    return f"""WITH t AS (SELECT doc_id AS id, {_TOKENS.format(c="source")} AS a, {_TOKENS.format(c="text")} AS b FROM documents),
  c AS (SELECT id, len(a) + len(b) AS length, {freq} FROM t), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(length) AS avg_length, {dfs} FROM c)
SELECT id, round(0.0 - {parts}, 6) AS rank FROM c, s WHERE {hit} ORDER BY rank, id LIMIT 100"""


def _searchable(spark, d):
    return fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("content"))


def _ranked(spark, d, text):
    return search.search(_searchable(spark, d), text, search.ASSET_WEIGHTS, ["name", "content"], [F.col("name")], 100).select("id", "rank")


@query(_bm25_sql(["the", "anly", "thin"], "AND"))
def search_assets_bm25(spark, d):
    return _ranked(spark, d, "the anly thin")


@query(_bm25_sql(["anly", "zzzz"], "OR"))
def search_or_fallback(spark, d):
    return _ranked(spark, d, "anly zzzz")


@query("SELECT doc_id AS id, CAST(NULL AS DOUBLE) AS rank FROM documents WHERE contains(lower(source), 'n = \"') OR contains(lower(text), 'n = \"') ORDER BY source, doc_id LIMIT 100")
def search_like_fallback(spark, d):
    return _ranked(spark, d, 'n = "')


@query(f"""WITH v AS (SELECT token, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest({_TOKENS.format(c="text")}) AS token FROM documents) x GROUP BY token)
SELECT 'thinand' AS term, token, docs, CAST(levenshtein('thinand', token) AS INTEGER) AS distance FROM v WHERE levenshtein('thinand', token) <= 1
UNION ALL SELECT 'leheand', token, docs, CAST(levenshtein('leheand', token) AS INTEGER) FROM v WHERE levenshtein('leheand', token) <= 1""")
def search_fuzzy(spark, d):
    return search.fuzzy_terms(_searchable(spark, d), "content", "thinand leheand")


@query(with_(fx.REPOS) + """SELECT p.p_name AS name, p.p_type AS kind, p.p_brand AS description, r.id AS repo, r.practices_score, r.archived FROM part p JOIN repos r ON r.repo_id = p.p_partkey % (SELECT count(*) FROM supplier)
  WHERE contains(lower(concat_ws(' ', p.p_name, p.p_brand, r.id)), 'brand') AND contains(lower(concat_ws(' ', p.p_name, p.p_brand, r.id)), 'a') ORDER BY r.archived, r.practices_score DESC, p.p_type, p.p_name, r.id LIMIT 20""")
def building_blocks(spark, d):
    n = fx.table(spark, d, "supplier").count()
    part = fx.table(spark, d, "part").withColumn("repo_id", F.col("p_partkey") % n)
    rows = part.join(fx.repos(spark, d), "repo_id").select(F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("description"), F.col("id").alias("repo"), "practices_score", "archived")
    return search.building_blocks(rows, "Brand a")


@query(with_(fx.REPOS, fx.DEPS) + """SELECT id, name, owner, practices_score FROM repos WHERE NOT archived AND repo_id IN (SELECT repo_id FROM deps WHERE contains(lower(ecosystem), 'economy') AND scope <> 'transitive')
  ORDER BY practices_score DESC, id LIMIT 50""")
def search_repos_filtered(spark, d):
    using = fx.deps(spark, d).filter(F.contains(F.lower("ecosystem"), F.lit("economy")) & (F.col("scope") != "transitive"))
    hits = fx.repos(spark, d).filter("not archived").join(using, "repo_id", "left_semi")
    return hits.orderBy(F.desc("practices_score"), "id").limit(50).select("id", "name", "owner", "practices_score")


@query(with_(fx.FLAGS) + """SELECT event_id, repo_id, flag_id, severity FROM flags WHERE severity IN ('high', 'medium') ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, repo_id, flag_id, event_id LIMIT 1000""")
def list_flags(spark, d):
    hits = fx.flags(spark, d).filter(F.col("severity").isin("high", "medium"))
    return hits.orderBy(usage.rank_of("severity", usage.SEVERITY_RANK, 3), "repo_id", "flag_id", "event_id").limit(1000).select("event_id", "repo_id", "flag_id", "severity")


# ---------------------------------------------------------------- filters and facets


def _parts(spark, d):
    p = fx.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("brand"), F.split("p_type", " ").alias("type"), "p_size")


def _filtered(spark, d, text):
    request = facets.read(text, {"brand", "type", "minsize"})
    test = facets.predicate(request.filters, {"brand": F.col("brand"), "type": F.col("type")}, {"minsize": F.col("p_size")})
    return _parts(spark, d).filter(test).select("id")


@query("WITH each AS (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS value FROM part) SELECT value, count(*) AS n FROM each WHERE value <> '' GROUP BY value")
def facet_counts(spark, d):
    return facets.facet_counts(_parts(spark, d), "type")


@query("SELECT p_partkey AS id FROM part WHERE (list_contains(string_split(lower(p_brand), '|'), 'brand#12') OR lower(p_brand) LIKE '%brand#2%') AND NOT contains(lower(p_type), 'promo')")
def query_language_and_or_not(spark, d):
    return _filtered(spark, d, 'brand:"=Brand#12" brand:brand#2 -type:promo')


@query("SELECT p_partkey AS id FROM part WHERE lower(p_brand) = 'brand#13' OR starts_with(lower(p_brand), 'brand#3')")
def query_language_prefix_exact(spark, d):
    return _filtered(spark, d, "brand:=brand#13 BRAND:brand#3*")


@query("SELECT p_partkey AS id FROM part WHERE p_size >= 40")
def query_language_min(spark, d):
    return _filtered(spark, d, "minsize:40")


@query(with_(fx.REPOS) + """SELECT count(*) AS repos, count(*) FILTER (WHERE NOT archived) AS live, CAST(round(avg(practices_score), 0) AS BIGINT) AS mean_score,
  CAST(round(100.0 * count(*) FILTER (WHERE practices_score >= 70) / count(*), 0) AS BIGINT) AS good_percent FROM repos""")
def insights_kpis(spark, d):
    return facets.insights(fx.repos(spark, d))


# ---------------------------------------------------------------- text


@query("""SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines,
  CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents""")
def text_stats(spark, d):
    t = F.col("text")
    return fx.table(spark, d, "documents").select("doc_id", T.words(t).alias("words"), T.line_count(t).alias("lines"), T.token_estimate(t).alias("tokens"))


@query("""WITH p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM documents)
SELECT doc_id, CASE WHEN length(plain) <= 280 THEN plain ELSE regexp_replace(substr(plain, 1, 280), '\\s+\\S*$', '') || '…' END AS excerpt FROM p""")
def excerpt(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT page_id, CAST(len(regexp_extract_all(substr(html, 1, 50000), '</?[a-zA-Z][^>]*>')) AS BIGINT) AS tags, starts_with(lower(substr(trim(html), 1, 200)), '<!doctype html') OR starts_with(lower(substr(trim(html), 1, 200)), '<html') OR len(regexp_extract_all(substr(html, 1, 50000), '</?[a-zA-Z][^>]*>')) >= 8 AS is_html FROM pages")
def looks_like_html(spark, d):
    return fx.table(spark, d, "pages").select("page_id", T.tag_count(F.col("html")).alias("tags"), T.looks_like_html(F.col("html")).alias("is_html"))


@query("""WITH r AS (SELECT doc_id, text, regexp_replace(text, '(?i)\\b(api[_-]?key|secret|token|password|passwd|credential)(\\s*[:=]\\s*["'']?)([A-Za-z0-9_\\-./+]{16,})', '\\1\\2[redacted]', 'g') AS redacted FROM documents)
SELECT doc_id, sha256(redacted) AS sha, redacted <> text AS changed FROM r""")
def redact_secrets(spark, d):
    docs = fx.table(spark, d, "documents").withColumn("redacted", T.redact_secrets(F.col("text")))
    return docs.select("doc_id", F.sha2("redacted", 256).alias("sha"), (F.col("redacted") != F.col("text")).alias("changed"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@', '\\1') AS url FROM pages")
def redact_url(spark, d):
    return fx.table(spark, d, "pages").select("page_id", T.redact_url(F.col("url")).alias("url"))


@query("""WITH f AS (SELECT doc_id, lower(text) AS t FROM documents), n AS (SELECT * FROM (VALUES ('apache license', 'Apache-2.0'), ('mit license', 'MIT'), ('gnu general public license', 'GPL'), ('gnu lesser general public license', 'LGPL'), ('mozilla public license', 'MPL-2.0'), ('bsd', 'BSD'), ('unencumbered software released into the public domain', 'Unlicense')) v(needle, license))
SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ' OR ') AS license FROM f JOIN n ON contains(t, needle) GROUP BY doc_id""")
def license_detect(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", T.detect_license(F.col("text")).alias("license")).filter("license is not null")


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '[\",]') THEN p_brand ELSE p_brand END AS brand, p_name AS name FROM part")
def csv_export(spark, d):
    return fx.table(spark, d, "part").select("p_partkey", T.csv_cell(F.col("p_brand")).alias("brand"), T.csv_cell(F.col("p_name")).alias("name"))


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN regexp_replace(lower(p_brand || '__x..Y'), '[-_.]+', '-', 'g') ELSE lower(p_brand || '__x..Y') END AS norm FROM part")
def norm_name(spark, d):
    eco = F.when(F.col("p_size") < 25, "pypi").otherwise("npm")
    return fx.table(spark, d, "part").select("p_partkey", usage.norm_name(eco, F.concat("p_brand", F.lit("__x..Y"))).alias("norm"))


# ---------------------------------------------------------------- sets and increments


@query(with_(fx.REPOS) + "SELECT r.id FROM repos r WHERE r.owner IN ('NATION_1', 'NATION_2', 'NATION_3') AND NOT EXISTS (SELECT 1 FROM repos k WHERE k.id = r.id AND k.practices_score >= 30)")
def prune_anti(spark, d):
    repos = fx.repos(spark, d)
    return repos.filter(F.col("owner").isin("NATION_1", "NATION_2", "NATION_3")).join(repos.filter("practices_score >= 30").select("id"), "id", "left_anti").select("id")


@query(with_(fx.REPOS) + "SELECT r.id FROM repos r LEFT JOIN (SELECT id, practices_score - repo_id % 2 AS score, archived FROM repos WHERE repo_id % 5 <> 0) p ON p.id = r.id WHERE p.id IS NULL OR p.score <> r.practices_score OR p.archived <> r.archived")
def incremental_changed(spark, d):
    from ..operators.increments import changed

    now = fx.repos(spark, d).select("id", F.col("practices_score").cast("long").alias("score"), "archived")
    before = fx.repos(spark, d).filter("repo_id % 5 <> 0").select("id", (F.col("practices_score") - F.col("repo_id") % 2).alias("score"), "archived")
    return changed(now, before, "id").select("id")


@query(with_(fx.FLAGS) + "SELECT CAST(repo_id AS VARCHAR) AS repo, flag_id, severity FROM flags UNION ALL SELECT source, 'empty-line', 'low' FROM documents WHERE contains(text, chr(10) || chr(10))")
def union_flags(spark, d):
    docs = fx.table(spark, d, "documents").filter(F.contains("text", F.lit("\n\n")))
    return fx.flags(spark, d).select(F.col("repo_id").cast("string").alias("repo"), "flag_id", "severity").union(docs.select("source", F.lit("empty-line"), F.lit("low")))


@query(with_(fx.DEPS, """ranked AS (SELECT repo_id, ecosystem, name, scope, row_number() OVER (PARTITION BY repo_id, ecosystem, name ORDER BY CASE scope WHEN 'runtime' THEN 0 WHEN 'dev' THEN 2 ELSE 4 END) AS place, count(*) OVER (PARTITION BY repo_id, ecosystem, name) AS n FROM deps)""")
  + "SELECT repo_id, 'pkg:' || lower(ecosystem) || '/' || name AS ref, scope, n FROM ranked WHERE place = 1")
def sbom_components(spark, d):
    from ..operators.exports import sbom_components as components

    return components(fx.deps(spark, d))


@query(with_(fx.DEPS) + "SELECT repo_id, array_to_string(list_slice(list_sort(list_distinct(list(name))), 1, 10), ',') AS shown, count(DISTINCT name) AS total FROM deps GROUP BY repo_id")
def get_repo_truncated(spark, d):
    names = fx.deps(spark, d).select("repo_id", "name").distinct()
    total = names.groupBy("repo_id").agg(F.count("name").alias("total"))
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.asc_nulls_last("name")))
    heads = names.withColumn("place", place).filter(F.col("place") <= 10).groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("shown"))
    return heads.join(total.withColumnRenamed("repo_id", "of"), F.col("repo_id").eqNullSafe(F.col("of"))).select("repo_id", "shown", "total")


@query(with_(fx.REPOS) + "SELECT owner, count(*) AS n FROM repos GROUP BY owner ORDER BY n DESC, owner LIMIT 10")
def guarded_sql(spark, d):
    from ..operators.guarded import read_only_sql

    return read_only_sql(spark, "SELECT owner, count(*) AS n FROM repos GROUP BY owner ORDER BY n DESC, owner;", {"repos": fx.repos(spark, d)}, limit=10)
