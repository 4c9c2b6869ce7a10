"""Registered queries of expressions, whose inputs are spelled out from rows of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, packages, versions
from ..functions import text as T
from ..operators import findings, manifests, technologies
from ..sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# A part is a place where a model is named, in one of six spellings; a nation is a model that ends.


@query("""SELECT p_partkey AS part, 'm-3-' || (p_partkey % 50) AS model, CASE WHEN n_regionkey < 2 THEN 'retired' ELSE 'deprecated' END AS state, CASE WHEN n_regionkey < 2 THEN 'high' ELSE 'medium' END AS severity
FROM part JOIN nation ON n_nationkey = p_partkey % 50""")
def model_lookup(spark, d):
    part = fx.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 50).cast("string").alias("m"), (F.col("p_partkey") % 6).alias("way"))
    ways = [("Acme/M-3.", ""), ("us.acme.m-3-", "-20250101-v1:0"), ("m-3.", "-latest"), ("acme/x/m-3.", "-2025-01-01"), ("m-3-", "@20250101"), (" M-3.", " ")]
    spelling = F.coalesce(*[F.when(F.col("way") == i, F.concat(F.lit(a), "m", F.lit(b))) for i, (a, b) in enumerate(ways)])
    spelt = part.select(F.col("p_partkey").alias("part"), packages.model_key(spelling).alias("model"))
    state = F.when(F.col("n_regionkey") < 2, "retired").otherwise("deprecated")
    known = fx.table(spark, d, "nation").select(F.concat(F.lit("m-3-"), F.col("n_nationkey").cast("string")).alias("model"), state.alias("state"))
    return spelt.join(known, "model").select("part", "model", "state", F.when(F.col("state") == "retired", "high").otherwise("medium").alias("severity"))


#: Metrics of a CVSS v3 vector by the digits of a part's key, and how many keys a digit lasts.
_METRICS = (("AV", "NALP", 1), ("AC", "LH", 4), ("PR", "NLH", 8), ("UI", "NR", 24), ("S", "UC", 48), ("C", "HLN", 96), ("I", "HLN", 288), ("A", "HLN", 864))


def _weights(metric: str, letters: str, by: int, values: tuple) -> str:
    return f"CASE (p_partkey // {by}) % {len(letters)} " + " ".join(f"WHEN {i} THEN {v}e0" for i, v in enumerate(values)) + f" END AS {metric}"


@query(f"""WITH w AS (SELECT p_partkey, {_weights('av', 'NALP', 1, (0.85, 0.62, 0.55, 0.2))}, {_weights('ac', 'LH', 4, (0.77, 0.44))}, {_weights('pr', 'NLH', 8, (0.85, 0.62, 0.27))},
    {_weights('pc', 'NLH', 8, (0.85, 0.68, 0.5))}, {_weights('ui', 'NR', 24, (0.85, 0.62))}, (p_partkey // 48) % 2 = 1 AS s, {_weights('c', 'HLN', 96, (0.56, 0.22, 0.0))}, {_weights('i', 'HLN', 288, (0.56, 0.22, 0.0))}, {_weights('a', 'HLN', 864, (0.56, 0.22, 0.0))} FROM part),
  p AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS iss FROM w),
  q AS (SELECT p_partkey, CASE WHEN s THEN 7.52e0 * (iss - 0.029e0) - 3.25e0 * pow(iss - 0.02e0, 15) ELSE 6.42e0 * iss END AS impact, 8.22e0 * av * ac * CASE WHEN s THEN pc ELSE pr END * ui AS ease, s FROM p),
  r AS (SELECT p_partkey AS part, CASE WHEN impact <= 0 THEN 0.0e0 ELSE ceil(round(least(CASE WHEN s THEN 1.08e0 * (impact + ease) ELSE impact + ease END, 10) * 10, 4)) / 10 END AS score FROM q)
SELECT part, score, CASE WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' ELSE 'low' END AS severity FROM r""")
def cvss3(spark, d):
    key = F.col("p_partkey")
    letter = lambda letters, by: F.substring(F.lit(letters), (F.floor(key / by) % len(letters) + 1).cast("int"), F.lit(1))
    vector = F.concat_ws("/", F.lit("CVSS:3.1"), *[F.concat(F.lit(f"{m}:"), letter(letters, by)) for m, letters, by in _METRICS])
    df = fx.table(spark, d, "part").select(key.alias("part"), packages.cvss3(vector).alias("score"))
    return df.withColumn("severity", packages.cvss_severity(F.col("score")))


# A line item is a version that is tested against one of seven ranges.
_SPECS = (("^2.10", "npm", "a = 2 AND b >= 10"), ("~3.5", "npm", "a = 3 AND b = 5"), (">=1.20,<4.12", "pypi", "(a > 1 OR b >= 20) AND (a < 4 OR (a = 4 AND b < 12))"), ("~> 2.30", "gem", "a = 2 AND b >= 30"), ("!=3.7.*", "pypi", "NOT (a = 3 AND b = 7)"), ("1.x || >=5.40", "npm", "a = 1 OR a > 5 OR (a = 5 AND b >= 40)"), ("workspace:*", "npm", "NULL"))


@query(f"""WITH v AS (SELECT DISTINCT l_linenumber AS a, CAST(l_quantity AS INT) AS b, l_suppkey % 3 AS c, l_suppkey % {len(_SPECS)} AS k FROM lineitem)
SELECT a || '.' || b || '.' || c AS version, CASE k {" ".join(f"WHEN {i} THEN '{s}'" for i, (s, _, _) in enumerate(_SPECS))} END AS spec, CAST(CASE k {" ".join(f"WHEN {i} THEN ({t})" for i, (_, _, t) in enumerate(_SPECS))} END AS BOOLEAN) AS ok FROM v""")
def version_satisfies(spark, d):
    k = F.col("l_suppkey") % len(_SPECS)
    of = lambda at: F.coalesce(*[F.when(k == i, r[at]) for i, r in enumerate(_SPECS)])
    version = F.concat_ws(".", F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 3).cast("string"))
    df = fx.table(spark, d, "lineitem").select(version.alias("version"), of(0).alias("spec"), of(1).alias("ecosystem")).distinct()
    return df.select("version", "spec", versions.satisfies(F.col("version"), F.col("spec"), F.col("ecosystem")).alias("ok"))


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS repo_id, CAST(l_linenumber AS INTEGER) AS major, CAST(l_quantity AS INTEGER) AS minor FROM lineitem)
SELECT repo_id, arg_max(CAST(major AS VARCHAR) || '.' || CAST(minor AS VARCHAR), major * 1000 + minor) AS best FROM v WHERE major BETWEEN 2 AND 3 OR (major = 4 AND minor < 12) GROUP BY repo_id""")
def version_best_match(spark, d):
    found = fx.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("repo_id"), F.concat_ws(".", F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int")).alias("version")).distinct()
    per = found.groupBy("repo_id").agg(F.collect_list("version").alias("versions"))  # at most 7 x 50 of a repository
    best = versions.best_match(F.col("versions"), F.lit(">=2.0 <4.12"), F.lit("npm"))
    return per.select("repo_id", best.alias("best")).filter("best is not null")


@query("SELECT page_id, regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS path FROM pages WHERE regexp_matches(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '(?i)^(en|de)/[^/]*[.]html$|^fr/.*$')")
def glob_match(spark, d):
    pages = fx.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1).alias("path"))
    return pages.filter(globs.any_of(F.col("path"), ["{en,de}/*.html", "fr/**"]))


@query("""WITH d AS (SELECT DISTINCT l_suppkey AS repo_id, p_name AS name, p_type AS ecosystem FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT DISTINCT repo_id, category, label FROM (SELECT repo_id, name, ecosystem, unnest(['a', 'b', 'c']) AS r FROM d) x JOIN (VALUES ('a', 'colour', 'Red'), ('b', 'size', 'Small'), ('c', 'part', 'Ring')) t(rule, category, label) ON t.rule = x.r
WHERE (r = 'a' AND starts_with(lower(name), 'red')) OR (r = 'b' AND starts_with(lower(name), 'small ') AND ecosystem = 'ECONOMY') OR (r = 'c' AND lower(name) = 'small ring')""")
def rule_match(spark, d):
    rules = (("*", "red*", "colour", "Red"), ("ECONOMY", "small *", "size", "Small"), ("*", "small ring", "part", "Ring"))
    return technologies.by_dependency(fx.deps(spark, d), rules)


# A page's path is the folder of a manifest; every folder whose name's length is divisible by three has a lockfile.
_PATH = r"://([^?#]*/)[^/?#]*"


@query(f"""WITH m AS (SELECT DISTINCT regexp_extract(url, '{_PATH}', 1) AS folder FROM pages WHERE regexp_extract(url, '{_PATH}', 1) <> ''),
  parts AS (SELECT string_split(folder, '/') AS p FROM m), every AS (SELECT p, unnest(generate_series(1, len(p) - 1)) AS n FROM parts),
  l AS (SELECT DISTINCT array_to_string(p[1:n], '/') || '/' AS at_folder FROM every)
SELECT folder, (SELECT max_by(length(at_folder) || '.0', length(at_folder)) FROM l WHERE length(at_folder) % 3 = 0 AND starts_with(folder, at_folder)) AS resolved FROM m""")
def nearest_lockfile(spark, d):
    folders = fx.table(spark, d, "pages").select(F.regexp_extract("url", _PATH, 1).alias("folder")).filter("folder <> ''").distinct()
    parts = F.split("folder", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    locks = folders.select(F.explode(ups).alias("folder")).distinct().filter(F.length("folder") % 3 == 0)
    rows = lambda df, version, file, is_lock: df.select(F.lit(1).alias("repo_id"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), version.cast("string").alias("version"), F.lit("runtime").alias("scope"), F.concat("folder", F.lit(file)).alias("manifest"), F.lit(is_lock).alias("is_lock"))
    deps = rows(folders, F.lit(None), "package.json", False).union(rows(locks, F.concat(F.length("folder").cast("string"), F.lit(".0")), "package-lock.json", True))
    return manifests.resolve(deps).select(F.regexp_replace("manifest", "package.json$", "").alias("folder"), "resolved")


_DOC = "# One\ntext\n## Two words\n#### deep\n### Three\n"


@query(f"""SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text || chr(10) || '{_DOC}', '(?m)^#{{1,3}}[ \\t]+(.+)$', 1), 1, 25), '|') AS headings FROM documents""")
def headings(spark, d):
    doc = F.concat(F.col("text"), F.lit("\n" + _DOC))
    return fx.table(spark, d, "documents").select("doc_id", F.array_join(T.headings(doc), "|").alias("headings"))


@query("""SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN 'pkg:npm/%40a/' || replace(p_name, ' ', '%20') || '@' || p_size || '.0' WHEN 1 THEN 'pkg:pypi/' || lower(replace(replace(p_name, ' ', '-'), '_', '-')) || '@' || p_size || '.0' WHEN 2 THEN 'pkg:maven/g.h/' || replace(p_name, ' ', '%20') END AS purl FROM part""")
def purl_build(spark, d):
    way, name = F.col("p_partkey") % 4, F.col("p_name")
    ecosystem = F.when(way == 0, "npm").when(way == 1, "pypi").when(way == 2, "maven").otherwise("none")
    named = F.when(way == 0, F.concat(F.lit("@a/"), name)).when(way == 1, F.replace(F.upper(name), F.lit(" "), F.lit("_."))).otherwise(F.concat(F.lit("g.h:"), name))
    version = F.when(way < 2, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("part"), packages.purl(ecosystem, named, version).alias("purl"))


def _files(spark, d, most: int = 500):
    """Manifests made of the driver's rows: a repository's parts as requirements files, its line items as lockfiles, each in
    folders by the hash of the name, so that a file holds about `most` entries however large the repository is."""
    deps = fx.deps(spark, d).select("repo_id", F.replace("name", F.lit(" "), F.lit("-")).alias("name"), "version")

    def made(file, entry, by):
        entries = deps.select("repo_id", "name", entry.alias("entry")).distinct()
        parts = entries.groupBy("repo_id").agg(F.ceil(F.count("*") / most).alias("parts"))
        folder = F.pmod(F.xxhash64("name"), F.col("parts"))
        sizes = parts.select(F.col("repo_id").alias("of"), F.xxhash64("repo_id").alias("key"), "parts")  # one more key, so that a skewed join can be split
        dealt = entries.join(sizes, F.col("repo_id").eqNullSafe(F.col("of")) & (F.xxhash64("repo_id") == F.col("key")))
        # the path as an aggregate: as a key, the rules of names would be tried on every entry and not once for each file
        named = F.min(F.concat(folder.cast("string"), F.lit(f"/{file}")))
        return dealt.groupBy("repo_id", folder.alias("folder")).agg(named.alias("path"), F.array_join(F.sort_array(F.collect_list("entry")), by).alias("text")).drop("folder")

    req = made("requirements.txt", F.concat("name", F.lit(">=1")), "\n")
    return req.union(made("uv.lock", F.concat(F.lit('[[package]]\nname = "'), "name", F.lit('"\nversion = "'), "version", F.lit('"\n')), ""))


@query("""SELECT l_suppkey AS repo_id, 'requirements.txt' AS manifest, count(DISTINCT p_name) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
UNION ALL SELECT l_suppkey, 'uv.lock', count(DISTINCT p_name || '@' || CAST(l_linenumber AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INT) AS VARCHAR)) FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def manifest_dependencies(spark, d):
    rows = manifests.dependencies(_files(spark, d)).withColumn("manifest", F.regexp_replace("manifest", "^.*/", ""))
    return rows.groupBy("repo_id", "manifest").agg(F.count("*").alias("n"))


@query("""SELECT source AS repo_id, count(*) AS n FROM documents WHERE regexp_matches(text, '(?i)\\b(?:api_?key|secret|token|password)\\s*[:=]\\s*["''][A-Za-z0-9_/+\\-]{20,}["'']') GROUP BY source""")
def find_secrets(spark, d):
    docs = fx.table(spark, d, "documents")
    files = docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")
    return findings.secrets(files, most=None).groupBy("repo_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT source AS repo_id, max(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) = 1 AS readme, max(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) = 1 AS license FROM documents GROUP BY source)
SELECT repo_id, 'readme' AS "check", CAST(3 AS INTEGER) AS weight, readme AS passed FROM r UNION ALL SELECT repo_id, 'license', 2, license FROM r""")
def practice_checks(spark, d):
    path = F.when(F.col("lang") == "en", "README.md").when(F.col("lang") == "de", "LICENSE").otherwise("x.py")
    files = fx.table(spark, d, "documents").select(F.col("source").alias("repo_id"), path.alias("path"))
    return findings.practice_checks(files).filter("check in ('readme', 'license')")
