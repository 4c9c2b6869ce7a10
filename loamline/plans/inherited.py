"""Registered queries of inheritance between build files, over units made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inheritance
from ..sources import fixtures as fx

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Every domain of a page's host is a unit below the next shorter one ("com/", "com/example/", ...), and so is every folder of its path.
# A unit defines two of seven names, chosen by its length; values name other names, and some lead back to themselves.


def _units(spark: SparkSession, d: str) -> DataFrame:
    url = fx.table(spark, d, "pages").select(F.explode(F.regexp_extract_all("url", F.lit(r"://([^/?#]*)([^?#]*)"), F.lit(0))).alias("u"))
    host, path = F.regexp_extract("u", r"://([^/?#]*)", 1), F.regexp_extract("u", r"://[^/?#]*/?([^?#]*)", 1)
    parts = F.concat(F.reverse(F.split(host, r"\.")), F.filter(F.split(path, "/"), lambda p: p != ""))
    ends = F.sequence(F.lit(1), F.size(parts))
    return url.select(F.lit(1).alias("repo_id"), F.explode(F.transform(ends, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))).alias("unit")).distinct()


def inherited_properties(spark: SparkSession, d: str) -> DataFrame:
    """Every unit's names with their settled values."""
    units = _units(spark, d)
    size = F.length("unit")
    value = lambda n: F.concat(F.lit("${n"), ((size * 3 + n) % 7).cast("string"), F.lit("}."), size.cast("string"))
    plain = lambda n: F.concat(F.lit("v"), (size + n).cast("string"))
    name = lambda n: F.concat(F.lit("n"), n.cast("string"))
    first = units.select("repo_id", "unit", name(size % 7).alias("name"), F.when(size % 2 == 0, plain(0)).otherwise(value(0)).alias("value"))
    second = units.select("repo_id", "unit", name((size + 3) % 7).alias("name"), F.when(size % 3 == 0, value(5)).otherwise(plain(1)).alias("value"))
    lines = inheritance.lineage(inheritance.nearest_folders(units))
    out = inheritance.settled(inheritance.effective(first.union(second), lines))
    return out.select("unit", "name", "value", "resolved")


QUERIES["inherited_properties"] = inherited_properties
ORACLES["inherited_properties"] = r"""
WITH RECURSIVE urls AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path FROM pages WHERE contains(url, '://')),
parts AS (SELECT list_concat(list_reverse(string_split(host, '.')), list_filter(string_split(path, '/'), lambda p: p <> '')) AS p FROM urls),
ends AS (SELECT p, unnest(generate_series(1, len(p))) AS n FROM parts),
units AS (SELECT DISTINCT array_to_string(p[1:n], '/') || '/' AS unit, length(array_to_string(p[1:n], '/')) + 1 AS size FROM ends),
stated AS (
  SELECT unit, 'n' || (size % 7) AS name, CASE WHEN size % 2 = 0 THEN 'v' || size ELSE '${n' || ((size * 3) % 7) || '}.' || size END AS value FROM units UNION ALL
  SELECT unit, 'n' || ((size + 3) % 7), CASE WHEN size % 3 = 0 THEN '${n' || ((size * 3 + 5) % 7) || '}.' || size ELSE 'v' || (size + 1) END FROM units),
near AS (
  SELECT u.unit, s.name, arg_min(s.value, {'far': -length(a.unit), 'value': s.value}) AS value
  FROM units u JOIN units a ON starts_with(u.unit, a.unit) JOIN stated s ON s.unit = a.unit GROUP BY u.unit, s.name),
walk AS (
  SELECT unit, name, value AS text, [name] AS trail, false AS closed FROM near
  UNION ALL
  SELECT w.unit, w.name, replace(w.text, '${' || n.name || '}', n.value), list_append(w.trail, n.name), list_contains(w.trail, n.name)
  FROM walk w JOIN near n ON n.unit = w.unit AND n.name = regexp_extract(w.text, '\$\{([^${}]+)\}', 1) WHERE NOT w.closed)
SELECT n.unit, n.name, CASE WHEN l.closed THEN n.value ELSE l.text END AS value, NOT l.closed AS resolved
FROM near n JOIN (SELECT unit, name, arg_max(text, len(trail)) AS text, bool_or(closed) AS closed FROM walk GROUP BY unit, name) l ON l.unit = n.unit AND l.name = n.name
"""
