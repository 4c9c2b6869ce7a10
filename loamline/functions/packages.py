"""Package addresses, advisories and model names as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package URL types by ecosystem.
PURL_TYPES = {"npm": "npm", "pypi": "pypi", "go": "golang", "cargo": "cargo", "maven": "maven", "gradle": "maven", "sbt": "maven", "gem": "gem", "composer": "composer", "nuget": "nuget", "pub": "pub", "hex": "hex", "cocoapods": "cocoapods", "swift": "swift", "conda": "conda", "cran": "cran", "docker": "docker", "github-actions": "github"}
#: Weights of CVSS v3 metrics.
CVSS = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27}, "PR_changed": {"N": 0.85, "L": 0.68, "H": 0.5}}


def _map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _escaped(part: Column) -> Column:
    """Percent-encoding with slashes kept and blanks as %20."""
    return F.replace(F.replace(F.url_encode(part), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """pkg:type/name@version; null for ecosystems without a type."""
    kind = F.element_at(_map(PURL_TYPES), ecosystem)
    folded = F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).when(ecosystem.isin("maven", "gradle", "sbt"), F.replace(name, F.lit(":"), F.lit("/"))).otherwise(name)
    return F.when(kind.isNotNull(), F.concat(F.lit("pkg:"), kind, F.lit("/"), _escaped(folded), F.when(version.isNotNull() & (version != ""), F.concat(F.lit("@"), _escaped(version))).otherwise(F.lit(""))))


def purl_parts(address: Column) -> Column:
    """struct(type, name, version) of a package URL."""
    body = F.regexp_replace(address, r"[?#].*$", "")
    take = lambda i: F.url_decode(F.regexp_extract(body, r"^pkg:([^/]+)/(.+?)(?:@([^@/]+))?$", i))
    return F.struct(take(1).alias("type"), take(2).alias("name"), F.nullif(take(3), F.lit("")).alias("version"))


def cvss3(vector: Column) -> Column:
    """The base score of a CVSS v3 vector, or null."""
    metric = lambda m: F.regexp_extract(vector, rf"(?:^|/){m}:([A-Z])", 1)
    weight = lambda table, m: F.element_at(_map(CVSS[table]), metric(m))
    changed = metric("S") == "C"
    iss = 1 - reduce(lambda a, b: a * b, [1 - weight("C", m) for m in ("C", "I", "A")])
    impact = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15.0))).otherwise(6.42 * iss)
    ease = 8.22 * weight("AV", "AV") * weight("AC", "AC") * F.when(changed, weight("PR_changed", "PR")).otherwise(weight("PR", "PR")) * weight("UI", "UI")
    raw = F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease)
    total = F.when(raw > 10, F.lit(10.0)).otherwise(raw)  # least() would turn an unreadable vector into 10
    return F.when(impact <= 0, F.lit(0.0)).when(total.isNotNull(), F.ceil(F.round(total * 10, 4)) / 10)


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score.isNotNull(), "low")


def model_key(spelling: Column) -> Column:
    """A model name as tables hold it: lower case, without a provider's prefix, region and snapshot date, dots as hyphens."""
    out = F.regexp_replace(F.lower(F.trim(spelling)), r"^(?:[a-z0-9-]+/)+", "")
    out = F.regexp_replace(out, r"^(?:us|eu|apac)\.", "")
    out = F.regexp_replace(out, r"^[a-z]+\.(?=[a-z])", "")
    out = F.regexp_replace(out, r"(?:-v\d+)?(?::\d+)?$", "")
    out = F.regexp_replace(out, r"[-@](?:20\d{6}|20\d\d-\d\d-\d\d|latest)$", "")
    return F.replace(out, F.lit("."), F.lit("-"))


def image_parts(image: Column) -> Column:
    """struct(name, tag, digest) of a container image; a port of the registry is no tag."""
    digest = F.nullif(F.regexp_extract(image, r"@(sha256:[0-9a-f]+)$", 1), F.lit(""))
    plain = F.regexp_replace(image, r"@.*$", "")
    tag = F.nullif(F.regexp_extract(plain, r":([^:/]+)$", 1), F.lit(""))
    return F.struct(F.regexp_replace(plain, r":[^:/]+$", "").alias("name"), tag.alias("tag"), digest.alias("digest"))
