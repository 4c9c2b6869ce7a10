"""What repositories say of themselves: README, owners, descriptors, runtime pins. files: repo_id, path, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Version files, tool names, images and workflow inputs, by the runtime that they pin; file names of descriptors.
VERSION_FILES = {".nvmrc": "node", ".node-version": "node", ".python-version": "python", ".ruby-version": "ruby", ".go-version": "go", ".java-version": "java"}
TOOLS = {"nodejs": "node", "node": "node", "python": "python", "ruby": "ruby", "golang": "go", "go": "go", "java": "java", "php": "php", "dotnet": "dotnet", "dotnet-core": "dotnet"}
DESCRIPTORS = ("catalog-info.yaml", "catalog-info.yml", ".backstage/catalog-info.yaml", ".backstage/catalog-info.yml")
INPUTS = {x: x for x in ("dotnet", "go", "java", "node", "php", "python", "ruby")}
IMAGES = {"python": "python", "node": "node", "ruby": "ruby", "golang": "go", "php": "php", "openjdk": "java", "eclipse-temurin": "java", "amazoncorretto": "java"}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def _blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_markdown(text: Column) -> Column:
    """Prose of a line of markdown: images dropped, links by their text, emphasis and tags removed."""
    out = F.regexp_replace(text, r"\[?!\[[^\]]*\]\([^)]*\)(?:\]\([^)]*\))?", "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"</?[a-zA-Z][^>]*>", "")
    out = F.regexp_replace(out, r"(\*\*|__|`)", "")
    return F.trim(F.regexp_replace(out, r"[ \t]+", " "))


def readmes(files: DataFrame, most: int = 700) -> DataFrame:
    """repo_id, title, summary, features, words of the README at the root.

    The title is the first heading; the summary the first paragraphs of prose behind it, cut at a word; features the items
    of the first list. Fenced code, comments, badges and tables are no prose. Of several READMEs markdown comes first.
    """
    rows = files.filter(F.rlike("path", F.lit(r"(?i)^readme(\.(md|rst|txt|adoc))?$")))
    first = W.partitionBy("repo_id").orderBy(~F.rlike("path", F.lit(r"(?i)\.md$")), "path")
    rows = rows.withColumn("place", F.row_number().over(first)).filter("place = 1")
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)```.*?```|<!--.*?-->", "\n")
    rows = rows.select("repo_id", F.explode(F.array(body)).alias("body"))
    atx = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*#*$", 1)
    setext = F.regexp_extract("body", r"(?m)^(\S.*)\n={3,}\s*$", 1)
    html = F.regexp_extract("body", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.coalesce(*[_blank_to_null(clean_markdown(t)) for t in (atx, setext, html)])
    paragraphs = F.transform(F.split("body", r"\n\s*\n"), lambda p: clean_markdown(F.regexp_replace(p, r"\n", " ")))
    prose = F.filter(paragraphs, lambda p: (F.length(p) >= 20) & ~F.rlike(p, F.lit(r"^(#|[-*+] |\d+[.)] |>|\||=+$|\[!)")) & ~F.rlike(p, F.lit(r"={3,}$")))
    summary = F.array_join(F.slice(prose, 1, 3), " ")
    cut = F.when(F.length(summary) <= most, summary).otherwise(F.concat(F.regexp_replace(F.substring(summary, 1, most), r"\s+\S*$", ""), F.lit("…")))
    block = F.regexp_extract("body", r"(?m)((?:^[-*+]\s+.+\n?)+)", 1)
    features = F.filter(F.transform(F.split(block, r"\n"), lambda s: clean_markdown(F.regexp_replace(s, r"^[-*+]\s+", ""))), lambda s: s != "")
    words = F.size(F.filter(F.split("body", r"\s+"), lambda w: w != "")).cast("long")
    return rows.select("repo_id", title.alias("title"), _blank_to_null(cut).alias("summary"), F.slice(features, 1, 10).alias("features"), words.alias("words"))


def code_owners(files: DataFrame, most: int = 200) -> DataFrame:
    """repo_id, owners: distinct owners in order, from the first of the three places that has a file."""
    places = {".github/CODEOWNERS": 0, "CODEOWNERS": 1, "docs/CODEOWNERS": 2}
    rows = files.filter(F.col("path").isin(*places) & (F.length("text") > 0))
    best = rows.groupBy("repo_id").agg(F.min_by("text", F.element_at(_map({k: str(v) for k, v in places.items()}), F.col("path"))).alias("text"))
    lines = F.transform(F.split("text", r"\r?\n"), lambda s: F.split(F.trim(F.regexp_replace(s, "#.*$", "")), r"\s+"))
    owners = F.filter(F.flatten(F.transform(lines, lambda w: F.slice(w, 2, 10_000))), lambda o: F.contains(o, F.lit("@")))
    return best.select("repo_id", F.slice(F.array_distinct(owners), 1, most).alias("owners"))


def declared(files: DataFrame) -> DataFrame:
    """repo_id, name, owner, system, lifecycle, depends_on of component descriptors, component documents first."""
    rows = files.filter(F.col("path").isin(*DESCRIPTORS))
    docs = rows.select("repo_id", F.posexplode(F.split("text", r"(?m)^---\s*$")).alias("place", "doc"))
    field = lambda k: _blank_to_null(F.regexp_extract("doc", rf"(?m)^\s*{k}:[ \t]*[\"']?([^\n\"'#]+)", 1))
    named = docs.select("repo_id", "place", field("kind").alias("kind"), field("name").alias("name"), field("owner").alias("owner"), field("system").alias("system"), field("lifecycle").alias("lifecycle"), F.regexp_extract_all(F.regexp_extract("doc", r"(?m)^\s*dependsOn:\s*\n((?:\s*-\s*.+\n?)+)", 1), F.lit(r"-\s*[\"']?([^\s\"']+)"), F.lit(1)).alias("depends_on"))
    order = F.struct(F.when(F.col("kind") == "Component", 0).when(F.col("kind").isNull(), 1).when(F.col("kind") == "Resource", 2).when(F.col("kind") == "System", 3).otherwise(4), F.col("place"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return named.groupBy("repo_id").agg(*[first(c) for c in ("name", "owner", "system", "lifecycle")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("depends_on")))).alias("depends_on"))


#: Readers of pins: what a path looks like, a pattern of (name, version), and what the name stands for (None: the file's own name).
_PINS = (
    (r"(^|/)\.tool-versions$", r"(?m)^\s*([a-z-]+)\s+([0-9][\w.+-]*)", TOOLS),
    (r"(^|/)Dockerfile[^/]*$", r"(?im)^\s*FROM\s+(?:--\S+\s+)*(?:docker\.io/(?:library/)?)?([a-z-]+):([0-9][\w.]*)", IMAGES),
    (r"^\.github/workflows/[^/]+\.ya?ml$", r"(?m)\b([a-z]+)-version\s*:\s*[\"']?([0-9][^\s\"'#,\]]*)", INPUTS),
    (r"(^|/)runtime\.txt$", r"(?m)^(python)-([0-9][\w.]*)", {"python": "python"}),
    (r"(^|/)global\.json$", r"\"(sdk)\"\s*:\s*\{[^}]*\"version\"\s*:\s*\"([0-9][^\"]*)", {"sdk": "dotnet"}),
    (r"(^|/)\.[a-z]+(-version|rc)$", r"(?m)^()\s*(?:[a-z]+-)?v?([0-9][\w.+-]*)\s*$", None),
)


def runtimes(files: DataFrame, most: int = 50) -> DataFrame:
    """repo_id, runtime, version, path: pins in version files, tool lists, images, workflow inputs and SDK settings, in order of runtime,
    version and path. A name that stands for no runtime is left out."""
    file = F.regexp_extract("path", r"([^/]+)$", 1)

    def pins(pattern, names):
        named = lambda s: F.try_element_at(_map(names), F.lower(F.regexp_extract(s, pattern, 1))) if names else F.try_element_at(_map(VERSION_FILES), file)
        pin = lambda s: F.struct(named(s).alias("runtime"), F.regexp_extract(s, pattern, 2).alias("version"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), pin)

    found = F.coalesce(*[F.when(F.rlike("path", F.lit(where)), pins(pattern, names)) for where, pattern, names in _PINS])
    each = files.select("repo_id", "path", F.explode(found).alias("pin")).select("repo_id", "pin.runtime", "pin.version", "path")
    each = each.filter("runtime is not null and version <> ''").distinct()
    place = F.row_number().over(W.partitionBy("repo_id").orderBy("runtime", "version", "path"))
    return each.withColumn("place", place).filter(F.col("place") <= most).drop("place")


def release_cycle(runtime: Column, version: Column) -> Column:
    """The part of a version that support tables are kept by."""
    part = lambda n: F.array_join(F.slice(F.split(F.regexp_extract(version, r"([0-9]+(?:\.[0-9]+)*)", 1), r"\."), 1, n), ".")
    return F.when(runtime.isin("node", "java"), part(1)).when((runtime == "dotnet") & (F.regexp_extract(version, r"^([0-9]+)", 1) >= "5"), part(1)).otherwise(part(2))


def end_of_life(pins: DataFrame, table: DataFrame, as_of: Column) -> DataFrame:
    """Findings on pins whose support has ended or will within 180 days. table: runtime, cycle, ends."""
    from .usage import eol_severity

    joined = pins.withColumn("cycle", release_cycle(F.col("runtime"), F.col("version"))).join(table, ["runtime", "cycle"])
    return joined.select("repo_id", F.lit("eol-runtime").alias("flag_id"), eol_severity(as_of, F.col("ends")).alias("severity"), "runtime", "version", "path").filter("severity is not null")
