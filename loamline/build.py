"""The build: files and metadata of repositories in, tables out, as Parquet clustered by what they are looked up by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.packages import purl
from .functions.versions import exact_version
from .operators import code_assets, documents, findings, links, manifests, technologies, usage
from .sources.sinks import write_table


def dependency_table(files: DataFrame) -> DataFrame:
    """Declared dependencies with resolved version and address, and locked packages that nothing declares as transitive ones."""
    every = manifests.dependencies(files)
    pinned = F.coalesce("resolved", exact_version(F.col("ecosystem"), F.col("version")))
    direct = manifests.resolve(every).withColumn("resolved", pinned)
    locked = every.filter("is_lock").select("repo_id", "ecosystem", "name", F.col("version").alias("resolved"), "manifest").distinct()
    norm = usage.norm_name(F.col("ecosystem"), F.col("name"))
    named = direct.select("repo_id", "ecosystem", norm.alias("norm_name")).distinct()
    rest = locked.withColumn("norm_name", norm).join(named, ["repo_id", "ecosystem", "norm_name"], "left_anti")
    rest = rest.select("repo_id", "ecosystem", "name", F.lit(None).cast("string").alias("version"), F.lit("transitive").alias("scope"), "manifest", "resolved")
    out = direct.select("repo_id", "ecosystem", "name", "version", "scope", "manifest", "resolved").union(rest)
    return out.withColumns({"norm_name": norm, "purl": purl(F.col("ecosystem"), F.col("name"), F.col("resolved"))})


def package_table(files: DataFrame) -> DataFrame:
    """Packages that repositories publish: names in package.json, pyproject.toml, Cargo.toml and go.mod; private ones are none."""
    rows = manifests.routed(files)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    toml = rows.filter(name.isin("pyproject.toml", "Cargo.toml")).withColumn("doc", manifests.toml_json(F.col("text")))
    of_toml = toml.select("repo_id", "ecosystem", F.coalesce(*[F.get_json_object("doc", p) for p in ("$.project.name", "$.tool.poetry.name", "$.package.name")]).alias("name"), "path")
    of_json = rows.filter((name == "package.json") & ~F.coalesce(F.get_json_object("text", "$.private") == "true", F.lit(False))).select("repo_id", "ecosystem", F.get_json_object("text", "$.name").alias("name"), "path")
    of_go = rows.filter(name == "go.mod").select("repo_id", "ecosystem", F.nullif(F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1), F.lit("")).alias("name"), "path")
    return of_toml.union(of_json).union(of_go).filter("name is not null")


def tables(files: DataFrame, repos: DataFrame) -> dict[str, DataFrame]:
    """All tables. files: repo_id, path, text; repos: repo_id, id, name, owner, archived, pushed_at, description."""
    deps = dependency_table(files)
    packages = package_table(files)
    checks = findings.practice_checks(files)
    live = repos.select("repo_id", "id", "archived")
    edges = links.routes(deps, packages, live)
    scores = usage.practice_score(checks).withColumnRenamed("score", "practices_score").withColumnRenamed("grade", "practices_grade")
    assets = findings.assets(files)
    tech = technologies.by_dependency(deps).union(technologies.by_file(files)).distinct().withColumnRenamed("label", "name")
    readme = documents.readmes(files).select("repo_id", F.col("summary").alias("readme"))
    kinds = technologies.repo_type(files)
    languages = technologies.language_of(files)
    primary = languages.filter("is_primary").select("repo_id", F.col("language").alias("primary_language"))
    ai = assets.groupBy("repo_id").agg(F.count("*").alias("ai_asset_count"))
    full = repos
    for more in (scores, readme, kinds, primary, ai):
        full = full.join(more, "repo_id", "left")
    return {
        "repos": full.withColumn("ai_asset_count", F.coalesce("ai_asset_count", F.lit(0))),
        "repo_tech": tech, "repo_languages": languages, "dependencies": deps, "packages": packages, "practice_checks": checks, "ai_assets": assets,
        "flags": findings.findings(files), "reusables": findings.building_blocks(files), "cross_references": findings.cross_references(files),
        "repo_links": edges.withColumnRenamed("dst", "depends_on").withColumnRenamed("src", "repo_id"), "runtime_versions": documents.runtimes(files), "sdk_usage": code_assets.sdk_usage(files),
        "code_owners": documents.code_owners(files).select("repo_id", F.explode("owners").alias("owner")), "model_usage": code_assets.model_ids(files),
        "dependency_usage": usage.dependency_usage(deps), "dependency_versions": usage.dependency_versions(deps),
    }


def build(files: DataFrame, repos: DataFrame, path: str) -> None:
    """Write every table under path. `files` is read once for each table: give a stored table, not a listing of folders."""
    for name, df in tables(files, repos).items():
        write_table(df, path, name)
