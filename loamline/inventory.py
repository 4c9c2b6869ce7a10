"""The queries of a built inventory: one method each, all lazy but for the few that must look at what they found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import filter_keys, guarded, search, usage

TABLES = ("repos", "repo_tech", "repo_languages", "dependencies", "packages", "practice_checks", "ai_assets", "flags", "reusables", "cross_references", "repo_links", "runtime_versions", "sdk_usage", "dependency_usage", "dependency_versions", "code_owners", "model_usage")


def _with_columns(df: DataFrame, **kinds: str) -> DataFrame:
    """The table with a null column for each one that it lacks."""
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})


class Inventory:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def resolve_repo(self, name: str) -> list[str]:
        """The id of owner/name, or of a bare name; several ids if the bare name is ambiguous, none if it is unknown."""
        repos = self.table("repos").select("id", "name")
        exact = [r.id for r in repos.filter(F.lower("id") == name.lower()).limit(1).collect()]
        return exact or [r.id for r in repos.filter(F.lower("name") == name.lower()).orderBy("id").limit(100).collect()]

    def search_repos(self, query: str = "", *, language: str | None = None, technology: str | None = None, repo_type: str | None = None, has_ai: bool | None = None, include_archived: bool = True, limit: int = 20) -> DataFrame:
        rows = self.table("repos")
        if language:
            rows = rows.filter(F.lower("primary_language") == language.lower())
        if repo_type:
            rows = rows.filter(F.col("repo_type") == repo_type)
        if has_ai is not None:
            rows = rows.filter((F.col("ai_asset_count") > 0) == has_ai)
        if not include_archived:
            rows = rows.filter(~F.col("archived"))
        if technology:
            holds = lambda t: self.table(t).filter(F.contains(F.lower("name"), F.lit(technology.lower()))).select("repo_id")
            rows = rows.join(holds("repo_tech").union(holds("dependencies")), "repo_id", "left_semi")
        return search.search(rows, query, search.REPO_WEIGHTS, ["name", "description", "readme"], [F.desc("practices_score"), F.desc("pushed_at")], limit)

    def search_assets(self, query: str = "", *, kind: str | None = None, ecosystem: str | None = None, min_quality: int = 0, limit: int = 20) -> DataFrame:
        rows = self.table("ai_assets").filter(F.col("quality_score") >= min_quality)
        for column, value in (("kind", kind), ("ecosystem", ecosystem)):
            rows = rows.filter(F.col(column) == value) if value else rows
        return search.search(rows, query, search.ASSET_WEIGHTS, ["name", "description", "content"], [F.desc("quality_score"), F.col("name")], limit)

    def filter_repos(self, query: str) -> DataFrame:
        """Repositories that a `key:value` query lets through; keys of columns and tables that were not landed find nothing."""
        rows = _with_columns(self.table("repos"), declared_owner="string", lifecycle="string", fork="boolean", is_monorepo="boolean", visibility="string", topics="array<string>", capabilities="array<string>")
        tables = {t: self.table(t) for t in ("repo_tech", "repo_languages", "dependencies", "practice_checks", "ai_assets", "flags", "reusables", "repo_links", "sdk_usage", "code_owners", "model_usage")}
        tables["repo_topics"] = rows.select("repo_id", F.explode("topics").alias("topic"))
        tables["repo_capabilities"] = rows.select("repo_id", F.explode("capabilities").alias("name"))
        tables["vulnerable_dependencies"] = self.table("flags").filter("flag_id = 'vulnerable-dependency'")
        return filter_keys.restrict(rows, query, filter_keys.REPO_KEYS, tables, "repo_id", ("name", "description", "readme"))

    def filter_building_blocks(self, query: str) -> DataFrame:
        repos = _with_columns(self.table("repos"), lifecycle="string").select("repo_id", F.col("id").alias("repo"), "primary_language", "practices_grade", "lifecycle")
        rows = _with_columns(self.table("reusables"), format="string", engine="string", using="string")
        return filter_keys.restrict(rows.join(repos, "repo_id"), query, filter_keys.BLOCK_KEYS, {}, "name", ("name", "repo", "path"))

    def find_building_blocks(self, query: str = "", *, kind: str | None = None, limit: int = 20) -> DataFrame:
        repos = self.table("repos").select("repo_id", F.col("id").alias("repo"), "description", "archived", "practices_score")
        rows = self.table("reusables").join(repos, "repo_id")
        return search.building_blocks(rows.filter(F.col("kind") == kind) if kind else rows, query, limit)

    def list_flags(self, *, severity: str | None = None, category: str | None = None, flag_id: str | None = None, repo: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.table("flags").join(self.table("repos").select("repo_id", F.col("id").alias("repo")), "repo_id")
        for column, value in (("severity", severity), ("category", category), ("flag_id", flag_id)):
            rows = rows.filter(F.col(column) == value) if value else rows
        if repo:
            rows = rows.filter((F.lower("repo") == repo.lower()) | F.endswith(F.lower("repo"), F.lit("/" + repo.lower())))
        return rows.orderBy(usage.rank_of("severity", usage.SEVERITY_RANK, 3), "repo", "flag_id", "path", "line").limit(max(1, min(limit, 1000)))

    def dependency_usage(self, name: str, **options) -> DataFrame:
        repos = self.table("repos").withColumn("lifecycle", F.lit(None).cast("string"))
        return usage.dependency_lookup(self.table("dependencies"), repos, name, **options)

    def technology_usage(self, category: str | None = None, limit: int = 50) -> DataFrame:
        rows = usage.technology_usage(self.table("repo_tech"))
        rows = rows.filter(F.col("category") == category) if category else rows
        return rows.orderBy(F.desc("repo_count"), "category", "name").limit(max(1, min(limit, 500)))

    def repos_using(self, name: str) -> DataFrame:
        return usage.repos_using(self.table("repo_tech"), self.table("dependencies"), self.table("repos"), name)

    def relationships(self, repo: str, limit: int = 100) -> dict:
        """depends_on and used_by of a repository, strongest first, with true totals; or its candidates if the name is ambiguous."""
        ids = self.resolve_repo(repo)
        if len(ids) != 1:
            return {"candidates": ids}
        repos = self.table("repos").select("repo_id", "id")
        key = repos.filter(F.col("id") == ids[0]).first().repo_id
        edges, out = self.table("repo_links"), {"repo": ids[0]}
        for side, own, other in (("depends_on", "repo_id", "depends_on"), ("used_by", "depends_on", "repo_id")):
            mine = edges.filter(F.col(own) == key).select(F.col(other).alias("repo_id"), "via", "scope_rank").join(repos, "repo_id")
            out[side] = [{"repo": r.id, "via": r.via} for r in mine.orderBy("scope_rank", "id", "via").limit(max(1, min(limit, 1000))).collect()]
            out[f"{side}_total"] = mine.count()
        return out

    def get_asset(self, asset_id: str) -> dict | None:
        row = self.table("ai_assets").filter(F.col("id") == asset_id).first()
        return row.asDict(recursive=True) if row else None

    def get_repo(self, repo: str, max_items: int = 100) -> dict:
        """The record with its lists, each cut at max_items with its true length beside it."""
        ids = self.resolve_repo(repo)
        if len(ids) != 1:
            return {"candidates": ids}
        row = self.table("repos").filter(F.col("id") == ids[0]).first()
        out = {**row.asDict(recursive=True), "truncated": {}}
        for name in ("repo_tech", "repo_languages", "dependencies", "packages", "practice_checks", "ai_assets", "flags", "reusables", "runtime_versions"):
            mine = self.table(name).filter(F.col("repo_id") == row.repo_id)
            mine = mine.filter("scope <> 'transitive'") if name == "dependencies" else mine.drop("content") if name == "ai_assets" else mine
            n = mine.count()
            out[name] = [r.asDict(recursive=True) for r in mine.orderBy(*[c for c in mine.columns if c != "headings"]).limit(max_items).collect()]
            if n > max_items:
                out["truncated"][name] = {"shown": max_items, "total": n}
        return out

    def sql(self, statement: str, limit: int = 200, timeout_s: float = 5.0) -> list[dict]:
        df = guarded.read_only_sql(self.spark, statement, {t: self.table(t) for t in TABLES}, limit)
        return guarded.collect_within(df, timeout_s)
