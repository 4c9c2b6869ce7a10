"""Technologies of a repository from its dependencies and files, by rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values: (ecosystem or *, name or prefix*, category, label). A small table of our own; callers may give a larger one.
RULES = (
    ("npm", "react", "frameworks", "React"), ("npm", "vue", "frameworks", "Vue"), ("npm", "next", "frameworks", "Next.js"), ("npm", "express", "frameworks", "Express"), ("npm", "@nestjs/*", "frameworks", "NestJS"), ("npm", "@angular/*", "frameworks", "Angular"),
    ("npm", "typescript", "languages", "TypeScript"), ("npm", "jest", "testing", "Jest"), ("npm", "vitest", "testing", "Vitest"), ("npm", "eslint*", "quality", "ESLint"), ("npm", "webpack*", "build", "webpack"),
    ("pypi", "django", "frameworks", "Django"), ("pypi", "flask", "frameworks", "Flask"), ("pypi", "fastapi", "frameworks", "FastAPI"), ("pypi", "pytest*", "testing", "pytest"), ("pypi", "sqlalchemy", "data", "SQLAlchemy"), ("pypi", "pyspark", "data", "Apache Spark"), ("pypi", "torch", "ml", "PyTorch"),
    ("maven", "org.springframework.boot:*", "frameworks", "Spring Boot"), ("maven", "org.apache.spark:*", "data", "Apache Spark"), ("maven", "junit:junit", "testing", "JUnit"), ("maven", "org.junit*", "testing", "JUnit"),
    ("go", "github.com/gin-gonic/gin", "frameworks", "Gin"), ("go", "google.golang.org/grpc", "interfaces", "gRPC"), ("cargo", "tokio", "frameworks", "Tokio"), ("gem", "rails", "frameworks", "Rails"), ("docker", "postgres", "data", "PostgreSQL"), ("docker", "redis", "data", "Redis"), ("*", "openai", "ai", "OpenAI"), ("*", "anthropic*", "ai", "Anthropic"),
)


def by_dependency(deps: DataFrame, rules=RULES) -> DataFrame:
    """repo_id, category, label: exact and prefix rules over names in lower case with hyphens for underscores.

    Prefixes are matched by equality on the name's beginning, once for each length that the rules have, so that both
    kinds of rule are one equi-join; dependencies are reduced to distinct names first.
    """
    spark = deps.sparkSession
    lengths = sorted({len(n) - 1 for _, n, _, _ in rules if n.endswith("*")})
    name = F.translate(F.lower("name"), "_", "-")
    each = deps.select("repo_id", "ecosystem", name.alias("name")).distinct()
    starts = F.filter(F.array(*[F.when(F.length("name") >= n, F.concat(F.substring("name", 1, n), F.lit("*"))) for n in lengths]), lambda x: x.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = each.withColumn("pattern", F.explode(F.concat(F.array("name"), starts))).withColumn("eco", F.explode(F.array("ecosystem", F.lit("*"))))
    table = spark.createDataFrame(list(rules), "eco string, pattern string, category string, label string")
    return keys.join(table, ["eco", "pattern"]).select("repo_id", "category", "label").distinct()


def by_file(files: DataFrame, rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """repo_id, category, label by path pattern: one scan, each rule a regular expression."""
    from ..functions.globs import matches

    rules = rules or {"**/Dockerfile": ("infrastructure", "Docker"), "**/*.tf": ("infrastructure", "Terraform"), "**/Chart.yaml": ("infrastructure", "Helm"), ".github/workflows/*.{yml,yaml}": ("ci", "GitHub Actions"), "**/*.proto": ("interfaces", "Protocol Buffers"), "**/*.ipynb": ("data", "Jupyter")}
    hits = F.array(*[F.when(matches(F.col("path"), p), F.struct(F.lit(c).alias("category"), F.lit(label).alias("label"))) for p, (c, label) in rules.items()])
    return files.select("repo_id", F.explode(hits).alias("h")).filter("h is not null").select("repo_id", "h.category", "h.label").distinct()


def language_of(files: DataFrame) -> DataFrame:
    """repo_id, language, files, lines, percent and whether it is the primary one."""
    from pyspark.sql import Window as W

    from ..functions.text import content_type, line_count
    from .usage import language_stats

    rows = files.select("repo_id", content_type(F.col("path")).alias("language"), line_count(F.coalesce("text", F.lit(""))).alias("lines")).filter("language is not null")
    first = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("lines"), "language")) == 1
    return language_stats(rows).withColumn("is_primary", first)


def repo_type(files: DataFrame) -> DataFrame:
    """repo_id, repo_type by ordered signs in the paths."""
    sign = lambda p: F.bool_or(F.rlike("path", F.lit(p)))
    per = files.groupBy("repo_id").agg(
        sign(r"^(lerna\.json|pnpm-workspace\.yaml|nx\.json|turbo\.json)$").alias("workspace"), sign(r"(^|/)(Chart\.yaml|kustomization\.ya?ml)$|\.tf$").alias("infra"), sign(r"(^|/)(Dockerfile|Procfile)$").alias("service"), sign(r"^action\.ya?ml$").alias("action"),
        sign(r"^(package\.json|pyproject\.toml|setup\.(py|cfg)|Cargo\.toml|pom\.xml|go\.mod|[^/]+\.gemspec)$").alias("package"), F.bool_and(F.rlike("path", F.lit(r"(?i)\.(md|rst|adoc|txt|png|svg|jpg)$|^(license|\.git.*)$"))).alias("docs"),
    )
    kind = F.when(F.col("workspace"), "monorepo").when(F.col("action"), "action").when(F.col("docs"), "documentation").when(F.col("service"), "service").when(F.col("package"), "library").when(F.col("infra"), "infrastructure").otherwise("other")
    return per.select("repo_id", kind.alias("repo_type"))
