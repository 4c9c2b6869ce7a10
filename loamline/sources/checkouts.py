"""Sources: files of checked-out repositories, landed API pages, stored records, commit logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that hold other people's code or build output.
SKIPPED = r"(^|/)(\.git|node_modules|bower_components|vendor|third_party|dist|build|target|\.venv|venv|__pycache__|\.tox|\.mypy_cache)/"


def text_of(content: Column, cap: int = 2_000_000) -> Column:
    """Bytes as text: UTF-16 by its mark, null for binary (a zero byte early on), else UTF-8 without its mark."""
    head = F.substring(content, 1, cap)
    hexed = F.hex(F.substring(content, 1, 8192))
    utf16 = F.startswith(hexed, F.lit("FFFE")) | F.startswith(hexed, F.lit("FEFF"))
    binary = F.rlike(hexed, F.lit("^(?:[0-9A-F]{2})*?00"))
    text = F.when(utf16, F.decode(head, "UTF-16")).when(~binary, F.try_validate_utf8(head.cast("string")))
    return F.regexp_replace(F.when(~utf16 & ~binary & text.isNull(), F.make_valid_utf8(head.cast("string"))).otherwise(text), "^\ufeff", "")


def files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """repo_id, path, size, text of all files under root/<repository>/; `depth` folders name the repository."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    clean = root.rstrip("/").split("://")[-1].removeprefix("file:")
    inside = F.regexp_extract("path", rf"\Q{clean}\E/+((?:[^/]+/){{{depth}}})(.+)$", 2)
    repo = F.rtrim(F.regexp_extract("path", rf"\Q{clean}\E/+((?:[^/]+/){{{depth}}})(.+)$", 1), F.lit("/"))
    listed = rows.select(repo.alias("repo_id"), inside.alias("path"), F.col("length").alias("size"), "content")
    return listed.filter((F.col("path") != "") & ~F.rlike("path", F.lit(SKIPPED))).select("repo_id", "path", "size", text_of(F.col("content")).alias("text"))


def landed_repositories(spark: SparkSession, path: str) -> DataFrame:
    """Repositories of landed listing pages (JSON lines of API pages), with owners whose listing is incomplete marked.

    A page holds nodes and an error flag; a node that is null or an error makes its owner's listing incomplete.
    """
    node = "struct<nameWithOwner:string,isFork:boolean,isArchived:boolean,pushedAt:timestamp,description:string,defaultBranch:string>"
    pages = spark.read.schema(f"owner string, errors array<string>, nodes array<{node}>").json(path)
    broken = pages.groupBy(F.lower("owner").alias("owner")).agg(F.bool_or((F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0) | F.exists("nodes", lambda n: n.isNull())).alias("incomplete"))
    each = pages.select(F.lower("owner").alias("owner"), F.explode("nodes").alias("n")).filter("n is not null").select("owner", "n.*")
    return each.dropDuplicates(["nameWithOwner"]).join(broken, "owner", "left")


def records(spark: SparkSession, path: str, schema: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of stored JSON: rows that cannot be read or lack a required field are rejected with their text."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    bad = F.col("_corrupt").isNotNull() | lacking
    tagged = rows.withColumn("_file", F.input_file_name()).withColumn("_bad", bad)
    return tagged.filter("not _bad").drop("_bad", "_corrupt", "_file"), tagged.filter("_bad").select("_file", F.substring("_corrupt", 1, 300).alias("reason"))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """repo_id, author, at, path from landed logs: a header line `commit<TAB>repo<TAB>author<TAB>ISO time` with a path each."""
    return spark.read.schema("repo_id string, author string, at timestamp, path string").option("sep", "\t").csv(path)


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Landed advisories: id, aliases, severity, cvss, affected packages with fixed versions."""
    return spark.read.schema("id string, aliases array<string>, severity_label string, cvss array<string>, withdrawn timestamp, affected array<struct<ecosystem:string,name:string,fixed:array<string>,versions:array<string>>>").json(path)
