"""Versions, ranges, package addresses, scores, globs, text expressions."""

import pytest
from pyspark.sql import functions as F

from loamline.functions import globs, packages, text, versions


def test_satisfies(spark):
    rows = [
        ("1.4.2", "^1.2", "npm", True), ("2.0.0", "^1.2", "npm", False), ("0.3.1", "^0.2.3", "npm", False), ("0.2.9", "^0.2.3", "npm", True),
        ("1.2.9", "~1.2.3", "npm", True), ("1.3.0", "~1.2.3", "npm", False), ("2.0.0-rc.1", ">=1 <2.0.0", "npm", False), ("1.0.0-rc.2", ">=1.0.0-rc.1", "npm", True),
        ("1.5.0", "1.x || 3.x", "npm", True), ("2.1.0", "1.2.3 - 2", "npm", True), ("3.0.0", "1.2.3 - 2", "npm", False), ("1.0.0", "workspace:*", "npm", None), ("nope", "^1", "npm", None),
        ("2.5", "~=2.2", "pypi", True), ("3.0", "~=2.2", "pypi", False), ("2.0rc1", ">=1", "pypi", False), ("1.0.post1", ">1.0", "pypi", True), ("1.4.9", "!=1.4.*", "pypi", False),
        ("2.9.9", "~> 2.1", "gem", True), ("2.2.0", "~> 2.1.4", "gem", False), ("1.9.0", "~1.2", "composer", True), ("1.2.0", "1.1", "cargo", True), ("30.0-jre", "30.0-jre", "maven", True), ("30.0-android", "30.0-jre", "maven", False),
    ]
    df = spark.createDataFrame(rows, "v string, s string, e string, want boolean").withColumn("got", versions.satisfies(F.col("v"), F.col("s"), F.col("e")))
    assert [tuple(r) for r in df.collect()] == [(*r, r[3]) for r in rows]


def test_best_match(spark):
    rows = [
        (["1.9.0", "1.10.0", "2.0.0-beta"], ">=1 <2", "npm", "1.10.0"), (["3.0.0"], "^1", "npm", None), (["3.0.0"], "git+ssh://x", "npm", "3.0.0"), (["3.0.0", "4.0.0"], None, "npm", None), ([], "^1", "npm", None), (None, "^1", "npm", None),
        (["4.0.0-rc.12", "4.0.0-rc.3"], ">=4.0.0-rc.1", "npm", "4.0.0-rc.12"), (["8.1.0", "9.0.0rc2"], ">=8,<9", "pypi", "8.1.0"), (["6.1.0.3", "6.1.0.2"], "6.1.0.2", "nuget", "6.1.0.2"), (["x", "1.2.0"], "^1", None, "1.2.0"),
    ]
    df = spark.createDataFrame(rows, "v array<string>, s string, e string, want string").withColumn("got", versions.best_match(F.col("v"), F.col("s"), F.col("e")))
    assert [r.got for r in df.collect()] == [r[3] for r in rows]


def test_sort_key_of_long_numbers(spark):
    rows = [("20240131123456.2",), ("20240131123456.10",), ("9.1",), ("v10.0",), ("1.x",)]
    df = spark.createDataFrame(rows, "v string").orderBy(versions.sort_key(F.col("v")))
    assert [r.v for r in df.collect()] == ["9.1", "v10.0", "20240131123456.2", "20240131123456.10", "1.x"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_exact_version(spark):
    rows = [("npm", "1.x", None), ("npm", "1.2", None), ("npm", "1.2.3", "1.2.3"), ("pypi", "==1.2", "1.2"), ("pypi", "1.2", None), ("maven", "31.1-jre", "31.1-jre"), ("npm", "^1.2.3", None), ("pypi", "==1.2.*", None)]
    df = spark.createDataFrame(rows, "e string, s string, want string").withColumn("got", versions.exact_version(F.col("e"), F.col("s")))
    assert [(r.e, r.s, r.got) for r in df.collect()] == rows


def test_ranges_take_nulls(spark):
    df = spark.createDataFrame([("1.2.0", "^1", "npm"), (None, "^1", "npm"), ("1.2.0", None, None)], "v string, s string, e string")
    assert [r[0] for r in df.select(versions.satisfies(F.col("v"), F.col("s"), F.col("e"))).collect()] == [True, None, None]


def test_purl_round_trip(spark):
    rows = [("npm", "@a/b c", "1.0"), ("pypi", "Typing_Extensions", "4"), ("maven", "g.h:i", None), ("none", "x", "1")]
    df = spark.createDataFrame(rows, "e string, n string, v string").select(packages.purl(F.col("e"), F.col("n"), F.col("v")).alias("p"))
    got = [r.p for r in df.collect()]
    assert got == ["pkg:npm/%40a/b%20c@1.0", "pkg:pypi/typing-extensions@4", "pkg:maven/g.h/i", None]
    parts = df.limit(1).select(packages.purl_parts(F.col("p")).alias("x")).first().x
    assert (parts.type, parts.name, parts.version) == ("npm", "@a/b c", "1.0")


@pytest.mark.parametrize(("vector", "want"), [("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.0/AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", 2.2), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0), ("nonsense", None)])
def test_cvss(spark, vector, want):
    assert value(spark, packages.cvss3(F.lit(vector))) == want


def test_model_and_image(spark):
    for spelling in ("Acme/m-3.5", "us.acme.m-3-5-20250101-v1:0", "m-3.5-latest", "acme/x/m-3.5-2025-01-01"):
        assert value(spark, packages.model_key(F.lit(spelling))) == "m-3-5"
    x = value(spark, packages.image_parts(F.lit("reg.io:5000/a/b:1.2@sha256:0f")))
    assert (x.name, x.tag, x.digest) == ("reg.io:5000/a/b", "1.2", "sha256:0f")


@pytest.mark.parametrize(("pattern", "path", "want"), [("**/*.md", "a/b/c.md", True), ("**/*.md", "c.MD", True), ("*.md", "a/c.md", False), ("a/**", "a/b/c", True), ("x.{yml,yaml}", "x.yaml", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a?c", "a/c", False), ("a.c", "abc", False)])
def test_globs(spark, pattern, path, want):
    assert value(spark, globs.matches(F.lit(path), pattern)) is want


def test_text(spark):
    doc = "# One\ntext <b>bold</b>\n```\ncode\n```\n### Three deep\n#### four\nmore"
    assert value(spark, text.headings(F.lit(doc))) == ["One", "Three deep"]
    assert value(spark, text.excerpt(F.lit(doc))) == "text bold more"
    assert value(spark, text.redact_secrets(F.lit('api_key = "abcdefghijklmnop1234" ok'))) == 'api_key = "[redacted]" ok'
    assert value(spark, text.redact_url(F.lit("https://u:p@h/x?q#f"))) == "https://h/x"
    assert value(spark, text.csv_cell(F.lit('=a"b,c'))) == "\"'=a\"\"b,c\""
    assert value(spark, text.detect_license(F.lit("The MIT License and Apache License"))) == "Apache-2.0 OR MIT"
    assert value(spark, text.content_type(F.lit("a/b.TSX"))) == "TypeScript"


#: Rules of every operator and ecosystem, with a version on either side of each edge.
RANGES = [
    ("1.4.2", "^1.2", "npm", True), ("2.0.0", "^1.2", "npm", False), ("0.3.1", "^0.2.3", "npm", False), ("0.0.4", "^0.0.3", "npm", False), ("0.0.3", "^0.0.3", "npm", True),
    ("2.0.0-rc.1", ">=1 <2.0.0", "npm", False), ("4.0.0-alpha.2", "^3.1", "npm", False), ("6.0.0b2", ">=5,<6", "pypi", False), ("5.3.0-beta", "4.x || >=5.2.0 <5.3", "npm", False),
    ("7.1.0-rc.3", ">=7.1.0-rc.2", "npm", True), ("7.1.0", ">7.1.0-rc.2", "npm", True), ("7.2.0-rc.3", ">=7.1.0-rc.2", "npm", False), ("28.2-jre", "28.2-jre", "maven", True), ("28.2-android", "28.2-jre", "maven", False), ("28.2-jre", ">=27", "maven", True),
    ("3.1b2", "==3.1b2", "pypi", True), ("4.2.0rc2", "==4.2.0", "pypi", False), ("4.2.0-beta", "=4.2.0", "npm", False), ("2.4.7", "==2.4", "pypi", False), ("2.4.0", "==2.4", "pypi", True), ("2.4.7", "2.4", "npm", True),
    ("3.6.1", "!=3.6.*", "pypi", False), ("3.7.0", "!=3.6.*", "pypi", True), ("5.1.3.4", "5.1.3.3", "nuget", False), ("5.1.3.3", "5.1.3.3", "nuget", True),
    ("2.9.0", "~2.3", "composer", True), ("3.0.0", "~2.3", "composer", False), ("2.3.8", "~2.3.4", "composer", True), ("2.4.0", "~2.3.4", "composer", False), ("2.6.0", "^2.3@beta", "composer", True),
    ("2.4.0", "~2.3", "npm", False), ("2.3.9", ">2.3", "npm", False), ("2.4.0", ">2.3", "npm", True), ("2.3.9", "<=2.3", "npm", True), ("3.5.0", "~> 3", "gem", True), ("2.2.0", "~> 2.1.4", "gem", False),
    ("2.5", "~=2.2", "pypi", True), ("3.0", "~=2.2", "pypi", False), ("1.0.post1", ">1.0", "pypi", True), ("2.0.dev3", ">=1.0", "pypi", False), ("1.3.0", "1.2", "cargo", True), ("2.0.0", "1.2", "cargo", False),
    ("2.1.0", "1.2.3 - 2", "npm", True), ("3.0.0", "1.2.3 - 2", "npm", False), ("20240131123456.0.1", ">20240131123455", "npm", True), ("1.2.3+build.7", "1.2.3", "npm", True), ("9.9.9", "*", "npm", True),
    ("1.0.0", "workspace:*", "npm", None), ("x", "^1", "npm", None), ("1.0", "", "npm", None), ("1.5", "npm:other@^1.2", "npm", True),
]


def test_ranges_of_every_ecosystem(spark):
    df = spark.createDataFrame(RANGES, "version string, spec string, ecosystem string, want boolean")
    got = df.withColumn("got", versions.satisfies(F.col("version"), F.col("spec"), F.col("ecosystem"))).collect()
    assert [tuple(r) for r in got if r.got != r.want] == []


VECTORS = [("AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("AV:L/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N", 2.2), ("AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", 0.0)]


def test_scores_of_vectors(spark):
    df = spark.createDataFrame(VECTORS, "vector string, want double").withColumn("got", packages.cvss3(F.col("vector")))
    assert [r.got for r in df.collect()] == [want for _, want in VECTORS]
