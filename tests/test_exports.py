"""Export shapes, technology rules by file, repository types, facets, the postings index, and merged stream batches."""

from pyspark.sql import functions as F

from loamline.operators import exports, facets, search, technologies


def test_bill_of_materials(spark):
    one = lambda *rows: spark.createDataFrame(list(rows), "ref string, name string, kind string")
    got = {tuple(r) for r in exports.ai_bom(one(("m", "model", "model")), one(("m", "sdk", "sdk"), ("s", "sdk", "sdk")), one(("s", "a", "asset"), ("a", "a", "asset"))).collect()}
    assert got == {("m", "model", "model"), ("s", "sdk", "sdk"), ("a", "a", "asset")}


def test_component_names(spark):
    df = spark.createDataFrame([("o/My Repo", "My Repo", "o", None), ("o/x", "x", "o", None), ("p/x", "x", "p", None), ("p/y", "y", "p", "Declared!")], "id string, name string, owner string, declared string")
    assert {r.id: r.component for r in exports.component_names(df).collect()} == {"o/My Repo": "my-repo", "o/x": "o-x", "p/x": "p-x", "p/y": "declared-"}


def test_slim(spark):
    repos = spark.createDataFrame([(1, "a"), (2, "b")], "repo_id long, id string")
    deps = spark.createDataFrame([(1, "z", "runtime"), (1, "y", "dev"), (1, "q", "transitive")], "repo_id long, name string, scope string")
    links = spark.createDataFrame([(1, 2), (3, 2)], "src long, dst long")
    assert {r.id: (r.dependency_names, r.used_by_count) for r in exports.slim(repos, deps, links).collect()} == {"a": (["y", "z"], 0), "b": ([], 2)}


def test_technologies(spark):
    files = spark.createDataFrame([(1, "Dockerfile"), (1, "infra/main.tf"), (2, "README.md"), (2, "LICENSE"), (3, "package.json"), (4, "pnpm-workspace.yaml"), (4, "Dockerfile")], "repo_id long, path string")
    assert {tuple(r) for r in technologies.by_file(files).collect()} == {(1, "infrastructure", "Docker"), (1, "infrastructure", "Terraform"), (4, "infrastructure", "Docker")}
    assert {r.repo_id: r.repo_type for r in technologies.repo_type(files).collect()} == {1: "service", 2: "documentation", 3: "library", 4: "monorepo"}


def test_facet_count_equals_its_filter(spark):
    rows = [(1, ["React", "react", "Vue"]), (2, ["REACT"]), (3, ["vue", "mcp__x__*"]), (4, None), (5, [])]
    items = spark.createDataFrame(rows, "id long, tech array<string>")
    counts = {r.value: r.n for r in facets.facet_counts(items, "tech").collect()}
    assert counts == {"React": 2, "Vue": 2, "mcp__x__*": 1}
    for value, n in counts.items():
        request = facets.read(f'tech:"={value}"', {"tech"})
        assert items.filter(facets.predicate(request.filters, {"tech": F.col("tech")})).count() == n


def test_request_reading():
    r = facets.read('Tech:react -tech:"a b" nokey:x "two words" tech: plain', {"tech"})
    assert [(f.key, f.value, f.negated) for f in r.filters] == [("tech", "react", False), ("tech", "a b", True)]
    assert r.unknown == ["nokey"] and r.text == "nokey:x two words plain"


def test_threshold_that_is_no_number_filters_nothing(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id long, n int")
    test = lambda v: facets.predicate([facets.Filter("min", v)], {}, {"min": F.col("n")})
    assert df.filter(test("abc")).count() == 2 and df.filter(test("5")).count() == 1 and df.filter(test("6")).count() == 0


def test_postings_agree_with_scan(spark):
    df = spark.createDataFrame([(1, "Alpha beta", "alpha ÄB"), (2, "beta", "x alpha-beta alpha"), (3, None, "")], "id long, name string, content string")
    index = search.postings(df, ["name", "content"])
    got = {r.id: r.w for r in index.filter(F.startswith("token", F.lit("alp"))).groupBy("id").agg(F.sum(F.when(F.col("column") == "name", 8.0).otherwise(1.0) * F.col("tf")).alias("w")).collect()}
    assert got == {1: 9.0, 2: 2.0}
    assert search.terms("C++ The the über a1 b") == ["the", "über", "a1"]


def test_merged_batches_keep_the_newest_row(spark, tmp_path):
    from loamline.streaming import usage_stream as us

    schema = "id string, n long, ts timestamp"
    rows = [[("a", 1, "2024-01-01"), ("b", 1, "2024-01-01"), ("a", 2, "2024-01-02")], [("b", 5, "2024-02-01"), ("c", 1, "2024-02-01")]]
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, "id string, n long, t string").select("id", "n", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        us.merge_batches(us.follow(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), "id", str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.n for r in spark.read.parquet(str(tmp_path / "out" / "v1")).collect()}
    assert got == {"a": 2, "b": 5, "c": 1}
