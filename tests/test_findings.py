"""Findings, practices, building blocks, references, assets and sources on files of our own making."""

import pytest

from loamline.operators import findings
from loamline.sources import checkouts, sinks

TOKEN = "gh" + "p_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3hJ6"
FILES = {
    "src/app.py": f"import x\ntoken = '{TOKEN}'\n",
    "tests/k.py": f"t = '{TOKEN}'\n",
    "src/sample.py": "api_key = 'your_example_key_placeholder'\n",
    "Dockerfile": "FROM python\nRUN x\n",
    "svc/Dockerfile": "FROM python:3.12 AS b\nFROM b\nUSER app\n",
    ".github/workflows/a.yml": "on: pull_request_target\njobs:\n  x:\n    steps:\n      - uses: Acme/tool/sub@v1\n        with:\n          ref: ${{ github.event.pull_request.head.sha }}\n      - run: echo ${{ github.event.issue.title }}\n",
    ".github/workflows/b.yml": "on: push\njobs:\n  x:\n    steps:\n      - env:\n          TITLE: ${{ github.event.issue.title }}\n        run: echo $TITLE\n",
    ".claude/settings.json": '{"permissions": {"allow": ["Bash(*)", "Read"], "defaultMode": "bypassPermissions"}}',
    "README.md": "# x\n", "LICENSE": "MIT", ".gitignore": "x",
    "action.yml": "name: My action\nruns:\n  using: node20\n",
    "api/openapi.yaml": "openapi: 3.0.0\ninfo:\n  title: Orders\n",
    "skills/pack/SKILL.md": "---\nname: pack\ndescription: Packs things into boxes of the right size, quickly and well.\n---\n# Use\n" + "word " * 60,
    "AGENTS.md": "Be brief.",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, p, t) for p, t in FILES.items()], "repo_id long, path string, text string").cache()


def test_findings(files):
    got = {(r.flag_id, r.severity, r.path, r.line) for r in findings.findings(files).collect()}
    assert got == {
        ("committed-secret", "high", "src/app.py", 2), ("committed-secret", "low", "tests/k.py", 1),
        ("docker-unpinned-base", "medium", "Dockerfile", None), ("docker-runs-as-root", "low", "Dockerfile", None),
        ("workflow-script-injection", "high", ".github/workflows/a.yml", 8), ("workflow-pwn-request", "high", ".github/workflows/a.yml", None),
        ("ai-permissions-bypassed", "high", ".claude/settings.json", None), ("ai-unrestricted-shell", "high", ".claude/settings.json", None),
    }
    assert not any(TOKEN in str(r) for r in findings.findings(files).collect())


def test_every_kind_of_secret_is_counted_without_a_cap(spark, tmp_path):
    from loamline import registry

    mixed = "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0dF3hJ6kL9nP2qR5tU8wX1zA4cE7fG0iK3mO6rS9uV2xY5b"
    texts = [
        "AS" + "IA" + "3D6G9J2M5P8S1V4Y", "aws_AK" + "IA" + "3D6G9J2M5P8S1V4Y", TOKEN, "sk-" + "ant-api03-" + mixed + mixed, "sk-" + "proj-" + mixed[:20] + "T3Blbk" + "FJ" + mixed[:20],
        "https://hooks.slack" + ".com/services/T0AB1CD2E/B0FG3HI4J/" + mixed[:24], "h" + "f_" + mixed[:34], "Account" + "Key=" + mixed + mixed[:10] + "==", "S" + "K" + "0123456789abcdef" * 2,
        "//r.org/:_auth" + "Token=" + mixed[:36], "postgres" + "://app:s3cretWord9@db.acme.io/x", 'Password: "' + mixed[:24] + '"', "xo" + "xb-123456789012-" + mixed[:20],
        "postgres://app:s3cretWord9@localhost/x postgres://app:${PASSWORD1}@db.acme.io/x mysql://abcdefg1:Abcdefg1@db.acme.io/x SK" + "a" * 32, "token: none", None,
    ]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(100 + i, f'token = "{mixed[:24]}"', "hot") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in registry.QUERIES["find_secrets"](spark, str(tmp_path)).collect()} == {("s", 13), ("hot", 60)}
    files = spark.createDataFrame([(1, f"{i}.py", t) for i, t in enumerate(texts)] + [(2, f"{i}.py", t) for i, t, _ in rows[-60:]], "repo_id long, path string, text string")
    kinds = {r.path: r.message for r in findings.secrets(files.filter("repo_id = 1"), most=None).collect()}
    assert [kinds[f"{i}.py"].removeprefix("Possible ") for i in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 11)] == ["aws-access-key", "aws-access-key", "anthropic-api-key", "openai-api-key", "slack-webhook", "hugging-face-token", "azure-storage-key", "twilio-api-key", "npm-auth-token", "database-url-with-password", "assigned-secret"]
    assert findings.secrets(files.filter("repo_id = 2")).count() == 25


def test_practices(files):
    passed = {r.check for r in findings.practice_checks(files).collect() if r.passed}
    assert passed == {"readme", "license", "tests", "ci", "gitignore"}


def test_blocks_and_references(files):
    assert {(r.kind, r.name) for r in findings.building_blocks(files).collect()} == {("action", "My action"), ("api", "Orders")}
    assert {(r.kind, r.target) for r in findings.cross_references(files).collect()} == {("action", "acme/tool")}


def test_assets(files):
    rows = {r.path: r for r in findings.assets(files).collect()}
    assert set(rows) == {"skills/pack/SKILL.md", "AGENTS.md", ".claude/settings.json"}
    assert (rows["skills/pack/SKILL.md"].name, rows["skills/pack/SKILL.md"].quality_score) == ("pack", 100)
    assert rows["AGENTS.md"].word_count == 2 and len(rows["AGENTS.md"].id) == 16


def test_checkout_source(spark, tmp_path):
    for path, content in {"r1/a.txt": b"\xef\xbb\xbfhi", "r1/b.bin": b"a\x00b", "r2/node_modules/x.js": b"no", "r2/d/e.md": "grüß".encode("utf-16")}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    got = {(r.repo_id, r.path): r.text for r in checkouts.files(spark, str(tmp_path)).collect()}
    assert got == {("r1", "a.txt"): "hi", ("r1", "b.bin"): None, ("r2", "d/e.md"): "grüß"}


def test_records_and_sinks(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"id": "a", "n": 1}\n{"id": null}\n{broken\n')
    good, rejected = checkouts.records(spark, str(tmp_path / "in.json"), "id string, n long", ["id"])
    assert [r.id for r in good.collect()] == ["a"] and len(rejected.collect()) == 2
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    sinks.write_table(df, str(tmp_path), "repos")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("c", None)], "id string, n long")
    assert {r.id for r in sinks.changed_rows(new, spark.read.parquet(str(tmp_path / "repos")), "id").collect()} == {"b", "c"}
    sinks.write_csv(spark.createDataFrame([("=x", 'a"b')], "p string, q string").coalesce(1), str(tmp_path / "csv"))
    assert "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).rstrip("\r\n") == "'=x,\"a\"\"b\""


def test_stream_equals_batch(spark, tmp_path):
    from loamline.streaming import usage_stream as us

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = us.flag_counts(us.follow(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string", 1), late="365 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("flag_counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("flag_counts").collect()) == sorted(us.flag_counts(events).collect())


def test_guard(spark):
    from loamline.operators import guarded

    df = spark.range(5)
    assert guarded.read_only_sql(spark, "select id from t order by id;", {"t": df}, limit=0).count() == 1
    assert guarded.read_only_sql(spark, "with x as (select 1 a) select ';' s from x", {}).first().s == ";"
    assert guarded.read_only_sql(spark, "select a.id from t a join (select max(id) m from T) b on a.id = b.m where exists (select 1 from t)", {"t": df}).first().id == 4
    assert guarded.read_only_sql(spark, "select 'java_method(1)' s, count(*) over () n from t", {"t": df}).count() == 5
    refused = (
        "drop table t", "select 1; select 2", "select 1 -- x", "with x as (select 1) insert into t select * from x", "pragma x", "", "select id frm t",
        "select * from text.`/etc/hostname`", "select * from text.hostname", "select * from `text`.`/etc/hostname`", "select * from other", "select id from t where id in (select value from csv.`/etc/passwd`)",
        "with x as (select * from text.`/etc/hostname`) select * from x", "select (select max(value) from text.`/etc/hostname`)", "select java_method('java.lang.System', 'getenv', 'PATH')", "select REFLECT ('java.lang.System', 'getenv', 'PATH')",
        "select `java_method`('java.lang.System', 'getenv', 'PATH')", "select try_reflect('a', 'b')", "select identifier('java_' || 'method')('a', 'b')", "select * from identifier('t')", "select * from range(9)", "select transform(id) using 'cat' from t",
    )
    call = "java_method('java.lang.System', 'getProperty', 'user.dir')"
    refused += (
        rf"select r'\' a, {call} b", rf'select r"\" a, {call} b', f"select system.builtin.{call}", f"select `system`.`builtin`.{call}", f"select transform(array(1), x -> transform(array(x), y -> {call}))", f"select exists(select {call} from t)",
        f"select sum(id) over w from t window w as (partition by {call})", f"select * from t lateral view explode(array({call})) e", f"select count(*) filter (where {call} = '') from t", f"select * from values ({call})", f"select * from t pivot (max({call}) for id in (1))",
        f"with q as (select {call}) select * from q", f"from t |> where {call} = ''", f"select * from t, lateral (select {call})", f"select * from t order by {call} limit 1", "select not_a_function(id) from t", "execute immediate 'select 1'", "select current_user()",
    )
    for bad in refused:
        with pytest.raises(ValueError):
            guarded.check(spark, bad, ["t"])
    allowed = ("select r'\\' a, upper('x') b", "select transform(array(id), x -> x + 1) from t", "select sum(id) over w from t window w as (order by id)", "select * from t lateral view explode(array(1)) e as f", "select `id`, cast(id as string), coalesce(id, 0) from t", "values (1), (2)")
    assert all(guarded.read_only_sql(spark, good, {"t": df}).count() for good in allowed)


def test_increments(spark):
    from loamline.operators import increments

    before = spark.createDataFrame([("a", "o", 1), ("b", "o", 2), ("c", "p", 3)], "id string, owner string, n long")
    new = spark.createDataFrame([("a", "o", 9, False), ("b", "o", None, True), ("d", "o", None, True)], "id string, owner string, n long, failed boolean")
    assert {(r.id, r.n) for r in increments.keep_last_good(new, before, "id").collect()} == {("a", 9), ("b", 2), ("d", None)}
    listed, owners = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("o",)], "owner string")
    assert {r.id for r in increments.prune(before, listed, owners).collect()} == {"a", "c"}
    assert {r.id for r in increments.prune(before, listed, owners.limit(0)).collect()} == {"a", "b", "c"}


def test_bots_are_no_authors(spark):
    from loamline.operators import usage

    rows = [("r", "ann")] * 40 + [("r", "dependabot[bot]")] * 60 + [("r", "Renovate-Bot")] * 60 + [("r", "bob")] * 2
    got = usage.bus_factor(spark.createDataFrame(rows, "repo_id string, author string")).first()
    assert (got.total, got.top, got.flagged) == (42, 40, True)


def test_routes_group_owned_packages_alone(spark):
    from loamline.operators import links

    repos = spark.createDataFrame([(1, False), (2, False), (3, True)], "repo_id long, archived boolean")
    packages = spark.createDataFrame([(1, "npm", "A"), (2, "npm", "b"), (3, "npm", "b"), (1, "npm", "both"), (2, "npm", "both")], "repo_id long, ecosystem string, name string")
    deps = spark.createDataFrame([(2, "npm", "a", "dev"), (2, "npm", "a", "runtime"), (3, "npm", "b", "runtime"), (1, "npm", "B", "dev"), (1, "npm", "a", "dev"), (3, "npm", "both", "dev"), (3, "npm", "none", "dev")], "repo_id long, ecosystem string, name string, scope string")
    out = links.routes(deps, packages, repos)
    assert {tuple(r) for r in out.collect()} == {(2, 1, "npm a", 0), (1, 2, "npm b", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("dst" in line for line in plan if "Aggregate" in line and "min(" in line and "scope_rank" in line)
