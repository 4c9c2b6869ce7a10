"""READMEs, owners, descriptors, runtimes, advisories and code assets on files of our own making."""

import pytest
from pyspark.sql import functions as F

from loamline.operators import advisories, code_assets, documents

PROMPT = "You are a careful reviewer of changes. Read the change, say what it does in one sentence, list what may break and how to test it, and be brief in all you say, without praise or blame."
FILES = {
    "README.md": "# [Box](http://x) `tool`\n\n[![b](u)](v)\n\nPacks **things** into boxes of\nthe right size. See [docs](d).\n\n```\ncode that is no prose at all, really\n```\n\n- fast\n- *small*\n\n## More\n\nAnother paragraph that goes on.\n",
    "readme.txt": "no",
    ".github/CODEOWNERS": "# top\n* @a/core x@y.org\n/docs @b @a/core # tail\n",
    "CODEOWNERS": "* @nobody\n",
    "catalog-info.yaml": "apiVersion: backstage.io/v1\nkind: API\nmetadata:\n  name: box-api\n---\nkind: Component\nmetadata:\n  name: box\nspec:\n  owner: team-a\n  lifecycle: production\n  dependsOn:\n    - component:tape\n    - resource:db\n",
    ".nvmrc": "v20.1.0\n", ".tool-versions": "nodejs 18.2.0\npython 3.11.4\nother 1\n", "Dockerfile": "FROM python:3.9-slim AS b\nFROM base:1\n", ".github/workflows/a.yml": "steps:\n  - with:\n      python-version: '3.12'\n", "global.json": '{"sdk": {"version": "6.0.100"}}',
    "src/a.py": f'from anthropic import Anthropic\nx = client.messages.create(model="claude-x-1")\n\nREVIEW_PROMPT = """{PROMPT}"""\nshort_prompt = """no"""\n',
    "src/s.py": "from mcp.server import S\n\n@app.tool()\nasync def pack(x):\n    pass\n", "src/t.ts": 'import { S } from "@modelcontextprotocol/sdk/server";\ns.registerTool("unpack", {});\n', "tests/a.py": "import anthropic\n",
    ".mcp.json": '{"mcpServers": {"p": {"command": "npx", "args": ["-y", "@o/pack@1.2"]}, "u": {"url": "https://x"}, "l": {"command": "./run.sh"}}}',
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, p, t) for p, t in FILES.items()], "repo_id long, path string, text string").cache()


def test_documents(files):
    r = documents.readmes(files).first()
    assert (r.title, r.summary, r.features) == ("Box tool", "Packs things into boxes of the right size. See docs. Another paragraph that goes on.", ["fast", "*small*"])
    assert documents.code_owners(files).first().owners == ["@a/core", "x@y.org", "@b"]
    d = documents.declared(files).first()
    assert (d.name, d.owner, d.lifecycle, d.depends_on) == ("box", "team-a", "production", ["component:tape", "resource:db"])


def test_runtimes(spark, files):
    pins = documents.runtimes(files)
    assert {(r.runtime, r.version) for r in pins.collect()} == {("node", "20.1.0"), ("node", "18.2.0"), ("python", "3.11.4"), ("python", "3.9"), ("python", "3.12"), ("dotnet", "6.0.100")}
    table = spark.createDataFrame([("node", "18", "2025-04-30"), ("python", "3.9", "2025-10-31"), ("python", "3.12", "2028-10-31"), ("dotnet", "6", "2024-11-12")], "runtime string, cycle string, ends string").withColumn("ends", F.col("ends").cast("date"))
    got = {(r.runtime, r.version, r.severity) for r in documents.end_of_life(pins, table, F.lit("2025-12-01").cast("date")).collect()}
    assert got == {("node", "18.2.0", "medium"), ("python", "3.9", "medium"), ("dotnet", "6.0.100", "high")}


def test_advisories(spark):
    deps = spark.createDataFrame([(1, "pypi", "My_Lib", "1.0"), (1, "npm", "x", "2.0"), (2, "npm", "x", "3.0"), (2, "npm", "x", None)], "repo_id long, ecosystem string, name string, resolved string")
    one = lambda e, n, fixed, v: [(e, n, fixed, v)]
    rows = [
        ("GHSA-1", ["CVE-1"], None, ["CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"], one("pypi", "my-lib", ["1.10", "1.9"], ["1.0"])),
        ("PYSEC-1", ["CVE-1"], "LOW", None, one("pypi", "my.lib", ["1.9"], ["1.0"])),
        ("GHSA-2", [], None, ["5.0"], one("npm", "x", [], ["2.0"])),
        ("GHSA-3", None, None, None, one("npm", "x", ["3.1"], ["2.0", "3.0"])),
    ]
    adv = spark.createDataFrame(rows, "id string, aliases array<string>, severity_label string, cvss array<string>, affected array<struct<ecosystem:string,name:string,fixed:array<string>,versions:array<string>>>")
    got = {(r.repo_id, r.ids, r.severity, tuple(r.fixed)) for r in advisories.findings(deps, adv).collect()}
    assert got == {(1, "GHSA-1 PYSEC-1", "high", ("1.9", "1.10")), (1, "GHSA-2", "medium", ()), (1, "GHSA-3", "medium", ("3.1",)), (2, "GHSA-3", "medium", ("3.1",))}


def test_code_assets(files):
    use = {(r.sdk, r.files, r.call_sites, r.first_path) for r in code_assets.sdk_usage(files).collect()}
    assert use == {("Anthropic SDK", 2, 1, "src/a.py"), ("MCP SDK", 2, 2, "src/s.py")}
    assert [(r.name, r.line, r.prompt) for r in code_assets.inline_prompts(files).collect()] == [("REVIEW_PROMPT", 4, PROMPT)]
    assert {r.tool for r in code_assets.server_tools(files).collect()} == {"pack", "unpack"}
    assert [(r.model, r.files) for r in code_assets.model_ids(files).collect()] == [("claude-x-1", 1)]
    assert {(r.server, r.launches) for r in code_assets.servers(files).collect()} == {("p", "@o/pack"), ("u", None), ("l", None)}
