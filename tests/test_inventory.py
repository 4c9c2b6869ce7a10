"""An inventory of two small repositories, built and asked."""

import json

import pytest

from loamline.__main__ import main
from loamline.inventory import Inventory

FILES = {
    "acme/lib/package.json": '{"name": "@acme/lib", "dependencies": {"left": "^1.0.0"}}',
    "acme/lib/package-lock.json": '{"packages": {"node_modules/left": {"version": "1.2.0"}, "node_modules/deep": {"version": "0.1.0"}}}',
    "acme/lib/README.md": "# Lib\n\nPacks things into boxes of the right size.\n",
    "acme/lib/action.yml": "name: Pack action\nruns:\n  using: node20\n",
    "acme/web/package.json": '{"name": "web", "private": true, "dependencies": {"@acme/lib": "^2", "react": "18.2.0"}}',
    "acme/web/src/a.ts": "let x = 1\n",
    "acme/web/Dockerfile": "FROM node:latest\n",
    "acme/web/AGENTS.md": "---\ndescription: How to work here, with care and in small steps that can be undone.\n---\n# Rules\nBe brief.\n",
    "other/web/main.go": "package main\n",
}


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("checkouts")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    out = str(tmp_path_factory.mktemp("inventory"))
    assert main(["--tables", out, "build", str(root)]) == 0
    return Inventory(spark, out)


def test_queries(inventory):
    c = inventory
    assert [r.id for r in c.search_repos("boxes").collect()] == ["acme/lib"]
    assert [r.id for r in c.search_repos("boxes nosuch").collect()] == ["acme/lib"]
    assert c.search_repos("100%_").count() == 0
    assert {r.id for r in c.search_repos(technology="react").collect()} == {"acme/web"}
    assert {r.id for r in c.search_repos(language="typescript").collect()} == {"acme/web"}
    assert {r.id for r in c.search_repos(has_ai=True).collect()} == {"acme/web"}
    assert [(r.name, r.resolved, r.scope) for r in c.dependency_usage("LEFT").collect()] == [("left", "1.2.0", "runtime")]
    assert [(r.resolved, r.scope) for r in c.dependency_usage("deep").collect()] == [("0.1.0", "transitive")]
    assert c.dependency_usage("deep", include_transitive=False).count() == 0
    assert [(r.id, r.category) for r in c.repos_using("react").collect()] == [("acme/web", "dependency"), ("acme/web", "frameworks")]
    assert [r.name for r in c.find_building_blocks("pack").collect()] == ["Pack action"]
    assert {r.flag_id for r in c.list_flags(repo="acme/web").collect()} == {"docker-unpinned-base", "docker-runs-as-root"}
    assert ("frameworks", "React", 1) in {tuple(r) for r in c.technology_usage().collect()}
    asset = c.search_assets(min_quality=1).first()
    assert asset.name == "AGENTS" and c.get_asset(asset.id)["kind"] == "instructions" and c.get_asset("no") is None


def test_names_and_links(inventory):
    c = inventory
    assert c.resolve_repo("WEB") == ["acme/web", "other/web"] and c.resolve_repo("lib") == ["acme/lib"] and c.resolve_repo("%") == []
    assert c.relationships("acme/web")["depends_on"] == [{"repo": "acme/lib", "via": "npm @acme/lib"}]
    assert c.relationships("lib")["used_by_total"] == 1
    assert c.relationships("web") == {"candidates": ["acme/web", "other/web"]}
    assert c.get_repo("acme/web", max_items=1)["truncated"]["dependencies"] == {"shown": 1, "total": 3}
    assert c.sql("select count(*) as n from repos") == [{"n": 3}]


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ("lang:typescript", {"acme/web"}), ("dep:left", {"acme/lib"}), ("dep:deep", set()), ("-dep:left owner:acme", {"acme/web"}), ("tech:rea fw:react", {"acme/web"}), ("ai:yes", {"acme/web"}), ("ai:n*", {"acme/lib", "other/web"}),
        ("usedby:yes", {"acme/lib"}), ("reuse:action", {"acme/lib"}), ("flag:docker-unpinned-base", {"acme/web"}), ("topic:any", set()), ("-topic:any boxes", {"acme/lib"}), ("vuln:no", {"acme/lib", "acme/web", "other/web"}), ("nosuch:key", set()),
    ],
)
def test_keys(inventory, query, ids):
    assert {r.id for r in inventory.filter_repos(query).collect()} == ids


def test_keys_of_blocks(inventory):
    assert inventory.filter_building_blocks("kind:action repo:lib").count() == 1
    assert inventory.filter_building_blocks("-kind:action").count() == 0


def test_command_line(inventory, capsys):
    assert main(["--tables", inventory.path, "sql", "select id from repos order by id limit 1"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"id": "acme/lib"}


def test_long_chains_of_aliases_are_one_group(spark):
    from loamline.operators import links

    chain = [(f"A{i:03d}", [f"A{i + 1:03d}"]) for i in range(60)] + [("B1", ["X"]), ("B2", None)]
    df = spark.createDataFrame(chain, "id string, aliases array<string>").coalesce(1)
    got = {r.id: r.group_id for r in links.alias_groups(df).collect()}
    assert got == {i: "A000" if i[0] == "A" else i for i, _ in chain}
    with pytest.raises(RuntimeError):
        links.alias_groups(df, rounds=2)


def test_alias_groups_read_shared_aliases_alone(spark):
    from loamline.operators import links

    df = spark.createDataFrame([("a", ["x", "own"]), ("b", ["x"]), ("c", ["a", None]), ("d", None), ("d", ["lone"]), (None, ["x"])], "id string, aliases array<string>")
    out = links.alias_groups(df)
    assert sorted(tuple(r) for r in out.collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert "coalesce(group_id" in out._jdf.queryExecution().optimizedPlan().toString()  # what shares no alias is in no round
