"""Package graphs and containment: odd documents, ties, circles, foreign packages."""

import json

import pytest

from loamline.operators import containment, package_graph


def package(element, address):
    return {"SPDXID": element, "externalRefs": [{"referenceType": "cpe", "referenceLocator": "x"}, {"referenceType": "purl", "referenceLocator": address}]}


def edge(a, b, kind="DEPENDS_ON"):
    return {"spdxElementId": a, "relationshipType": kind, "relatedSpdxElement": b}


DOC = {
    "packages": [
        package("root", "pkg:npm/own@1"), package("a", "pkg:npm/%40s/a@1.0"), package("b", "pkg:pypi/Typing_Ext@2"), package("c", "pkg:maven/g.h/c@3"), package("c2", "pkg:maven/g.h/C@4"),
        package("lost", "pkg:cargo/lost"), package("odd", "pkg:unknown/odd@1"), package("have", "pkg:npm/HAVE@1"), {"SPDXID": "bare"}, "no package", None, {"SPDXID": 5, "externalRefs": "none"},
    ],
    "relationships": [edge("doc", "root", "DESCRIBES"), edge("root", "a"), edge("a", "b"), edge("b", "c"), edge("b", "c2"), edge("c", "a"), edge("root", "a"), edge("lost", "lost"), edge("root", "lost", "CONTAINS"), {"spdxElementId": "a"}, 7],
}


def test_merge(spark):
    landed = [(1, json.dumps({"sbom": DOC})), (2, json.dumps(DOC)), (3, "{not json"), (4, None), (5, "[]"), (6, json.dumps({"packages": 3, "relationships": None})), (7, json.dumps({"packages": [package("x", "pkg:npm/x")]}))]
    docs = package_graph.read_documents(spark.createDataFrame(landed, "repo_id long, text string"))
    deps = spark.createDataFrame([(1, "npm", "have"), (2, "pypi", "typing.ext"), (2, "npm", "Have"), (1, "npm", None)], "repo_id long, ecosystem string, name string")
    got = {(r.repo_id, r.ecosystem, r.name, r.version, r.scope, r.depth) for r in package_graph.merged(docs, deps).collect()}
    both = lambda i: {(i, "npm", "@s/a", "1.0", "runtime", 1), (i, "maven", "g.h:C", "4", "transitive", 3), (i, "cargo", "lost", None, "transitive", None)}
    assert got == both(1) | both(2) | {(1, "pypi", "Typing_Ext", "2", "transitive", 2), (7, "npm", "x", None, "transitive", None)}
    assert package_graph.merged(docs.limit(0), deps).collect() == []


def test_merge_of_one_and_of_several_documents(spark):
    half = {**DOC, "packages": []}, {**DOC, "relationships": []}
    landed = [(1, json.dumps(DOC)), (2, json.dumps(half[0])), (2, json.dumps(half[1])), (None, json.dumps(DOC)), (None, json.dumps(DOC))]
    docs = package_graph.read_documents(spark.createDataFrame(landed, "repo_id long, text string"))
    deps = spark.createDataFrame([], "repo_id long, ecosystem string, name string")
    rows = package_graph.merged(docs, deps).collect()
    per = {i: {tuple(r)[1:] for r in rows if r.repo_id == i} for i in (1, 2, None)}
    assert per[1] == per[2] and len(per[1]) == 5 and {r.name: r.depth for r in rows if r.repo_id == 1}["g.h:C"] == 3
    assert len(per[None]) == 6 and {r[-1] for r in per[None]} == {None}
    first = docs.filter("repo_id = 1")
    assert package_graph.merged(first, deps, most=3).count() == 5
    with pytest.raises(Exception, match="over 2 deep"):
        package_graph.merged(first, deps, most=2).count()
    plan = package_graph.merged(first, deps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_parse_json") + plan.count("parse_json(") <= 2 and plan.count("Join") == 1


def test_depths(spark):
    roots = spark.createDataFrame([(1, "a"), (2, "a")], "repo_id long, element string")
    chain = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "b", "d"), (1, "a", "d"), (2, "b", "c")], "repo_id long, source string, target string")
    assert {tuple(r) for r in package_graph.depths(roots, chain).collect()} == {(1, "a", 0), (1, "b", 1), (1, "d", 1), (1, "c", 2), (2, "a", 0)}
    assert package_graph.depths(roots, chain, most=2).count() == 5
    with pytest.raises(RuntimeError):
        package_graph.depths(roots, chain, most=1)


def test_owning_root(spark):
    files = spark.createDataFrame([(1, "a/b/c"), (1, "a/bc"), (1, "a/b"), (1, "x"), (1, "a/b/c"), (2, "a/b/c"), (3, "x/y"), (1, None)], "repo_id long, path string")
    roots = spark.createDataFrame([(1, "a"), (1, "a/b"), (1, "a/b/"), (3, ""), (1, None)], "repo_id long, root string")
    got = sorted(((r.repo_id, r.path, r.root) for r in containment.owning_root(files, roots).collect()), key=str)
    assert got == sorted([(1, "a/b/c", "a/b"), (1, "a/b/c", "a/b"), (1, "a/bc", "a"), (1, "a/b", "a"), (1, "x", None), (2, "a/b/c", None), (3, "x/y", ""), (1, None, None)], key=str)


def test_closest(spark):
    files = spark.createDataFrame([(1, "a/b/c/f"), (1, "a/z"), (1, "q"), (2, "a/b")], "repo_id long, path string")
    places = spark.createDataFrame([(1, "a/b/c/s2"), (1, "a/b/c/s1"), (1, "a/b/x/y/z"), (1, "0/s")], "repo_id long, place string")
    got = {(r.repo_id, r.path, r.place, r.shared) for r in containment.closest(files, places).collect()}
    assert got == {(1, "a/b/c/f", "a/b/c/s1", 3), (1, "a/z", "a/b/c/s1", 1), (1, "q", "0/s", 0), (2, "a/b", None, None)}


def test_configured_servers(spark):
    configs = spark.createDataFrame(
        [(1, "one", "npm", "ours", None), (1, "two", "npm", "foreign", None), (1, "two", "npm", "shared", None), (1, "Three", None, None, None), (1, "three", None, None, "https://x"), (1, "twice", None, None, None), (9, "three", None, None, None), (2, "x", "pypi", "ours", None)],
        "repo_id long, server string, ecosystem string, package string, url string",
    )
    publishers = spark.createDataFrame([(5, "npm", "ours"), (5, "npm", "ours"), (5, "npm", "shared"), (6, "npm", "shared"), (7, "npm", None)], "repo_id long, ecosystem string, package string")
    providers = spark.createDataFrame([(9, "three"), (9, "THREE"), (3, "twice"), (4, "twice"), (4, "two"), (4, None)], "repo_id long, server string")
    assert {tuple(r) for r in containment.configured_servers(configs, publishers, providers).collect()} == {(1, "one", 5), (1, "Three", 9)}
