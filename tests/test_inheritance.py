"""Properties, parents and central versions of build files."""

import pytest

from loamline.operators import inheritance

ROOT = "<project><groupId>org.acme</groupId><artifactId>root</artifactId><version>7</version><properties><core>2.1</core><both>${core}-${tail}</both><tail>x</tail><a>${b}</a><b>${a}</b></properties><dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId><version>${both}</version></dependency><dependency><groupId>g</groupId><artifactId>over</artifactId><version>1</version></dependency></dependencies></dependencyManagement></project>"
PARENT = "<parent><groupId>org.acme</groupId><artifactId>{}</artifactId><version>7</version>{}</parent>"
D = "<dependency><groupId>{}</groupId><artifactId>{}</artifactId>{}</dependency>"
POMS = {
    "pom.xml": ROOT,
    "mid/pom.xml": f"<project>{PARENT.format('root', '')}<artifactId>mid</artifactId><properties><tail>y</tail></properties><dependencyManagement><dependencies>{D.format('g', 'over', '<version>2</version>')}</dependencies></dependencyManagement></project>",
    "deep/er/pom.xml": f"<project>{PARENT.format('mid', '<relativePath>../../mid/pom.xml</relativePath>')}<artifactId>leaf</artifactId><dependencies>"
    + D.format("g", "managed", "") + D.format("g", "over", "") + D.format("${project.groupId}", "own", "<version>${project.version}</version>") + D.format("g", "loop", "<version>${a}</version>") + D.format("g", "none", "<version>${nobody}</version>") + D.format("g", "unmanaged", "") + D.format("g", "plain", "<version>3</version><scope>test</scope>")
    + "</dependencies></project>",
    "alone/pom.xml": f"<project>{PARENT.format('stranger', '')}<artifactId>alone</artifactId><dependencies>{D.format('g', 'managed', '')}{D.format('g', 'parent', '<version>${project.parent.version}</version>')}</dependencies></project>",
    "bad/pom.xml": "<project><dependencies>",
}
BUILD = {
    "Directory.Build.props": "<Project><PropertyGroup><Base>9.0</Base><Serial>$(Base).1</Serial></PropertyGroup></Project>",
    "src/Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Lib.One" Version="$(Serial)"/><PackageVersion Include="Two"><Version>5</Version></PackageVersion></ItemGroup></Project>',
    "Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Two" Version="4"/><PackageVersion Include="Far" Version="1"/></ItemGroup></Project>',
    "src/a/a.csproj": '<Project><PropertyGroup><Base>10.0</Base></PropertyGroup><ItemGroup><PackageReference Include="lib.one"/><PackageReference Include="Two"/><PackageReference Include="Far"/></ItemGroup><ItemGroup><PackageReference Include="Own" Version="$(base)"/></ItemGroup></Project>',
    "b.csproj": '<Project><ItemGroup><PackageReference Include="Two"/><PackageReference Include="Gone" Version="$(Missing)"/></ItemGroup></Project>',
}


def frame(spark, files):
    return spark.createDataFrame([(1, p, t) for p, t in files.items()] + [(2, p, t) for p, t in files.items() if "/" in p], "repo_id long, path string, text string")


def test_maven(spark):
    got = {(r.repo_id, r.manifest, r.name, r.version, r.scope, r.complete) for r in inheritance.maven(frame(spark, POMS)).collect()}
    leaf = "deep/er/pom.xml"
    assert {x[1:] for x in got if x[0] == 1} == {
        (leaf, "g:managed", "2.1-y", "compile", True), (leaf, "g:over", "2", "compile", True), (leaf, "org.acme:own", "7", "compile", True), (leaf, "g:loop", "${a}", "compile", False),
        (leaf, "g:none", "${nobody}", "compile", False), (leaf, "g:unmanaged", None, "compile", False), (leaf, "g:plain", "3", "test", True),
        ("alone/pom.xml", "g:managed", None, "compile", False), ("alone/pom.xml", "g:parent", "7", "compile", True),
    }
    # without the root file the chain ends at mid, and nothing crosses repositories
    assert (2, leaf, "g:managed", None, "compile", False) in got and (2, leaf, "g:over", "2", "compile", True) in got


def test_msbuild(spark):
    got = {(r.manifest, r.name, r.version, r.complete) for r in inheritance.msbuild(frame(spark, BUILD)).filter("repo_id = 1").collect()}
    assert got == {
        ("src/a/a.csproj", "lib.one", "10.0.1", True), ("src/a/a.csproj", "Two", "5", True), ("src/a/a.csproj", "Far", None, False), ("src/a/a.csproj", "Own", "10.0", True),
        ("b.csproj", "Two", "4", True), ("b.csproj", "Gone", "${missing}", False),
    }


def test_lineage_leaves_circles_out_and_refuses_long_chains(spark):
    parents = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "d", None), (2, "a", None)], "repo_id long, unit string, parent string")
    got = {(r.repo_id, r.unit, r.ancestor, r.distance) for r in inheritance.lineage(parents).collect()}
    assert got == {(1, u, v, (ord(v) - ord(u)) % 3) for u in "abc" for v in "abc"} | {(1, "d", "d", 0), (2, "a", "a", 0)}
    chain = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(6)], "repo_id long, unit string, parent string")
    with pytest.raises(RuntimeError):
        inheritance.lineage(chain, most=3)
    assert inheritance.lineage(chain.limit(0)).collect() == []
