"""Inheritance between build files: properties, parents and central versions, resolved as joins over a lineage.

A unit is a build file. definitions (repo_id, unit, name, value) are what it states itself; lineage (repo_id, unit, ancestor, distance)
says which units it inherits from, itself at distance 0. The nearest definition of a name counts. A value may name other
names as ${name}; these are replaced in rounds, each of which settles what names nothing that is open. A name that leads back
to itself is never settled, nor is what depends on it. Central versions are names too: a dependency without a version names
the version that is managed for it. Rounds go through checkpoint files.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAMES = r"\$\{([^${}]+)\}"
_UNIT = ["repo_id", "unit"]


def _kept(df: DataFrame) -> DataFrame:
    """df written to the folder of spark.checkpoint.dir, which a cluster must name; local mode has a folder of its own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="loamline-rounds-"))
    return df.checkpoint()


def _found(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_NAMES), F.lit(1)))


def lineage(parents: DataFrame, most: int = 64) -> DataFrame:
    """repo_id, unit, ancestor, distance for each unit of parents (repo_id, unit, parent; null where it has none), itself included.

    A link that closes a circle is left out. A chain of over `most` units is an error, not a result. Of several parents of a unit
    the smallest counts.
    """
    links = _kept(parents.groupBy(*_UNIT).agg(F.min("parent").alias("parent")))
    step = links.select(*_UNIT, F.col("unit").alias("ancestor"), F.lit(0).alias("distance"), F.array("unit").alias("trail"))
    above = links.filter("parent is not null").select("repo_id", F.col("unit").alias("ancestor"), "parent")
    levels = [step.drop("trail")]
    for _ in range(most):
        step = step.join(above, ["repo_id", "ancestor"]).filter(~F.array_contains("trail", F.col("parent")))
        step = _kept(step.select(*_UNIT, F.col("parent").alias("ancestor"), (F.col("distance") + 1).alias("distance"), F.array_append("trail", F.col("parent")).alias("trail")))
        if step.isEmpty():
            out = levels[0]
            for level in levels[1:]:
                out = out.union(level)
            return out
        levels.append(step.drop("trail"))
    raise RuntimeError(f"a chain of over {most} parents")


def nearest_folders(units: DataFrame) -> DataFrame:
    """repo_id, unit, parent: the nearest folder above that is a unit too, for units named by folders ("a/b/"; "" is the root)."""
    parts = F.filter(F.split("unit", "/"), lambda p: p != "")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    own = units.select(*_UNIT).distinct()
    above = own.filter("unit <> ''").withColumn("parent", F.explode(ups)).join(own.withColumnRenamed("unit", "parent"), ["repo_id", "parent"])
    best = above.groupBy(*_UNIT).agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return own.join(best, _UNIT, "left")


def effective(definitions: DataFrame, lines: DataFrame) -> DataFrame:
    """repo_id, unit, name, value: for each unit the nearest definition of each name among itself and its ancestors; of several at one
    distance the smallest value."""
    near = lines.join(definitions.withColumnRenamed("unit", "ancestor").filter("name is not null and value is not null"), ["repo_id", "ancestor"])
    return near.groupBy(*_UNIT, "name").agg(F.min_by("value", F.struct("distance", "value")).alias("value"))


def _replaced(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, text) with every ${name} that values (repo_id, unit, name, value) hold for the unit replaced."""
    named = rows.select(*keys, "text", F.explode_outer(_found(F.col("text"))).alias("other"))
    known = named.join(values.select(*_UNIT, F.col("name").alias("other"), "value"), [*_UNIT, "other"], "left")
    pairs = F.collect_list(F.when(F.col("value").isNotNull(), F.struct("other", "value")))  # as many as the text names
    grouped = known.groupBy(*keys, "text").agg(pairs.alias("pairs"))
    text = F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(t, F.concat(F.lit("${"), p["other"], F.lit("}")), p["value"]))
    return grouped.select(*keys, text.alias("text"))


def settled(defined: DataFrame, rounds: int = 64) -> DataFrame:
    """repo_id, unit, name, value, resolved of effective definitions: names that others define are replaced by their values, names that
    nobody defines stay as they are written. What leads back to itself has resolved = false and its text as written."""
    defined = _kept(defined.select(*_UNIT, "name", "value"))
    names = defined.select(*_UNIT, "name").distinct()
    mentions = defined.select(*_UNIT, "name", F.explode(_found(F.col("value"))).alias("other"))
    mentions = _kept(mentions.join(names.withColumnRenamed("name", "other"), [*_UNIT, "other"]))
    free = defined.join(mentions.select(*_UNIT, "name").distinct(), [*_UNIT, "name"], "left_anti")
    done, open_ = _kept(free), _kept(defined.join(mentions.select(*_UNIT, "name").distinct(), [*_UNIT, "name"], "left_semi"))
    for _ in range(rounds):
        waits = mentions.join(done.select(*_UNIT, F.col("name").alias("other")), [*_UNIT, "other"], "left_anti").select(*_UNIT, "name").distinct()
        ready = open_.join(waits, [*_UNIT, "name"], "left_anti").withColumnRenamed("value", "text")
        new = _kept(_replaced(ready, done, [*_UNIT, "name"]).withColumnRenamed("text", "value"))
        if new.isEmpty():
            return done.withColumn("resolved", F.lit(True)).union(open_.withColumn("resolved", F.lit(False)))
        done = _kept(done.union(new))
        open_ = _kept(open_.join(new.select(*_UNIT, "name"), [*_UNIT, "name"], "left_anti"))
    raise RuntimeError(f"names nested over {rounds} deep")


def substitute(texts: DataFrame, values: DataFrame) -> DataFrame:
    """texts (repo_id, unit, key, text) with names replaced by settled values, and complete: whether no name is left. Null text stays."""
    known = values.filter("resolved") if "resolved" in values.columns else values
    some = _replaced(texts.filter("text is not null").select(*_UNIT, "key", "text").distinct(), known, [*_UNIT, "key"])
    out = some.withColumn("complete", F.size(_found(F.col("text"))) == 0)
    return out.union(texts.filter("text is null").select(*_UNIT, "key", "text", F.lit(True)).distinct())


# ---------------------------------------------------------------- build files

_DEPENDENCY = "array<struct<groupId:string,artifactId:string,version:string,scope:string>>"
_POM = f"parent struct<groupId:string,artifactId:string,version:string,relativePath:string>, groupId string, artifactId string, version string, properties map<string,string>, dependencies struct<dependency:{_DEPENDENCY}>, dependencyManagement struct<dependencies:struct<dependency:{_DEPENDENCY}>>"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def _joined_path(folder: Column, relative: Column) -> Column:
    """The folder that a relative path of a file or folder leads to."""
    whole = F.filter(F.split(F.concat(folder, F.regexp_replace(relative, r"[^/]*\.xml$", "")), "/"), lambda p: ~p.isin("", "."))
    up = F.aggregate(whole, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return F.when(F.size(up) == 0, F.lit("")).otherwise(F.concat(F.array_join(up, "/"), F.lit("/")))


def _central(group: Column, artifact: Column) -> Column:
    """The name under which a managed version is kept."""
    return F.concat(F.lit("managed:"), F.translate(F.concat_ws(":", group, artifact), "${}", "<<>"))


def maven(files: DataFrame) -> DataFrame:
    """repo_id, manifest, name, version, scope, complete of all pom.xml in files (repo_id, path, text): properties, the parent's coordinates
    and managed versions come from the file itself or from the nearest of its parents in the repository."""
    pom = files.filter(F.rlike("path", F.lit(r"(^|/)pom\.xml$"))).select("repo_id", _folder(F.col("path")).alias("unit"), F.from_xml("text", _POM, {"mode": "PERMISSIVE"}).alias("x"))
    pom = _kept(pom)
    at = F.when(F.col("x.parent").isNotNull(), _joined_path(F.col("unit"), F.coalesce("x.parent.relativePath", F.lit("../"))))
    wanted = pom.select(*_UNIT, at.alias("parent"), F.col("x.parent.artifactId").alias("id"))
    here = pom.select("repo_id", F.col("unit").alias("parent"), F.col("x.artifactId").alias("id"), F.lit(True).alias("here"))
    lines = lineage(wanted.join(here, ["repo_id", "parent", "id"], "left").select(*_UNIT, F.when(F.col("here"), F.col("parent")).alias("parent")))
    pairs = lambda *x: F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in x])
    own = pairs(
        ("project.version", F.coalesce("x.version", "x.parent.version")), ("project.groupId", F.coalesce("x.groupId", "x.parent.groupId")), ("project.artifactId", F.col("x.artifactId")),
        ("project.parent.version", F.col("x.parent.version")), ("project.parent.groupId", F.col("x.parent.groupId")),
    )
    listed = F.transform(F.map_entries("x.properties"), lambda e: F.struct(e["key"].alias("name"), F.trim(e["value"]).alias("value")))
    managed = F.transform("x.dependencyManagement.dependencies.dependency", lambda d: F.struct(_central(d["groupId"], d["artifactId"]).alias("name"), d["version"].alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    stated = pom.select(*_UNIT, F.explode(F.concat(own, F.coalesce(listed, none), F.coalesce(managed, none))).alias("d")).select(*_UNIT, "d.name", "d.value")
    values = settled(effective(stated, lines))
    deps = pom.select(*_UNIT, F.explode("x.dependencies.dependency").alias("d"))
    version = F.coalesce("d.version", F.concat(F.lit("${"), _central(F.col("d.groupId"), F.col("d.artifactId")), F.lit("}")))
    key = F.to_json(F.struct(F.coalesce("d.groupId", F.lit("")).alias("g"), F.coalesce("d.artifactId", F.lit("")).alias("a"), F.coalesce("d.scope", F.lit("compile")).alias("s")))
    # name and version of a dependency are one text, so that both are replaced at once
    texts = deps.select(*_UNIT, key.alias("key"), F.concat_ws("\n", F.concat_ws(":", "d.groupId", "d.artifactId"), version).alias("text"))
    done = substitute(texts, values).withColumn("both", F.split("text", "\n"))
    found = F.get("both", F.lit(1))
    return done.select(
        "repo_id", F.concat("unit", F.lit("pom.xml")).alias("manifest"), F.get("both", F.lit(0)).alias("name"), F.when(~F.startswith(found, F.lit("${managed:")), found).alias("version"), F.get_json_object("key", "$.s").alias("scope"), "complete"
    )


_MSBUILD = "PropertyGroup array<map<string,string>>, ItemGroup array<struct<PackageReference:array<struct<_Include:string,_Version:string,Version:string,_VersionOverride:string>>,PackageVersion:array<struct<_Include:string,_Version:string,Version:string>>>>"


def msbuild(files: DataFrame) -> DataFrame:
    """repo_id, manifest, name, version, complete of references in project files (repo_id, path, text): properties come from the project and
    the nearest Directory.Build.props, versions that a project does not state from the nearest Directory.Packages.props. Names of
    properties and packages are compared in lower case, as the build does."""
    kind = F.regexp_extract("path", r"([^/]+)$", 1)
    known = files.filter(F.rlike("path", F.lit(r"(^|/)(Directory\.(Build|Packages)\.props|[^/]+\.(cs|fs|vb)proj)$")))
    parsed = _kept(known.select("repo_id", F.col("path").alias("unit"), kind.alias("file"), F.from_xml("text", _MSBUILD, {"mode": "PERMISSIVE"}).alias("x")))
    projects = parsed.filter(F.rlike("file", F.lit("proj$")))
    parts = F.split(_folder(F.col("unit")), "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    shared = parsed.filter(F.rlike("file", F.lit("props$"))).select("repo_id", F.col("unit").alias("ancestor"), _folder(F.col("unit")).alias("at"), "file")
    near = projects.select(*_UNIT, F.explode(F.array_distinct(ups)).alias("at")).join(shared, ["repo_id", "at"])
    near = near.groupBy(*_UNIT, "file").agg(F.max_by("ancestor", F.length("at")).alias("ancestor"))  # the nearest file of each kind, not the nearest statement
    lines = near.select(*_UNIT, "ancestor", F.when(F.col("file") == "Directory.Packages.props", 1).otherwise(2).alias("distance"))
    lines = lines.union(projects.select(*_UNIT, F.col("unit").alias("ancestor"), F.lit(0).alias("distance")))
    written = lambda c: F.lower(F.regexp_replace(c, r"\$\(([^()]+)\)", r"\${$1}"))
    flat = F.flatten(F.transform("x.PropertyGroup", lambda g: F.map_entries(g)))
    properties = F.transform(flat, lambda e: F.struct(F.lower(e["key"]).alias("name"), written(F.trim(e["value"])).alias("value")))
    items = lambda n, t: F.flatten(F.transform("x.ItemGroup", lambda g: F.coalesce(g[n], F.array().cast(t))))
    entry = "array<struct<_Include:string,_Version:string,Version:string>>"
    central = F.transform(items("PackageVersion", entry), lambda p: F.struct(F.concat(F.lit("managed:"), F.lower(p["_Include"])).alias("name"), written(F.coalesce(p["_Version"], p["Version"])).alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    stated = parsed.select(*_UNIT, F.explode(F.concat(F.coalesce(properties, none), F.coalesce(central, none))).alias("d")).select(*_UNIT, "d.name", "d.value")
    values = settled(effective(stated, lines))
    reference = "array<struct<_Include:string,_Version:string,Version:string,_VersionOverride:string>>"
    refs = projects.select(*_UNIT, F.explode(items("PackageReference", reference)).alias("p")).filter("p._Include is not null")
    version = F.coalesce(written(F.coalesce("p._VersionOverride", "p._Version", "p.Version")), F.concat(F.lit("${managed:"), F.lower("p._Include"), F.lit("}")))
    done = substitute(refs.select(*_UNIT, F.col("p._Include").alias("key"), version.alias("text")), values)
    return done.select("repo_id", F.col("unit").alias("manifest"), F.col("key").alias("name"), F.when(~F.startswith("text", F.lit("${managed:")), F.col("text")).alias("version"), "complete")
