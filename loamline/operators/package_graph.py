"""Dependency graphs of landed SPDX documents: packages, what the described root reaches, and the merge with declared packages.

A document is one row (repo_id, sbom text). It is read as VARIANT, so that fields of no interest and fields of an odd type cost
nothing and fail nothing. Reachability goes breadth first from the described elements in rounds that keep the first depth of each
element. The graph of a repository with one document lies in that document's row: its rounds run over whole Arrow batches of rows,
before anything is shuffled. Where several documents make up a repository's graph, a round is a join on (repo_id, element), what was
reached before is left out by an anti-join, and rounds go through checkpoint files. A graph that is deeper than the bound is an error,
not a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packages import PURL_TYPES, purl_parts
from .inheritance import _kept

#: Ecosystems by package URL type; of several with one type the first in the table.
ECOSYSTEMS = {kind: eco for eco, kind in reversed(PURL_TYPES.items())}


#: Depths of elements that nothing leads to.
_NOWHERE = -1


def _text(v: str | Column, path: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "string")


def _locator(x: Column) -> Column:
    """The first package URL of a package."""
    refs = F.try_variant_get(x, "$.externalRefs", "array<struct<referenceType:string,referenceLocator:string>>")
    return F.get(F.filter(refs, lambda r: r["referenceType"] == "purl"), F.lit(0))["referenceLocator"]


def _ends(x: Column) -> Column:
    return F.struct(_text(x, "$.spdxElementId").alias("source"), _text(x, "$.relatedSpdxElement").alias("target"), _text(x, "$.relationshipType").alias("kind"))


def _listed(docs: DataFrame, path: str) -> DataFrame:
    """repo_id, x for each element of the list at `path`; a document without it, or with something else there, has none."""
    return docs.select("repo_id", F.explode(F.try_variant_get("doc", path, "array<variant>")).alias("x"))


def read_documents(landed: DataFrame) -> DataFrame:
    """repo_id, doc of landed (repo_id, text); doc is null for text that is no JSON and null texts. A document may lie under "sbom".

    No filter on doc: it would be pushed below the parsing and have every text made and parsed twice."""
    parsed = landed.select("repo_id", F.try_parse_json("text").alias("doc"))
    return parsed.select("repo_id", F.coalesce(F.try_variant_get("doc", "$.sbom", "variant"), F.col("doc")).alias("doc"))


def _named(rows: DataFrame, *more: str) -> DataFrame:
    """repo_id, element, ecosystem, name, version of rows (repo_id, element, locator) whose package URL has a known type."""
    known = F.create_map(*[F.lit(v) for kv in ECOSYSTEMS.items() for v in kv])
    name = F.when(F.col("p.type") == "maven", F.replace("p.name", F.lit("/"), F.lit(":"))).otherwise(F.col("p.name"))
    parts = rows.withColumn("p", purl_parts(F.col("locator")))
    return parts.select("repo_id", "element", F.element_at(known, F.col("p.type")).alias("ecosystem"), name.alias("name"), F.col("p.version").alias("version"), *more).filter("ecosystem is not null and name <> ''")


def packages(docs: DataFrame) -> DataFrame:
    """repo_id, element, ecosystem, name, version of each package that has a package URL of a known type; the first such URL counts."""
    return _named(_listed(docs, "$.packages").select("repo_id", _text("x", "$.SPDXID").alias("element"), _locator(F.col("x")).alias("locator")))


def relations(docs: DataFrame) -> DataFrame:
    """repo_id, source, target, kind of each relationship with both ends."""
    return _listed(docs, "$.relationships").select("repo_id", _ends(F.col("x")).alias("e")).select("repo_id", "e.*").filter("source is not null and target is not null")


def _rounds(most: int):
    """For rows (repo_id, locators, elements, links) the depths of the elements, or _NOWHERE. All graphs of a batch go through a round
    together; elements are numbered by row and name."""

    def run(batches):
        for b in batches:
            at, to = (pc.list_parent_indices(b[c]).to_numpy() for c in ("elements", "links"))
            links = pc.list_flatten(b["links"])
            source, target, kind = (pc.struct_field(links, f) for f in ("source", "target", "kind"))
            codes = pa.concat_arrays([source, target, pc.list_flatten(b["elements"])]).dictionary_encode()
            width = len(codes.dictionary) + 1
            keys = np.concatenate([to, to, at]) * width + codes.indices.fill_null(width - 1).to_numpy(zero_copy_only=False)
            _, node = np.unique(keys, return_inverse=True)
            source, target, element = node[: len(to)], node[len(to) : 2 * len(to)], node[2 * len(to) :]
            is_kind = lambda k: pc.fill_null(pc.equal(kind, k), False).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            depth = np.full(node.max(initial=0) + 1, _NOWHERE, np.int32)
            depth[target[is_kind("DESCRIBES")]] = 0
            source, target = source[is_kind("DEPENDS_ON")], target[is_kind("DEPENDS_ON")]
            n = 0
            while (new := (depth[source] == n) & (depth[target] == _NOWHERE)).any():
                n += 1
                if n > most:
                    raise RuntimeError(f"a dependency graph over {most} deep")
                depth[target[new]] = n
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(b["elements"]).to_numpy(zero_copy_only=False))]).astype(np.int32)
            depths = pa.ListArray.from_arrays(pa.array(ends), pa.array(depth[element], pa.int32()))
            yield pa.RecordBatch.from_arrays([b["repo_id"], b["elements"], b["locators"], depths], names=["repo_id", "elements", "locators", "depths"])

    return run


def _within(docs: DataFrame, most: int) -> DataFrame:
    """Packages but for the described ones, with depth, of repositories that have one document each; rows without a repository have no depths."""
    lists = docs.select("repo_id", F.try_variant_get("doc", "$.packages", "array<variant>").alias("ps"), F.when(F.col("repo_id").isNotNull(), F.try_variant_get("doc", "$.relationships", "array<variant>")).alias("rs"))
    empty = lambda c, of: F.coalesce(c, F.array().cast(f"array<{of}>"))
    links = F.filter(F.transform("rs", _ends), lambda e: e["source"].isNotNull() & e["target"].isNotNull())
    rows = lists.select(
        "repo_id",
        empty(F.transform("ps", lambda x: _text(x, "$.SPDXID")), "string").alias("elements"),
        empty(F.transform("ps", _locator), "string").alias("locators"),
        empty(links, "struct<source:string,target:string,kind:string>").alias("links"),
    )
    kind = docs.schema["repo_id"].dataType.simpleString()
    told = rows.mapInArrow(_rounds(most), f"repo_id {kind}, elements array<string>, locators array<string>, depths array<int>")
    each = told.select("repo_id", F.explode(F.arrays_zip("elements", "locators", "depths")).alias("x")).select("repo_id", F.col("x.elements").alias("element"), F.col("x.locators").alias("locator"), F.nullif("x.depths", F.lit(_NOWHERE)).alias("depth"))
    return _named(each.filter("depth is null or depth > 0"), "depth")


def _across(docs: DataFrame, most: int) -> DataFrame:
    """The same of repositories whose graphs lie in several documents."""
    links = _kept(relations(docs))
    roots = links.filter("kind = 'DESCRIBES'").select("repo_id", F.col("target").alias("element")).distinct()
    found = packages(docs).join(roots, ["repo_id", "element"], "left_anti")
    return found.join(depths(roots, links.filter("kind = 'DEPENDS_ON'"), most), ["repo_id", "element"], "left")


def depths(roots: DataFrame, edges: DataFrame, most: int = 256) -> DataFrame:
    """repo_id, element, depth: the least number of edges (repo_id, source, target) from any of the roots (repo_id, element), which have 0.

    Circles and repeated edges change nothing. Each round reads the edges once; only whether anything was reached comes to the driver.
    """
    edges = _kept(edges.select("repo_id", "source", "target").distinct())
    step = _kept(roots.select("repo_id", "element").distinct().withColumn("depth", F.lit(0)))
    reached = step
    for n in range(1, most + 2):
        ahead = step.select("repo_id", F.col("element").alias("source")).join(edges, ["repo_id", "source"])
        new = ahead.select("repo_id", F.col("target").alias("element")).distinct().join(reached, ["repo_id", "element"], "left_anti")
        step = _kept(new.withColumn("depth", F.lit(n)))
        if step.isEmpty():
            return reached
        if n > most:
            break
        reached = _kept(reached.union(step))
    raise RuntimeError(f"a dependency graph over {most} deep")


def _same(ecosystem: Column, name: Column) -> Column:
    """Names as they are compared: lower case, and of pypi with runs of separators as one hyphen."""
    return F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(F.lower(name))


def merged(docs: DataFrame, deps: DataFrame, manifest: str = "dependency-graph", most: int = 256) -> DataFrame:
    """Packages of documents (read_documents) that deps (repo_id, ecosystem, name) lack: repo_id, ecosystem, name, version, scope, manifest, depth.

    The described elements are the repository itself and no dependency of it. scope is runtime at depth 1, else transitive; an
    element that nothing leads to is transitive with a null depth. Of several elements of one name the one nearest the root counts,
    at one depth the smallest (name, version).
    """
    several = _kept(docs.filter("repo_id is not null").groupBy("repo_id").agg(F.count("*").alias("n")).filter("n > 1").select("repo_id"))
    if several.isEmpty():
        found = _within(docs, most)
    else:
        found = _within(docs.join(several, "repo_id", "left_anti"), most).unionByName(_across(docs.join(several, "repo_id", "left_semi"), most))
    folded = found.withColumn("same", _same(F.col("ecosystem"), F.col("name")))
    known = deps.select("repo_id", "ecosystem", _same(F.col("ecosystem"), F.col("name")).alias("same")).distinct()
    new = folded.join(known, ["repo_id", "ecosystem", "same"], "left_anti")
    order = F.struct(F.coalesce("depth", F.lit(1 << 30)), "name", F.coalesce("version", F.lit("")))
    one = new.groupBy("repo_id", "ecosystem", "same").agg(F.min_by(F.struct("name", "version", "depth"), order).alias("p"))
    scope = F.when(F.col("p.depth") == 1, "runtime").otherwise("transitive")
    return one.select("repo_id", "ecosystem", "p.name", "p.version", scope.alias("scope"), F.lit(manifest).alias("manifest"), "p.depth")
