"""The keys of the search box, bound to columns of the inventory's tables, and the restriction of rows by them.

A key that looks into a table of its own (dependencies, findings, ...) is a semi-join on the rows of that table that fit,
a negated one an anti-join: the tests reach the scans, and no repository's lists are gathered into one row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import facets


@dataclass(frozen=True)
class Key:
    """Where the values of a key stand: (table, expression of a value, column with the item's id); no table is the item's own row.

    `present` keys are asked with yes and no: does the table hold any row of the item? `least` keys are thresholds.
    """

    sources: tuple[tuple[str, str, str], ...]
    exact: bool = True
    least: bool = False
    present: bool = False


def _own(*expressions: str, **options) -> Key:
    return Key(tuple(("", e, "") for e in expressions), **options)


def _in(table: str, expression: str = "true", item: str = "repo_id", **options) -> Key:
    return Key(((table, expression, item),), **options)


#: The names of the keys of repositories.
REPO_KEYS = {
    "lang": _own("primary_language"),
    "anylang": _in("repo_languages", "language"),
    "fw": _in("repo_tech", "if(category = 'frameworks', name, null)"),
    "data": _in("repo_tech", "if(category in ('data', 'databases', 'messaging'), name, null)"),
    "infra": _in("repo_tech", "if(category in ('cloud', 'infrastructure'), name, null)"),
    "tech": Key((("repo_tech", "name", "repo_id"), ("repo_languages", "language", "repo_id"), ("dependencies", "if(scope <> 'transitive', name, null)", "repo_id")), exact=False),
    "type": _own("repo_type"),
    "grade": _own("practices_grade"),
    "cap": _in("repo_capabilities", "name"),
    "topic": _in("repo_topics", "topic"),
    "owner": Key((("", "owner", ""), ("", "declared_owner", ""), ("code_owners", "owner", "repo_id")), exact=False),
    "lifecycle": _own("lifecycle"),
    "ai": _in("ai_assets", present=True),
    "uses": Key((("sdk_usage", "sdk", "repo_id"), ("model_usage", "model", "repo_id"), ("ai_assets", "ecosystem", "repo_id"))),
    "missing": _in("practice_checks", "if(passed, null, check)"),
    "has": _in("practice_checks", "if(passed, check, null)"),
    "is": _own("if(archived, 'archived', null)", "if(fork, 'fork', null)", "if(is_monorepo, 'monorepo', null)", "visibility"),
    "minscore": _own("practices_score", least=True),
    "flag": _in("flags", "flag_id"),
    "sev": _in("flags", "severity"),
    "reuse": _in("reusables", "kind"),
    "usedby": _in("repo_links", item="depends_on", present=True),
    "dep": _in("dependencies", "if(scope <> 'transitive', name, null)"),
    "depeco": _in("dependencies", "ecosystem"),
    "vuln": _in("vulnerable_dependencies", present=True),
}
#: The names of the keys of assets.
ASSET_KEYS = {
    "kind": _own("kind"),
    "eco": _own("ecosystem"),
    "repo": _own("repo", "split_part(repo, '/', 2)"),
    "tool": _in("asset_tools", "tool", "id"),
    "model": _in("asset_models", "model", "id"),
    "tag": Key((("asset_tags", "tag", "id"), ("", "category", ""))),
    "conf": _own("confidence"),
    "scope": _own("scope"),
    "dup": _own("if(coalesce(duplicate_count, 0) > 0, 'yes', 'no')"),
    "minq": _own("quality_score", least=True),
    "flag": _in("asset_flags", "flag_id", "id"),
    "sev": _in("asset_flags", "severity", "id"),
}
#: The names of the keys of building blocks.
BLOCK_KEYS = {
    "kind": _own("kind"),
    "repo": _own("repo", "split_part(repo, '/', 2)"),
    "lang": _own("primary_language"),
    "format": _own("split_part(coalesce(format, engine, using, ''), ' ', 1)"),
    "grade": _own("practices_grade"),
    "lifecycle": _own("lifecycle"),
}


def _fits(value: str, key: Key) -> Column | None:
    """The test of a value on the item's own row, or null if the key has nothing there."""
    own = [F.expr(e) for table, e, _ in key.sources if not table]
    if key.least:
        return facets.at_least(own[0], value)
    test = facets.value_test(value, key.exact)
    return reduce(or_, [F.coalesce(test(e), F.lit(False)) for e in own]) if own else None


def _ids(key: Key, values: list[str], tables: dict[str, DataFrame], item: str) -> DataFrame | None:
    """Ids of items for which a table of its own holds one of the values; null if the key has no such table."""
    found = None
    for table, expression, column in key.sources:
        if table:
            tests = [F.coalesce(facets.value_test(v, key.exact)(F.expr(expression)), F.lit(False)) for v in values]
            one = tables[table].filter(reduce(or_, tests)).select(F.col(column).alias(item))
            found = one if found is None else found.union(one)
    return found


def _one(items: DataFrame, key: Key, values: list[str], tables: dict[str, DataFrame], item: str, negated: bool) -> DataFrame:
    """The items that hold one of the values of a key, or those that hold none."""
    how = "left_anti" if negated else "left_semi"
    if key.present:
        (table, _, column), said = key.sources[0], {a for a in ("yes", "no") for v in values if facets.spelt_like(a, v, key.exact)}
        if len(said) != 1:
            return items.filter(F.lit(bool(said) != negated))
        holders = tables[table].select(F.col(column).alias(item))
        return items.join(holders, item, "left_semi" if (said == {"yes"}) != negated else "left_anti")
    own = [t for t in (_fits(v, key) for v in values) if t is not None]
    test = reduce(or_, own) if own else None
    elsewhere = _ids(key, values, tables, item)
    if elsewhere is None:
        return items.filter(~test if negated else test)
    if test is not None:
        elsewhere = elsewhere.union(items.filter(test).select(item))
    return items.join(elsewhere, item, how)


def restrict(items: DataFrame, query: str, keys: dict[str, Key], tables: dict[str, DataFrame], item: str = "repo_id", text: tuple[str, ...] = ()) -> DataFrame:
    """The items that a `key:value` query lets through; free words must all stand in the `text` columns.

    Values of one key are alternatives, keys are all required, negated values all excluded; an item without a value holds none.
    """
    request = facets.read(query, set(keys))
    wanted: dict[str, list[str]] = {}
    for f in request.filters:
        if f.negated:
            items = _one(items, keys[f.key], [f.value], tables, item, True)
        else:
            wanted.setdefault(f.key, []).append(f.value)
    for name, values in wanted.items():
        items = _one(items, keys[name], values, tables, item, False)
    words = F.lower(F.concat_ws(" ", *text)) if text else None
    for word in request.text.lower().split() if text else []:
        items = items.filter(F.contains(words, F.lit(word)))
    return items
