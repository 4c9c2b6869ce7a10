"""key:value filters over list columns, and the facet counts that belong to them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PART = re.compile(r'(-?)([A-Za-z]+):(?:"([^"]*)"|(\S*))|"([^"]*)"|(\S+)')


@dataclass
class Filter:
    key: str
    value: str
    negated: bool = False


@dataclass
class Request:
    text: str = ""
    filters: list[Filter] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)


def read(query: str, known: set[str]) -> Request:
    """Filters and free text of a query; parts with an unknown key are free text as well."""
    out, words = Request(), []
    for minus, key, quoted, plain, phrase, word in _PART.findall(query):
        value = (quoted or plain).strip()
        if not key:
            words.append(phrase or word)
        elif key.lower() not in known:
            out.unknown.append(key.lower())
            words.append(f"{minus}{key}:{value}")
        elif value:
            out.filters.append(Filter(key.lower(), value, minus == "-"))
    out.text = " ".join(words)
    return out


def value_test(value: str, exact: bool = False) -> Callable[[Column], Column]:
    """The test of one value without regard to case: =v is the whole value, v* a prefix, else a substring (exact keys: the whole)."""
    value = value.lower()
    if value.startswith("="):
        return lambda x: F.lower(x) == value[1:]
    if value.endswith("*") and len(value) > 1:
        return lambda x: F.startswith(F.lower(x), F.lit(value[:-1]))
    if exact:
        return lambda x: F.lower(x) == value
    return lambda x: F.contains(F.lower(x), F.lit(value))


def spelt_like(word: str, value: str, exact: bool = False) -> bool:
    """The same test on a word that is known already."""
    value = value.lower()
    if value.startswith("="):
        return word == value[1:]
    if value.endswith("*") and len(value) > 1:
        return word.startswith(value[:-1])
    return word == value if exact else value in word


def matches(column: Column, value: str, exact: bool = False) -> Column:
    """Does a list column hold the value?"""
    return F.coalesce(F.exists(column, value_test(value, exact)), F.lit(False))


def at_least(column: Column, value: str) -> Column:
    """A threshold; a value that is no number filters nothing."""
    try:
        return F.coalesce(column >= float(value), F.lit(False))
    except ValueError:
        return F.lit(True)


def predicate(filters: list[Filter], lists: dict[str, Column], numbers: dict[str, Column] | None = None, exact: set[str] = frozenset()) -> Column:
    """Values of one key are alternatives, keys are all required, negated values all excluded."""
    numbers = numbers or {}

    def one(f: Filter) -> Column:
        return at_least(numbers[f.key], f.value) if f.key in numbers else matches(lists[f.key], f.value, f.key in exact)

    keys: dict[str, list[Column]] = {}
    for f in filters:
        if not f.negated:
            keys.setdefault(f.key, []).append(one(f))
    needed = [reduce(lambda a, b: a | b, tests) for tests in keys.values()]
    return reduce(lambda a, b: a & b, needed + [~one(f) for f in filters if f.negated], F.lit(True))


def facet_counts(items: DataFrame, column: str, item_id: str = "id") -> DataFrame:
    """value, n: how many items hold each value, without regard to case, spelt as it came first; an item counts once."""
    each = items.select(item_id, F.posexplode(column).alias("place", "spelt")).filter("spelt <> ''")
    once = each.groupBy(F.lower("spelt").alias("folded"), item_id).agg(F.min_by("spelt", "place").alias("spelt"))
    return once.groupBy("folded").agg(F.min_by("spelt", item_id).alias("value"), F.count("*").alias("n")).select("value", "n")


def insights(repos: DataFrame) -> DataFrame:
    """Headline numbers: repositories, live ones, mean score rounded, share with a good score."""
    return repos.agg(
        F.count("*").alias("repos"),
        F.count_if(~F.col("archived")).alias("live"),
        F.round(F.avg("practices_score"), 0).cast("long").alias("mean_score"),
        F.round(100.0 * F.count_if(F.col("practices_score") >= 70) / F.count("*"), 0).cast("long").alias("good_percent"),
    )
