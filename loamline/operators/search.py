"""Ranked full-text search over tables: prefix terms, weighted BM25, and the AND, OR, substring ladder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Column weights of the two searchable tables.
REPO_WEIGHTS = {"name": 8.0, "description": 4.0, "summary": 3.0, "readme": 1.0, "tech": 3.0, "capabilities": 4.0, "topics": 3.0}
ASSET_WEIGHTS = {"name": 8.0, "description": 4.0, "summary": 4.0, "use_cases": 4.0, "content": 1.0, "tags": 3.0}


def terms(query: str) -> list[str]:
    """Prefix terms of a query: lower case, over one letter, of the first twelve the distinct ones in order."""
    found = [t for t in re.split(r"[^\w]+", query.lower()) if len(t) > 1]
    return list(dict.fromkeys(found[:12]))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def postings(table: DataFrame, columns: list[str]) -> DataFrame:
    """token, id, column, tf: the inverted index of a table, to be written once and filtered by token ranges after."""
    each = None
    for c in columns:
        one = table.select("id", F.lit(c).alias("column"), F.explode(tokens(F.col(c))).alias("token"))
        each = one if each is None else each.union(one)
    return each.groupBy("token", "id", "column").agg(F.count("*").alias("tf"))


def _counted(table: DataFrame, words: list[str], weights: dict[str, float]) -> DataFrame:
    """id, length and, for each term, the weighted frequency of tokens that start with it: one scan, nothing exploded."""
    have = {c: w for c, w in weights.items() if c in table.columns}
    toks = table.select("id", *[F.explode(F.array(tokens(F.col(c)))).alias(c) if i == 0 else tokens(F.col(c)).alias(c) for i, c in enumerate(have)])
    length = sum((F.size(c) for c in have), F.lit(0)).alias("length")

    def starting(column: str, term: str) -> Column:
        return F.size(F.filter(column, lambda x: F.startswith(x, F.lit(term))))

    freq = [sum((F.lit(w) * starting(c, t) for c, w in have.items()), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(words)]
    return toks.select("id", length, *freq)


def bm25(table: DataFrame, query: str, weights: dict[str, float], mode: str = "AND") -> DataFrame:
    """id, rank of the rows with all (AND) or any (OR) of the query's prefix terms; smaller is better.

    Okapi form with k1 = 1.2 and b = 0.75, rounded to 6 digits. A term's document frequency counts rows with any token of
    that prefix. Two scans: one row of totals goes to the driver, then rows are scored where they are read.
    """
    words = terms(query)
    counted = _counted(table, words, weights)
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))]).first()
    score, hit = F.lit(0.0), None
    norm = K1 * (1 - B + B * F.col("length") / F.lit(float(stats.avg or 1.0)))
    for i in range(len(words)):
        d = stats[f"d{i}"]
        idf = F.greatest(F.log(F.lit((stats.n - d + 0.5) / (d + 0.5))), F.lit(1e-6))
        f = F.col(f"f{i}")
        score = score - idf * f * (K1 + 1) / (f + norm)
        here = f > 0
        hit = here if hit is None else (hit & here if mode == "AND" else hit | here)
    return counted.filter(hit).select("id", F.round(score, 6).alias("rank"))


def search(table: DataFrame, query: str, weights: dict[str, float], like_columns: list[str], order: list[Column], limit: int = 20) -> DataFrame:
    """Rows of table with a rank: all terms, else any term, else the query as a substring; an empty query lists in `order`.

    The rank is null where rows were not ranked. Ties go to the smaller id.
    """
    query, limit = query.strip(), max(1, min(limit, 100))
    unranked = lambda rows: rows.withColumn("rank", F.lit(None).cast("double")).orderBy(*order, "id").limit(limit)
    if not query:
        return unranked(table)
    if terms(query):
        for mode in ("AND", "OR"):
            hits = bm25(table, query, weights, mode)
            if not hits.isEmpty():
                best = hits.orderBy("rank", "id").limit(limit)
                return table.join(F.broadcast(best), "id").orderBy("rank", "id")
    contains = None
    for c in like_columns:
        one = F.contains(F.lower(c), F.lit(query.lower()))
        contains = one if contains is None else contains | one
    return unranked(table.filter(contains))


def fuzzy_terms(table: DataFrame, column: str, query: str, share: float = 0.15) -> DataFrame:
    """term, token, distance: vocabulary within a Levenshtein distance of round(share * length) of each query term."""
    vocabulary = table.select(F.explode(F.array_distinct(tokens(F.col(column)))).alias("token")).groupBy("token").agg(F.count("*").alias("docs"))
    near = None
    for t in terms(query):
        most = int(share * len(t) + 0.5)
        size = F.length("token")
        fit = vocabulary.filter((size >= len(t) - most) & (size <= len(t) + most))
        one = fit.select(F.lit(t).alias("term"), "token", "docs", F.levenshtein(F.lit(t), F.col("token")).alias("distance")).filter(F.col("distance") <= most)
        near = one if near is None else near.union(one)
    return near


def building_blocks(blocks: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Blocks whose name, description, repository, path and details hold every word of the query (the first eight)."""
    text = F.lower(F.concat_ws(" ", *[c for c in ("name", "description", "repo", "path", "details") if c in blocks.columns]))
    hits = blocks
    for word in query.lower().split()[:8]:
        hits = hits.filter(F.contains(text, F.lit(word)))
    return hits.orderBy("archived", F.desc("practices_score"), "kind", "name", "repo").limit(max(1, min(limit, 100)))
