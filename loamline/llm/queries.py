"""The registered queries of this package and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, importance, toxicity
from .common import table
from .licenses import scan
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import best_fit
from .pii import detect
from .quality import score
from .substring_dedup import remove_repeats
from .url_filter import judge, rule_table
from .vectors import exact_top, nearest


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_exact_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", moved))


def op13_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), target)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_bestfit_packing": op2_bestfit_packing,
    "op3_pii": op3_pii,
    "op4_vector_neighbours": op4_vector_neighbours,
    "op5_source_mixing": op5_source_mixing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_exact_top": op8_exact_top,
    "op9_near_dedup": op9_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_importance_sampling": op13_importance_sampling,
}
ORACLES: dict[str, str] = {}

ORACLES["op8_exact_top"] = """
WITH good AS (
  SELECT vec_id, min(embedding) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), ints AS (
  SELECT vec_id, len(v) AS d, generate_subscripts(v, 1) AS pos, floor(256 * unnest(v)::DOUBLE)::BIGINT AS x FROM good
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, sum(q.x * v.x)::BIGINT AS score
  FROM ints q JOIN ints v ON q.pos = v.pos AND q.d = v.d AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op7_url_filter"] = """
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

ORACLES["op12_hard_negatives"] = """
WITH good AS (
  SELECT vec_id, min({'x': embedding, 'label': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END}) AS r FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id
), ints AS (
  SELECT vec_id, r.label AS label, len(r.x) AS d, generate_subscripts(r.x, 1) AS pos, floor(256 * unnest(r.x)::DOUBLE)::BIGINT AS x FROM good
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, v.vec_id, v.label AS vl, sum(a.x * v.x)::BIGINT AS score
  FROM ints a JOIN ints v ON a.pos = v.pos AND a.d = v.d AND a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE al = vl
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.al <> s.vl AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
