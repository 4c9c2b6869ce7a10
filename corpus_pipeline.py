"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

quality   drops documents that the classifier rejects
near      keeps one document of each class of near-duplicates, the one with the smallest doc_id
pii       replaces personal data by its kind
mixing    repeats or drops documents until sources have their target weights
packing   packs what is left into sequences of permitted lengths (the result: pieces with their bins)

Every stage takes null ids, texts and sources, empty tables, texts of any length, repeated rows and extra columns. Extra columns
pass through all stages but the last; columns whose names start with two underscores are reserved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamline.llm.common import n_words, stash, table
from loamline.llm.mixing import mix
from loamline.llm.near_dedup import near_duplicates
from loamline.llm.packing import best_fit
from loamline.llm.pii import redact
from loamline.llm.quality import learn, measured, sampled, statistics


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a score of 0.3 or more (a predicted label of 1). The model learns from labelled rows of this input, at most
    `sampled`'s bound of them, so that statistics are computed once for most texts. The text is scored where it is read, so that
    it is not shuffled. Null text is scored as empty text; without labels every row stays, as the score is 0.5."""
    labels = sampled(table(spark, sf_dir, "labels"))
    model = learn(measured(docs.join(F.broadcast(labels.select("doc_id").distinct()), "doc_id", "left_semi")), labels)

    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack([statistics(t) for t in text])) if len(text) else [], dtype=float)

    return docs.filter(good(F.coalesce("text", F.lit("")).cast("binary")) >= 0.3)


def _identity() -> Column:
    """A number for doc_id and text together: rows that repeat a doc_id with unlike texts are documents of their own."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of the smallest doc_id (null last), then the smallest identity. Rows alike in doc_id and text are one
    document; rows that repeat a doc_id with another text are another. Null and blank texts are in no class but their own."""
    ids = docs.select(_identity().alias("__id"), F.col("doc_id").alias("__doc")).groupBy("__id").agg(F.min("__doc").alias("__doc"), F.count("*").alias("__n"))
    classes = near_duplicates(docs.select(_identity().alias("doc_id"), "text")).select(F.col("doc_id").alias("__id"), "class_id").distinct()
    best = F.min_by(F.struct("__id", "__n"), F.struct(F.col("__doc").isNull(), "__doc", "__id"))
    kept = stash(classes.join(ids, "__id").groupBy("class_id").agg(best.alias("best")).select("best.*"))
    rows = docs.withColumn("__id", _identity()).join(kept.hint("shuffle_hash"), "__id")
    again = rows.filter("__n > 1").withColumn("__row", F.row_number().over(W.partitionBy("__id").orderBy("text"))).filter("__row = 1")
    return rows.filter("__n = 1").select(docs.columns).union(again.select(docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced; n_chars counts the new text. Null text stays null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as many times as the mix holds it; texts without words are in no mix. Null sources are one source.

    The plan holds one row for rows alike in doc_id, source and size: the lower of their copies, and how many of them have one more.
    Texts move once, to meet the plan; which of rows alike have more is settled in the order of their texts."""
    key = lambda size: F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), size.alias("size")).alias("__key")
    plan = mix(docs).groupBy(key(F.col("size"))).agg(F.min("copies").alias("__least"), F.max("copies").alias("__most"), F.sum("copies").alias("__all"), F.count("*").alias("__n")).filter("__most > 0")
    rows = docs.withColumn("__key", key(n_words("text"))).join(stash(plan).hint("shuffle_hash"), "__key")
    alike = rows.filter("__least = __most").withColumn("__copies", F.col("__most"))
    more = F.col("__all") - F.col("__n") * F.col("__least")  # copies differ by one at most: these rows have __most
    nth = F.row_number().over(W.partitionBy("__key").orderBy("text"))
    unlike = rows.filter("__least < __most").withColumn("__copies", F.when(nth <= more, F.col("__most")).otherwise(F.col("__least")))
    taken = alike.unionByName(unlike).filter("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their bins, as best_fit returns them: a row for each piece of each row; texts without words are in no bin."""
    return best_fit(docs)


STAGES = [("quality", quality), ("near", near), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: The stages learn models and hash texts: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; every stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
