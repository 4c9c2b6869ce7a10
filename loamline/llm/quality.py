"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class of labels.quality is a Gaussian over about twenty statistics of the text, transformed towards symmetry. Its
covariance is shrunk towards the pooled variances; its inverse Cholesky factor is computed once and cached with the model,
so that a score is the difference of two Mahalanobis log densities, a matrix product for each batch. Class sums and
products are gathered from all labelled training rows by one aggregation.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, small_batches, stash, word_hashes, word_spans

FEATURES = (
    "words", "characters", "word_length", "word_length_spread", "distinct_words", "top_word", "upper_case", "digits", "punctuation",
    "bare_symbols", "lines", "repeated_lines", "sentence_words", "distinct_pairs", "byte_entropy", "short_words", "marked_words", "capitalised", "spaces", "long_line",
)
_CLASS = np.zeros(256, np.uint8)  # 1 lower or other letter byte, 2 upper case, 3 digit, 4 punctuation, 5 space
_CLASS[33:127] = 4
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 3, 2, 1
_CLASS[128:] = 1
_CLASS[[32, 9, 10, 11, 12, 13]] = 5
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?|")] = True
_END = re.compile(rb"[.!?]+(?=\s|$)")


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one whole text; an empty text has defined values too."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(text)
    n, size = len(starts), len(text)
    kinds = _CLASS[raw]
    kind_counts = np.bincount(kinds, minlength=6).astype(float)
    octets = np.bincount(raw, minlength=256)
    octets = octets[octets > 0] / max(size, 1)
    hashes = word_hashes(text)
    _, counts = np.unique(hashes, return_counts=True)
    lengths = (ends - starts).astype(float) if n else np.zeros(1)
    marks = np.concatenate([[0], np.cumsum(kinds == 4)])
    bare = (marks[ends] - marks[starts] == ends - starts).sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(np.unique(gram_hashes(hashes, 2)))
    share = lambda x, of: np.sqrt(x / max(of, 1))
    return np.array([
        np.log1p(n), np.log1p(size), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(counts) / max(n, 1) ** 0.9, share(counts.max(initial=0), n),
        share(kind_counts[2], size), share(kind_counts[3], size), share(kind_counts[4], size), share(bare, n),
        np.log1p(len(lines) / max(n, 1) * 20), share(len(lines) - len(set(lines)), len(lines)), np.log1p(n / (len(_END.findall(text)) + 1)), pairs / max(n - 1, 1), -(octets * np.log(octets)).sum() if size else 0.0,
        share((lengths <= 3).sum(), n), share(_MARK[raw[ends - 1]].sum(), n), share((kinds[starts] == 2).sum(), n), share(kind_counts[5], size), np.log1p(max(map(len, lines), default=0)) / np.log(size + 3),
    ])


@dataclass
class Model:
    """Class means and cached inverse Cholesky factors over standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offset: float
    temper: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        d = [(((z - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip(self.temper * ((d[0] - d[1]) / 2 + self.offset), -30, 30)))


def fit(moments: dict[int, np.ndarray], shrink: float = 0.05, floor: float = 0.05, temper: float = 0.1) -> Model:
    """A model from each class's sum of outer products of (1, statistics)."""
    width = len(FEATURES) + 1
    total = sum(moments.values(), np.zeros((width, width)))
    n = max(total[0, 0], 1.0)
    centre = total[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(total)[1:] / n - centre**2, 1e-6))
    means, factors, logs, counts = [], [], [], []
    for c in (0, 1):
        m = moments.get(c, np.zeros((width, width)))
        k = max(m[0, 0], 1.0)
        mean = m[0, 1:] / k if m[0, 0] else centre
        cov = (m[1:, 1:] / k - np.outer(mean, mean) if m[0, 0] > 1 else np.zeros((width - 1, width - 1))) / np.outer(scale, scale)
        cov = (1 - shrink) * cov + shrink * np.eye(width - 1) + floor * np.eye(width - 1)
        chol = np.linalg.cholesky(cov)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(chol))
        logs.append(np.log(np.diag(chol)).sum())
        counts.append(m[0, 0] + 1)
    return Model(centre, scale, means, factors, logs[0] - logs[1] + np.log(counts[1] / counts[0]), temper)


def _measure(batches):
    for b in batches:
        yield pd.DataFrame({"doc_id": b.doc_id, "x": [statistics(t) for t in b.text]})


def _moments(batches):
    width = len(FEATURES) + 1
    sums = {}
    for b in batches:
        for q, g in b.groupby("quality"):
            x = np.column_stack([np.ones(len(g)), np.stack(g.x.to_list())])
            sums[q] = sums.get(q, 0) + x.T @ x
    for q, m in sums.items():
        yield pd.DataFrame({"quality": q, "at": np.arange(width * width), "v": m.reshape(-1)})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, x, held_out for each row: ids go as strings, since a null would turn longs into doubles."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInPandas(_measure, "doc_id string, x array<double>")
    return rows.select(F.col("doc_id").cast("long"), "x", F.coalesce(F.crc32(F.col("doc_id").cast("binary")) % 5 == 0, F.lit(True)).alias("held_out"))


def sampled(labels: DataFrame, most: int = 20_000) -> DataFrame:
    """At most `most` labelled rows that may be learned from, in the order of a hash of doc_id: bounded, whatever the input, and the
    same in every run. `most` is the documented bound on the sample that a model is fitted on."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return stash(known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most))


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows that are not held out; labels other than 0 and 1 and null ids are left aside."""
    marks = labels.filter("quality in (0, 1)").select("doc_id", "quality")
    known = rows.filter(~F.col("held_out")).join(marks, "doc_id").select("quality", "x")
    found = known.mapInPandas(_moments, "quality int, at int, v double").groupBy("quality", "at").agg(F.sum("v").alias("v")).toPandas()
    width = len(FEATURES) + 1
    return fit({int(q): g.sort_values("at").v.to_numpy().reshape(width, width) for q, g in found.groupby("quality")})


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    score is the probability, from 0 to 1, that the text has label 1; predicted is 1 from `threshold` on. Null text is
    empty text, and scored. Only text is an input of a score. Rows whose crc32(doc_id as text) is divisible by 5, and
    those without doc_id, are held out and never learned from. Without labels every score is 0.5.
    """
    rows = stash(measured(docs))
    model = learn(rows, labels)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list())) if len(x) else [], dtype=float)

    out = rows.select("doc_id", "held_out", scored("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
