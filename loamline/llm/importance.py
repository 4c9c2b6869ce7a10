"""Importance resampling towards a target distribution of hashed n-grams.

Every text is a row of a sparse matrix: counts of its word 1-, 2- and 3-grams by hashed bucket. The matrix is written as CSR blocks,
one Parquet row for a block of documents. Column sums give the distributions of the corpus and of the target, their ratio
gives each bucket a gain, and the product of the matrix with the gains gives each document its weight. Gumbel noise from a hash of
doc_id turns the highest scores into a sample without replacement that every run repeats.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import earlier, small_batches, small_bytes, spread, stash

BUCKETS = 10_000
#: Bytes of words: digits, letters and whatever is not ASCII. A-Z become a-z, all other ASCII bytes a blank.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Columns of a CSR block, each the bytes of a numpy array: a Parquet reader would unfold Spark arrays of this length in memory.
_TYPES = {"doc_id": "<i8", "known": "?", "n_words": "<i4", "start": "<i4", "bucket": "<u2", "count": "u1"}
_MOST = 255  # of a count; what a bucket has beyond it stands in further entries
#: A reader holds a row group as written, unfolded and as rows at once, and rows of this size fill the writer's default of 128 MB.
_GROUPS = {"parquet.block.size": 2 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8, "parquet.enable.dictionary": "false"}
_CSR = ", ".join(f"{name} binary" for name in _TYPES)


class _Words(dict):
    """CRC-32 and length of a word, packed into one number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(word) << 32 | zlib.crc32(word)
        return value


def _zeros_after(length: int) -> np.ndarray:
    """Four tables of 256 values: what each byte of a CRC-32 register becomes after `length` zero bytes. The CRC of two strings
    one after another is that of the first, so moved, xor that of the second."""
    still = zlib.crc32(bytes(length))
    moved = [zlib.crc32(bytes(length), 1 << bit) ^ still for bit in range(32)]
    table = np.zeros((4, 256), np.uint32)
    for bit, value in enumerate(moved):
        byte, place = divmod(bit, 8)
        table[byte] ^= np.where(np.arange(256) >> place & 1, np.uint32(value), np.uint32(0))
    return table


class _Joiner:
    """CRC-32 of strings one after another, from the CRCs of both and the length of the second."""

    def __init__(self, most: int = 256):
        self.tables, self.most = np.stack([_zeros_after(n) for n in range(most)]), most

    def join(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        short = np.minimum(length, self.most - 1)
        out = b.copy()
        for byte in range(4):
            out ^= self.tables[short, byte, a >> np.uint32(8 * byte) & np.uint32(255)]
        for i in np.flatnonzero(length >= self.most):  # words of hundreds of bytes, each on its own
            table = _zeros_after(int(length[i]))
            out[i] = b[i] ^ np.bitwise_xor.reduce([table[k, int(a[i]) >> 8 * k & 255] for k in range(4)])
        return out


def grams(words: np.ndarray, owner: np.ndarray, joiner: _Joiner) -> tuple[np.ndarray, np.ndarray]:
    """(owner, CRC-32) of all runs of one to three packed words that lie in one document."""
    crc, size = (words & 0xFFFFFFFF).astype(np.uint32), words >> 32
    blank = np.full(1, zlib.crc32(b" "), np.uint32)
    owners, found, run = [owner], [crc], crc
    for n in (1, 2):
        if len(words) <= n:
            break
        spaced = joiner.join(run[:-1], np.repeat(blank, len(run) - 1), np.ones(len(run) - 1, np.int64))
        run = joiner.join(spaced, crc[n:], size[n:])
        inside = owner[n:] == owner[:-n]
        owners.append(owner[n:][inside])
        found.append(run[inside])
    return np.concatenate(owners), np.concatenate(found)


def _blocks(remember: int = 100_000, chunk: int = 20_000):
    """CSR blocks of about `chunk` words, but for single longer texts."""

    def block(ids: list, texts: list[list[int]], joiner: _Joiner) -> pd.DataFrame:
        words = np.fromiter((w for t in texts for w in t), np.int64)
        owner, crc = grams(words, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), joiner)
        at, count = np.unique(owner * BUCKETS + crc % np.uint32(BUCKETS), return_counts=True)
        times = -(-count // _MOST)
        at, count = np.repeat(at, times), np.repeat(count, times) - _MOST * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        start = np.searchsorted(at, np.arange(len(texts) + 1) * BUCKETS)
        row = ([0 if pd.isna(i) else int(i) for i in ids], [not pd.isna(i) for i in ids], [len(t) for t in texts], start, at % BUCKETS, np.minimum(count, _MOST))
        return pd.DataFrame({name: [np.asarray(x).astype(kind).tobytes()] for (name, kind), x in zip(_TYPES.items(), row)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        joiner, known, ids, texts, size = _Joiner(), _Words(), [], [], 0
        for b in batches:
            for doc, text in zip(b.doc_id, b.text):
                ids.append(doc)
                texts.append([known[w] for w in text.translate(_WORD_BYTES).split()])
                size += len(texts[-1])
                if size >= chunk or len(ids) >= 5000:
                    yield block(ids, texts, joiner)
                    ids, texts, size = [], [], 0
                    if len(known) > remember:
                        known.clear()
        if ids:
            yield block(ids, texts, joiner)

    return run


def csr(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) as written CSR blocks: in each, documents with their number of words, where their counts start, and buckets
    with counts. Null text is empty; ids pass as strings, since a null would turn longs into doubles."""
    small_batches(texts.sparkSession)
    small_bytes(texts.sparkSession)
    rows = texts.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return stash(rows.mapInPandas(_blocks(), _CSR), **_GROUPS)


def _arrays(blocks: pd.DataFrame) -> Iterator[list[np.ndarray]]:
    """The columns of each block as numpy arrays."""
    for row in zip(*(blocks[name] for name in blocks.columns)):
        yield [np.frombuffer(x, _TYPES[name]) for name, x in zip(blocks.columns, row)]


def column_sums(blocks: DataFrame) -> np.ndarray:
    """The sum of each bucket's counts over all documents: summed in tasks first, so that a row per bucket and task moves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for bucket, count in _arrays(b):
                total += np.bincount(bucket, count, BUCKETS).astype(np.int64)
        yield pd.DataFrame({"bucket": np.arange(BUCKETS), "n": total})

    sums = np.zeros(BUCKETS, np.int64)
    rows = blocks.select("bucket", "count").mapInPandas(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # a row per bucket, whatever the input
        sums[r.bucket] = r.n
    return sums


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored, by bucket."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document: the sparse matrix times the gains."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, known, n_words, start, bucket, count in _arrays(b[list(_TYPES)]):
                sums = [np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (count, count * gain[bucket])]
                n, w = (x[start[1:]] - x[start[:-1]] for x in sums)
                yield pd.DataFrame({"doc_id": [str(i) if k else None for i, k in zip(ids, known)], "n_words": n_words, "n_features": n, "weight": w})

    return blocks.mapInPandas(run, "doc_id string, n_words int, n_features long, weight long").withColumn("doc_id", F.col("doc_id").cast("long"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of docs (doc_id, text); rank is null for what is not drawn.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) of the highest scores are drawn, ties to the smaller
    doc_id, and ranked from 1. Null text has no words, weight 0 and a score; a null doc_id counts as empty text in the hash and
    comes after others in ties. Rows that repeat are rows of their own, with the same score. An empty target has a share of
    one for each bucket. Texts of any length are counted whole, extra columns are not read. What reaches the driver is one row per bucket,
    and one per partition of the ranked rows stays in a window.
    """
    blocks = csr(docs)
    gain = gains(column_sums(blocks), column_sums(csr(target)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = stash(weights(blocks, gain))  # the range sort reads its rows twice
    rows = rows.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("fits", F.col("n_words") >= least_words)
    rows = spread(rows, F.desc("fits"), F.desc("score"), F.col("doc_id").asc_nulls_last())
    drawn = rows.filter("fits").count() * percent // 100
    before = earlier(rows.withColumn("one", F.col("fits").cast("long")), before="one")
    within = F.row_number().over(W.partitionBy("part").orderBy(F.desc("fits"), F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = rows.withColumn("within", within).join(F.broadcast(before), "part")
    rank = (F.col("before") + F.col("within")).cast("long")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("fits") & (rank <= drawn), rank).alias("rank"))
