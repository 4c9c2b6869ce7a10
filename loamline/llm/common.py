"""Shared helpers: table access, stashing between jobs, word hashing, connected classes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word separators used throughout: space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a folder of our own in local mode (tests); a cluster's
    executors would not see it, so there it is an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loamline-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def stash(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write to the shared folder and read back, so that lineage is cut and a lost executor costs no recomputation. A given
    path is written over; options are the Parquet writer's."""
    path = path or f"{shared_dir(df.sparkSession)}/stash/{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most `rows` rows where the session has Spark's default, which holds 10000 texts at a time in the
    executor's JVM and in Python. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def small_bytes(spark: SparkSession) -> None:
    """Arrow batches of 8 MB where the session has Spark's default of 64 MB, for rows that each hold a large block: a batch is held
    several times over. Results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("64MB", "67108864b"):
        spark.conf.set(key, "8MB")


def spread(df: DataFrame, *order) -> DataFrame:
    """df stashed in the order of the columns, with the number `part` of the partition that holds the row: every row of
    a part comes before every row of a later one, so that ranks and running sums need windows within parts only."""
    return stash(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))


def earlier(rows: DataFrame, **sums) -> DataFrame:
    """part and, for each name, the sum of its column over all earlier parts: one row for each part of spread's rows."""
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return totals.select("part", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name) for name in sums])


def n_words(text) -> F.Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols, seed: int = 0) -> F.Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


# ---------------------------------------------------------------- word hashing in tasks (numpy, whole texts)

_U = np.uint64
_BYTE_BASE, _GRAM_BASES = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length())
        up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit affects every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: bytes) -> np.ndarray:
    starts, ends = word_spans(text)
    if not len(starts):
        return np.empty(0, _U)
    up, down = powers(_BYTE_BASE, len(text) + 1)
    total = np.zeros(len(text) + 1, _U)
    np.cumsum((np.frombuffer(text, np.uint8).astype(_U) + _U(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of every run of k words; lanes are independent."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    up, down = powers(_GRAM_BASES[lane], len(words) + 1)
    total = np.zeros(len(words) + 1, _U)
    np.cumsum((words if not lane else mix(words ^ _U(0x5851F42D4C957F2D))) * up[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def shingles(text: bytes, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The multiset of k-word shingles as distinct hashes with counts; shorter texts are one shingle, blank ones none."""
    words = word_hashes(text)
    return np.unique(gram_hashes(words, min(k, max(1, len(words)))), return_counts=True)


# ---------------------------------------------------------------- connected classes


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of links (a long, b long): label is the smallest node of its connected class.

    Every round takes the smallest label of the neighbours (with partial aggregation, so that a hub is no hot spot) and
    then jumps to that label's own label; only whether anything moved reaches the driver. Two folders take turns, so that
    rounds do not add up on disk.
    """
    both = stash(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    turns = [f"{shared_dir(links.sparkSession)}/stash/{uuid.uuid4().hex}" for _ in range(2)]
    labels = stash(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")))
    for n in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        lower = F.least("low", F.coalesce("far", "low"))
        new = stash(step.join(jump, "low", "left").select("node", lower.alias("label"), (lower < F.col("label")).alias("moved")), turns[n % 2])
        labels = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return labels
    raise RuntimeError("classes did not settle")


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left join right on keys, where right comes from an aggregation by the same keys and left may have a hot key.

    The aggregated side would be joined in the partitions that it was summed in, which adaptive execution cannot split. A
    hash of the keys as one more key shuffles it anew, and then it can.
    """
    extra = F.xxhash64(*keys)
    return left.withColumn("__key", extra).join(right.withColumn("__key", extra), [*keys, "__key"], how).drop("__key")
