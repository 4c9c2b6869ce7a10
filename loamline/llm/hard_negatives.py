"""Hard negatives by a block matrix multiply in two dimensions (SUMMA-style).

Scores are a matrix of anchors by rows. Both sides are cut into blocks of vectors packed as bytes, in the order of label. A task owns some
blocks of anchors and a share of the blocks of rows; it multiplies each pair of them chunk by chunk of dimensions, adds the partial
products where they are made, and keeps the best rows of each of its anchors. Neither tiles nor copies of vectors are shuffled: a pair of
blocks is read where it is multiplied, and only the best of each task's share are brought together. The first product covers
pairs of like label and yields positives; the second covers all rows, and each anchor keeps its best rows of other labels in the window below
each positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, small_bytes, stash

_NONE = np.iinfo(np.int64).min + 1  # a score that no pair has; its negative is an int64 too
_MOST = np.iinfo(np.int64).max
_COMPONENTS = 1 << 20  # of a block at most, unless a single vector has more
_BOUNDS = {np.dtype(np.float32): 1 << 24, np.dtype(np.float64): 1 << 53, np.dtype(np.int64): _MOST}
_TILE = 256  # anchors whose scores are looked through at a time
_SIDE = "{0}d int, {0}low long, {0}high long, {0}n int, {0}kind string, {0}x binary, {0}ids binary, {0}labels binary"
_ANCHORS = f"{_SIDE.format('a_')}, a_positives binary"
_ROWS = _SIDE.format("r_")


def labelled(vectors: DataFrame, column: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, d (dimension), v (integers floor(scale * x)): one row per vec_id, the one of the smallest vector, then label. Rows with
    a null id, label or vector, an empty vector, or a null or non-finite component take no part."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(column) > 0)
    rows = vectors.filter("vec_id is not null and label is not null").filter(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col(column).alias("x"), F.col("label").cast("long").alias("label")).alias("row"))
    rows = rows.groupBy("vec_id").agg(F.min("row").alias("row"))
    return rows.select("vec_id", "row.label", F.size("row.x").alias("d"), F.transform("row.x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _partial(key: tuple[Any, ...], x: pd.DataFrame) -> pd.DataFrame:
    """The part of either side that x holds, packed into one row: vectors in the narrowest integers that hold them, ids, labels, and of anchors
    the ids and scores of their positives. key starts with the dimension. Rows are in the order of label, then vec_id."""
    x = x.sort_values(["label", "vec_id"])
    row: dict[str, Any] = {}
    for side, own in (("a_", x[x["anchor"]]), ("r_", x[~x["anchor"]])):
        if len(own):
            v = np.stack(own["x"].to_list()).astype(np.int64)
            kind = next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= v.min() and v.max() <= np.iinfo(t).max)
            values = (key[0], own.label.min(), own.label.max(), len(own), kind, v.astype(kind).tobytes(), own.vec_id.to_numpy("<i8").tobytes(), own.label.to_numpy("<i8").tobytes())
            row |= {side + name: value for name, value in zip(("d", "low", "high", "n", "kind", "x", "ids", "labels"), values)}
        if len(own) and side == "a_":
            positives = np.full((len(own), max(len(p) for p in own.positives)), _NONE)
            for to, p in zip(positives, own.positives):
                to[: len(p)] = p
            row["a_positives"] = positives.astype("<i8").tobytes()
    return pd.DataFrame([row])


def _packed(names: list[str], most: int):
    """Rows sorted by d as blocks of one dimension, of at most `most` vectors and _COMPONENTS components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, d = [], 0, None

        def block() -> pd.DataFrame:
            return _partial((d,), pd.concat(held))[names]

        for b in batches:
            for size, own in b.groupby("d", sort=True):
                if held and size != d:
                    yield block()
                    held, n = [], 0
                d = size
                limit = max(1, min(most, _COMPONENTS // d))
                while len(own):
                    take, own = own.iloc[: limit - n], own.iloc[limit - n :]
                    held.append(take)
                    n += len(take)
                    if n == limit:
                        yield block()
                        held, n = [], 0
        if held:
            yield block()

    return run


def _exact(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer vectors of both sides in the first type of _BOUNDS that holds all sums exactly. No sum over any of the dimensions exceeds the
    product of the vectors' lengths."""
    longest = [float(np.sqrt(np.square(x.astype(float)).sum(axis=1).max())) for x in (q, v)]
    kind = next(t for t, bound in _BOUNDS.items() if t == np.int64 or longest[0] * longest[1] * 1.001 < bound)
    return q.astype(kind), v.astype(kind)


def _product(q: np.ndarray, v: np.ndarray, chunk: int) -> np.ndarray:
    """Inner products: partial products of `chunk` dimensions, added where they are made."""
    total = q[:, :chunk] @ v[:, :chunk].T
    for c in range(chunk, q.shape[1], chunk):
        total += q[:, c : c + chunk] @ v[:, c : c + chunk].T
    return total


def _side(row: Any, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a packed block."""
    n = int(row[side + "n"])
    return np.frombuffer(row[side + "ids"], "<i8"), np.frombuffer(row[side + "labels"], "<i8"), np.frombuffer(row[side + "x"], row[side + "kind"]).reshape(n, -1)


def _positives(row: Any) -> np.ndarray:
    return np.frombuffer(row["a_positives"], "<i8").reshape(int(row["a_n"]), -1)


def _added(pair: pd.DataFrame, chunk: int = 32) -> tuple:
    """Ids and labels of anchors, ids and labels of rows, positives, and the scores of a pair of blocks."""
    row = pair.iloc[0]
    (of, label, q), (ids, labels, v) = _side(row, "a_"), _side(row, "r_")
    scores = _product(*_exact(q, v), max(chunk, math.ceil(q.shape[1] / 8)))
    return of, label, ids, labels, np.frombuffer(row["a_positives"], "<i8").reshape(len(of), -1), scores


class _Best:
    """The k best rows of each anchor of a block in each of its windows (lowest and highest score, of which the rows seen so far leave those that
    reach the last of the k). Ties go to the smaller id."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.score = np.full((*low.shape, k), _NONE)
        self.id = np.full((*low.shape, k), _MOST)
        self.reach = low.copy()  # of each window: the least score that still counts
        self.least = self._least()  # of each anchor

    def _least(self) -> np.ndarray:
        return np.where(self.low <= self.high, self.reach, _MOST).min(axis=1, initial=_MOST)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores of the anchors numbered `at` and rows `ids`; the least number of their type is no score."""
        bound = _BOUNDS[scores.dtype]
        least = np.clip(self.least[at], -bound, bound).astype(scores.dtype)
        found = np.flatnonzero(scores >= least[:, None])
        if not len(found):
            return
        a, r = np.divmod(found, len(ids))
        a, value, r = at[a], scores.reshape(-1)[found].astype(np.int64), ids[r]
        windows, width = [], self.low.shape[1]
        for w in range(width):
            last, reach = self.id[a, w, -1], self.reach[a, w]
            fits = (value <= self.high[a, w]) & ((value > reach) | (value == reach) & ((r < last) | (self.score[a, w, -1] == _NONE)))
            windows.append((a[fits] * width + w, value[fits], r[fits]))
        group, value, r = (np.concatenate(x) for x in zip(*windows))
        if not len(group):
            return
        touched = np.unique(group)
        score, best = self.score.reshape(-1, self.k), self.id.reshape(-1, self.k)
        group = np.concatenate([group, np.repeat(touched, self.k)])
        value, r = np.concatenate([value, score[touched].reshape(-1)]), np.concatenate([r, best[touched].reshape(-1)])
        order = np.lexsort((r, -value, group))
        starts = np.searchsorted(group[order], touched)  # each has k and more: those that it had are among them
        first = order[starts[:, None] + np.arange(self.k)]
        score[touched], best[touched] = value[first], r[first]
        a, w = np.divmod(touched, width)
        self.reach[a, w] = np.maximum(self.low[a, w], score[touched, -1])
        self.least[:] = self._least()


def _kept(best_of, hide, answer, chunk: int):
    """For mapInPandas over pairs of blocks: `best_of` makes the _Best of a block of anchors, `hide` overwrites the scores of pairs that do not count,
    and `answer` makes the rows of a block when all pairs of the task have been seen."""

    def run(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[int, tuple] = {}
        for batch in pairs:
            for n in range(len(batch)):
                of, label, ids, labels, positives, scores = _added(batch.iloc[n : n + 1], chunk)
                if of[0] not in state:  # an id is in one block of anchors only
                    state[of[0]] = (of.copy(), positives.copy(), best_of(positives))
                best = state[of[0]][2]
                hide(scores, of, label, ids, labels, _hidden(scores))
                for i in range(0, len(of), _TILE):
                    best.add(np.arange(i, min(i + _TILE, len(of))), scores[i : i + _TILE], ids)
        for block in state.values():
            yield answer(*block)

    return run


def _hidden(scores: np.ndarray) -> float | int:
    return np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf


def _likes(k: int, chunk: int):
    """The k best rows of each anchor's label among the pairs of a task."""

    def best_of(positives: np.ndarray) -> _Best:
        return _Best(k, np.full((len(positives), 1), _NONE), np.full((len(positives), 1), _MOST))

    def hide(scores, of, label, ids, labels, hidden) -> None:
        scores[(label[:, None] != labels[None, :]) | (of[:, None] == ids[None, :])] = hidden

    def answer(of, _, best: _Best) -> pd.DataFrame:
        a, _, n = np.nonzero(best.score != _NONE)
        return pd.DataFrame({"anchor_id": of[a], "positive_id": best.id[a, 0, n], "positive_score": best.score[a, 0, n]})

    return _kept(best_of, hide, answer, chunk)


def _others(k: int, low: int, high: int, chunk: int):
    """For each anchor and positive the k best rows of another label among the pairs of a task whose scores are from low to high hundredths of the
    positive's."""

    def best_of(positives: np.ndarray) -> _Best:
        score, none = positives[:, 1::2], positives[:, 0::2] == _NONE
        part = lambda x, share: x // 100 * share + x % 100 * share // 100  # noqa: E731  floor(x * share / 100), without overflow
        return _Best(k, np.where(none, _MOST, -part(-score, low)), np.where(none, _NONE, part(score, high)))

    def hide(scores, of, label, ids, labels, hidden) -> None:
        for x in np.intersect1d(label, labels):  # both sides ascend
            (a, b), (r, s) = ([np.searchsorted(y, x, end) for end in ("left", "right")] for y in (label, labels))
            scores[a:b, r:s] = hidden

    def answer(of, positives, best: _Best) -> pd.DataFrame:
        a, w, n = np.nonzero(best.score != _NONE)
        return pd.DataFrame({"anchor_id": of[a], "positive_id": positives[a, 2 * w], "positive_score": positives[a, 2 * w + 1], "negative_id": best.id[a, w, n], "negative_score": best.score[a, w, n]})

    return _kept(best_of, hide, answer, chunk)


def _blocks(side: DataFrame, is_anchor: bool, block: int, parts: int) -> DataFrame:
    """Written blocks of a side (vec_id, label, d, v, and of anchors positives), each of one dimension and of labels next to one another."""
    schema = _ANCHORS if is_anchor else _ROWS
    positives = F.col("positives") if is_anchor else F.lit(None).cast("array<bigint>").alias("positives")
    rows = side.select("vec_id", "label", "d", F.lit(is_anchor).alias("anchor"), F.col("v").alias("x"), positives)
    rows = rows.repartitionByRange(parts, "d", "label", "vec_id").sortWithinPartitions("d", "label", "vec_id")
    return stash(rows.mapInPandas(_packed([c.split()[0] for c in schema.split(", ")], block), schema))


def _multiplied(anchors: DataFrame, rows: DataFrame, like: bool, kept, schema: str) -> DataFrame:
    """Blocks of anchors meet blocks of rows of their dimension, where `like` only those whose labels can be the same. Rows come in so
    many shares that every core has some pairs, and no more: each share brings its own best of every anchor."""
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    shares = math.ceil(4 * cores / max(1, anchors.rdd.getNumPartitions()))
    meet = F.col("a_d") == F.col("r_d")
    if like:
        meet &= (F.col("a_low") <= F.col("r_high")) & (F.col("r_low") <= F.col("a_high"))
    pairs = rows.coalesce(shares).join(anchors.hint("shuffle_replicate_nl"), meet)  # a Cartesian product: both sides are read where they meet
    return pairs.mapInPandas(kept, schema)


def _first(found: DataFrame, k: int, group: list[str], order: list[Column | str]) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("int")).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 1024, chunk: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors (vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by `every`; a score is the integer inner product of floor(scale * x). An anchor's
    positives are its `positives` best other rows of its label; for each of them the `negatives` best rows of other labels that
    score from `low` to `high` hundredths of it are returned, ties to the smaller vec_id. All rows of the anchor's
    dimension are candidates. Anchors without positives, and positives without negatives in the window, yield no row; a positive
    whose score is below zero has an empty window. An empty table yields none. Repeated ids, nulls and non-finite
    components are as in `labelled`; extra columns are not read. A label may hold any share of the rows: blocks are of bounded size.
    """
    small_batches(vectors.sparkSession)
    small_bytes(vectors.sparkSession)
    base = stash(labelled(vectors, scale=scale))
    n, n_anchors = base.select(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    parts = lambda rows, most: max(1, min(math.ceil(rows / block), max(4 * vectors.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / most))))
    is_anchor = F.col("vec_id") % every == 0
    none = F.array().cast("array<bigint>").alias("positives")
    rows = _blocks(base, False, block, parts(n, 50_000))
    first = _blocks(base.filter(is_anchor).select("*", none), True, block, parts(n_anchors, 4 * block))
    likes = _multiplied(first, rows, True, _likes(positives, chunk), "anchor_id long, positive_id long, positive_score long")
    likes = stash(_first(likes, positives, ["anchor_id"], [F.desc("positive_score"), "positive_id"]))
    chosen = likes.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.flatten(F.collect_list(F.array("positive_id", "positive_score"))).alias("positives"))
    second = _blocks(base.filter(is_anchor).join(chosen, "vec_id"), True, block, parts(n_anchors, 4 * block))
    found = _multiplied(second, rows, False, _others(negatives, low, high, chunk), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = _first(found, negatives, ["anchor_id", "positive_id"], [F.desc("negative_score"), "negative_id"])
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
