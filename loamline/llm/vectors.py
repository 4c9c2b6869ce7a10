"""Searches over vectors: multiprobe p-stable hashing (approximate) and multi-resolution segment bounds (exact).

Both bring queries and candidates together in cells of bounded size (a block of queries with a block of vectors of one
bucket), compute them with numpy inside the task, and return a few best from each cell, so that neither pairs nor a
whole bucket are ever written or held in one place.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, d (dimension), v: one row per vec_id, without null ids and vectors that are null, empty or hold null or non-finite
    components. Components keep their type. Rows that repeat a vec_id are one row, the smallest vector. Vectors of every
    dimension take part; a product is of vectors of one dimension, so others are no candidates of a query."""
    rows = vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = rows.filter(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0), F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", F.size("v").alias("d"), "v")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def _best(scores: Column, found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query, ties to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", scores.alias("score"))


# ---------------------------------------------------------------- approximate


class PStable:
    """Tables of p-stable hash functions floor((a.x + b) / w), the same for the same seed and dimension.

    Inner products become distances: candidates are scaled by the largest norm and get one more component that makes
    them unit vectors; queries are normalised and get a zero.
    """

    def __init__(self, dimension: int, norm: float, tables: int, functions: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dimension + 1, functions))
        self.b = rng.uniform(0, width, (tables, 1, functions))
        self.width, self.norm = width, norm
        self.moves = np.array(list(itertools.product((-1, 0, 1), repeat=functions)))

    def _codes(self, cells: np.ndarray) -> np.ndarray:
        """Bucket numbers: table and cell packed into one long, cells taken modulo 128."""
        total = np.broadcast_to(np.arange(len(cells), dtype=np.int64).reshape((-1,) + (1,) * (cells.ndim - 2)), cells.shape[:-1]).copy()
        for k in range(cells.shape[-1]):
            total = total * 128 + (cells[..., k].astype(np.int64) % 128)
        return total

    def table_of(self, bucket: int) -> int:
        return bucket >> (7 * self.a.shape[2])

    def place(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket numbers of candidates."""
        y = x / self.norm
        y = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(axis=1)))])
        return self._codes(np.floor((y @ self.a + self.b) / self.width)).T

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """(queries, tables * n) bucket numbers, in each table in descending order of estimated success.

        A perturbation moves some functions to a neighbouring slot; its cost is the sum of squared distances from the
        query's projection to the boundaries that it crosses.
        """
        y = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        at = (y @ self.a + self.b) / self.width
        cell = np.floor(at)
        low = at - cell
        price = np.where(self.moves == 0, 0, np.where(self.moves < 0, low[:, :, None, :], 1 - low[:, :, None, :]) ** 2).sum(axis=-1)
        order = np.argsort(price, axis=-1, kind="stable")[..., :n]
        return np.moveaxis(self._codes(cell[:, :, None, :] + self.moves[order]), 0, 1).reshape(len(q), -1)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, tables: int = 2, functions: int = 3, width: float = 1.5, probes: int = 18, block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every` its k nearest found.

    Nearness is the inner product of the original vectors in doubles; ties, however many, go to the smaller vec_id; a query is no
    candidate of its own. Zero vectors take no part, nor those that `usable` leaves out. A bucket of any size is worked on in
    whole, in blocks; a pair that meets in several tables is scored exactly in the first only. Buckets are visited in order of
    estimated success: a block of the first four of each table gives a query its threshold, and the others return what
    reaches it. A query whose buckets hold too few candidates is compared with all vectors. More tables and probes
    raise recall; more functions or a smaller width make buckets smaller.
    """
    base = stash(usable(vectors).filter(F.exists("v", lambda x: x != 0)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    shapes = base.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("norm")).collect()  # a row for each dimension
    hashes = {r.d: PStable(r.d, r.norm, tables, functions, width) for r in shapes}
    most = min(probes, 3**functions)

    def hashed(per_row: int, codes):
        def run(batches):
            for b in batches:
                for d, g in b.groupby("d"):
                    nth = np.tile(np.arange(per_row, dtype=np.int32) % most, len(g))
                    yield pd.DataFrame({"vec_id": np.repeat(g.vec_id, per_row), "d": d, "bucket": codes(hashes[d], _matrix(g.v)).reshape(-1), "nth": nth, "v": np.repeat(g.v.to_numpy(), per_row)})

        return run

    kind = base.schema["v"].dataType.simpleString()
    schema = f"vec_id long, d int, bucket long, nth int, v {kind}"
    queries = base.filter(F.col("vec_id") % every == 0)
    placed = base.mapInPandas(hashed(tables, lambda h, x: h.place(x)), schema)
    asked = queries.mapInPandas(hashed(tables * most, lambda h, x: h.probes(x, most)), schema)
    sizes = placed.groupBy("d", "bucket").agg(F.count("*").alias("n")).join(asked.groupBy("d", "bucket").agg(F.count("*").alias("n_asked")), ["d", "bucket"])
    sizes = stash(sizes)

    def dealt(rows: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        """Each row in one block of its own side, for all blocks of the other side."""
        blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
        mine = F.pmod(F.xxhash64("vec_id"), blocks(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), blocks(other) - 1))
        cut = rows.join(sizes, ["d", "bucket"]).select("d", "bucket", mine.alias("own"), theirs.alias("other"), "vec_id", "v", "nth", F.lit(None).cast("double").alias("least"))
        return cut.select("d", "bucket", F.col("other" if is_query else "own").alias("i"), F.col("own" if is_query else "other").alias("j"), F.lit(is_query).alias("query"), "vec_id", "v", "nth", "least")

    def compare(x: pd.DataFrame, met=None) -> pd.DataFrame:
        asks, have = x[x["query"]], x[~x["query"]]
        if not len(asks) or not len(have):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        q, v = _matrix(asks.v), _matrix(have.v)
        ids, of = have.vec_id.to_numpy(), asks.vec_id.to_numpy()
        rough = q @ v.T
        rough[of[:, None] == ids[None, :]] = -np.inf
        # rough and exact products each err by at most d * eps * |q| * |v|; all within that of the k-th are kept, however many tie
        slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack if k < len(ids) else np.full(len(of), -np.inf)
        known = asks["least"].fillna(-np.inf).to_numpy(float) if "least" in asks else np.full(len(of), -np.inf)
        least = np.maximum(least, known - slack)
        close = (rough >= least[:, None]) & (ids[None, :] != of[:, None])
        if met is not None:
            close &= ~met(q, v, close)
        found = []
        for i, query in enumerate(of):
            near = np.flatnonzero(close[i])
            exact = (q[i] * v[near]).sum(axis=1)  # the same sum wherever the pair meets
            best = np.lexsort((ids[near], -exact))[:k]
            best = best[exact[best] >= known[i]]
            found.append((np.full(len(best), query), ids[near[best]], exact[best]))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "vec_id", "score"), zip(*found))})

    def probed(x: pd.DataFrame) -> pd.DataFrame:
        """A cell of a bucket; pairs that meet in an earlier table's bucket are left to it: if they are among the best there is a
        cell of that table that has them among its best."""
        own, bucket = hashes[int(x.d.iat[0])], int(x.bucket.iat[0])

        def met(q, v, close):
            table = own.table_of(bucket)
            out = np.zeros(close.shape, bool)
            if table:
                places, asks = own.place(v), own.probes(q, most).reshape(len(q), tables, most)
                for i in np.flatnonzero(close.any(axis=1)):
                    near = np.flatnonzero(close[i])
                    out[i, near] = (places[near][:, :table, None] == asks[i][None, :table, :]).any(axis=(1, 2))
            return out

        return compare(x, met)

    result = "query_id long, vec_id long, score double"
    have, asks = dealt(placed, "n", "n_asked", False), dealt(asked, "n_asked", "n", True)
    is_first = (F.col("nth") < 4) & (F.col("i") == 0)
    search = lambda have, asks: _best(F.col("score"), have.union(asks).groupBy("d", "bucket", "i", "j").applyInPandas(probed, result), k)
    first = stash(search(have.filter("i = 0"), asks.filter(is_first)))
    least = first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    asks = asks.filter(~is_first).join(least, "vec_id", "left").withColumn("least", F.col("known")).select(have.columns)
    found = stash(_best(F.col("score"), first.drop("rank").unionByName(search(have, asks).drop("rank")), k))
    # queries whose buckets hold fewer than k candidates while more have their dimension are compared with every block
    have = found.groupBy("query_id").agg(F.count("*").alias("have")).withColumnRenamed("query_id", "vec_id")
    counts = base.groupBy("d").agg(F.count("*").alias("n"))
    short = queries.join(have, "vec_id", "left").join(counts, "d").filter(F.coalesce("have", F.lit(0)) < F.least(F.lit(k), F.col("n") - 1)).select("vec_id", "d", "v")
    short = stash(short)
    if short.isEmpty():
        return found
    rows, asking = math.ceil(sum(r.n for r in shapes) / block), math.ceil(short.count() / block)
    mine = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = base.join(short.select("d").distinct(), "d", "left_semi").select("d", mine(rows).alias("i"), each(asking).alias("j"), F.lit(False).alias("query"), "vec_id", "v")
    right = short.select("d", each(rows).alias("i"), mine(asking).alias("j"), F.lit(True).alias("query"), "vec_id", "v")
    rest = left.union(right).groupBy("d", "i", "j").applyInPandas(lambda x: compare(x), result)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(_best(F.col("score"), rest, k))


# ---------------------------------------------------------------- exact


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that the product of two such rows bounds the inner product.

    In a segment of m components, x.y = m mean(x) mean(y) + sum((x - mean) (y - mean)), and the last sum is at most
    m dev(x) dev(y). The squared distance |x|^2 + |y|^2 - 2 x.y is bounded from below likewise.
    """
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    return np.column_stack([f for p in parts for f in (p.mean(axis=1) * math.sqrt(p.shape[1]), p.std(axis=1) * math.sqrt(p.shape[1]))])


def search_cell(q: np.ndarray, of: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, resolutions: tuple[int, ...], least: np.ndarray | None = None, left: list[int] | None = None) -> list[tuple[int, int, int]]:
    """The k best (query id, vector id, score) of every query in a block; q and v hold integers, ids ascend.

    least: scores that k other vectors are known to reach, by query; what cannot reach its query's is dropped. left: gets the number
    of pairs that are left at the start and after each resolution.
    """
    least = np.full(len(q), -np.inf) if least is None else least.astype(float)
    alive = of[:, None] != ids[None, :]
    left = [] if left is None else left
    left.append(int(alive.sum()))
    for n, segments in enumerate(resolutions):
        rows = np.flatnonzero(alive.any(axis=0))
        bound = segment_features(q, segments) @ segment_features(v[rows], segments).T
        if n == 0 and len(rows):  # exact scores of the most promising vectors raise the threshold
            first = np.argsort(-np.where(alive[:, rows], bound, -np.inf), axis=1, kind="stable")[:, : 4 * k]
            seen = np.where(np.take_along_axis(alive[:, rows], first, axis=1), np.einsum("qd,qnd->qn", q, v[rows[first]]), -np.inf)
            if seen.shape[1] >= k:
                least = np.maximum(least, -np.sort(-seen, axis=1)[:, k - 1])
        slack = 1e-6 * (1 + np.abs(bound))
        alive[:, rows] &= bound + slack >= least[:, None]
        left.append(int(alive.sum()))
    out = []
    for i in range(len(q)):  # products of integers, of the pairs that are left: doubles hold them exactly
        near = np.flatnonzero(alive[i])
        s = v[near] @ q[i]
        out += [(int(of[i]), int(ids[near[j]]), int(s[j])) for j in np.argsort(-s, kind="stable")[:k]]
    return out


def exact_top(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 1024, asked: int = 4096, resolutions: tuple[int, ...] = (1, 4, 16, 32)) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * x) for each vec_id divisible by `every`.

    All other vectors of the query's dimension are candidates; ties go to the smaller vec_id. Bounds from segment means and
    deviations, coarse to fine, drop pairs that cannot reach the query's k best; products are computed for the pairs that are
    left. The first block is searched before the others and gives them their first thresholds. Vectors are dealt to blocks of
    `block` and move once for each `asked` queries; queries go to every block. Repeated ids, nulls and non-finite
    components are as in `usable`.
    """
    whole = F.transform("v", lambda x: F.floor(x.cast("double") * scale))
    base = stash(usable(vectors).select("vec_id", "d", whole.alias("v")))
    is_query = F.col("vec_id") % every == 0
    n, n_asked = base.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("int")), F.lit(0))).first()
    rows, groups = max(1, math.ceil(n / block)), max(1, math.ceil(n_asked / asked))
    mine = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    none = F.lit(None).cast("long")

    def compare(x: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, g in x.groupby("d"):
            a, h = g[g["query"]], g[~g["query"]].sort_values("vec_id")
            for at in range(0, len(a) if len(h) else 0, 512):
                part = a.iloc[at : at + 512]
                found += search_cell(_matrix(part.v), part.vec_id.to_numpy(), _matrix(h.v), h.vec_id.to_numpy(), k, resolutions, part["least"].fillna(-np.inf).to_numpy(float))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    def searched(blocks: range, queries: DataFrame) -> DataFrame:
        """Scores of the blocks numbered so."""
        have = base.withColumn("i", mine(rows)).filter(F.col("i").between(blocks.start, blocks.stop - 1))
        have = have.select("i", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("j"), F.lit(False).alias("query"), "vec_id", "d", "v", none.alias("least"))
        asks = queries.select(F.explode(F.sequence(F.lit(blocks.start), F.lit(blocks.stop - 1))).alias("i"), mine(groups).alias("j"), F.lit(True).alias("query"), "vec_id", "d", "v", "least")
        return have.union(asks).groupBy("i", "j").applyInPandas(compare, "query_id long, vec_id long, score long")

    queries = base.filter(is_query)
    found = stash(searched(range(1), queries.withColumn("least", none)))
    if rows > 1:
        least = _best(F.col("score"), found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        found = found.union(searched(range(1, rows), queries.join(least, "vec_id", "left")))
    return _best(F.col("score"), found, k)
