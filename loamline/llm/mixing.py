"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's rate is its target over its size. Every document gets the whole copies of the rate; the fraction is settled
pairwise: two documents with fractional probabilities exchange mass, at random and without bias, in words, until one of
them is integral; the other goes on. Pairs are formed inside blocks of documents of one source, then between the
documents that the blocks left over, block of blocks by block of blocks, up a reduction tree. Each exchange keeps the
source's words, so that a source misses its target by less than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import earlier, n_words, spread, stash, uniform

BLOCK = 48
#: Most rows of a table that is joined as a broadcast; a larger one is joined by shuffle.
SMALL = 10_000


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, n, target: one row per source of (source, size, n rows of that size).

    Sources in code point order, null last, weigh 1, 2, 3, 1, ...; they share the sum of all sizes, none above `most` times
    its size. Filling by weight up to the caps has a closed form over the sources in order of cap per weight. Both orders are
    range-partitioned; ranks and sums are counted within a partition and go on from those of the partitions before it.
    """
    name = F.col("source").asc_nulls_last()
    per = spread(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")), name)
    rank = F.row_number().over(W.partitionBy("part").orderBy(name)) - 1
    ranked = per.join(F.broadcast(earlier(per, before=F.lit(1))), "part").withColumn("weight", F.pmod(rank + F.col("before"), F.lit(3)) + 1)
    cap = F.col("source_size") * F.lit(most)
    filled = ranked.select("source", "source_size", "n", "weight", cap.alias("cap"), (cap / F.col("weight")).alias("ratio"))
    filled = spread(filled, F.col("ratio"), name)
    size, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    so_far = W.partitionBy("part").orderBy(F.col("ratio"), name).rowsBetween(W.unboundedPreceding, -1)
    run = lambda c, before: F.coalesce(F.sum(c).over(so_far), F.lit(0)) + F.col(before)
    filled = filled.join(F.broadcast(earlier(filled, caps=F.col("cap"), weights=F.col("weight"))), "part")
    filled = filled.withColumn("level", (F.lit(size) - run("cap", "caps")) / (F.lit(weight) - run("weight", "weights")))
    free = F.col("ratio") > F.col("level")
    final = filled.filter(free).agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source"))).first()[0]
    shared = F.least(F.col("weight") * F.lit(final).cast("double"), F.col("cap"))
    return filled.select("source", "source_size", "n", F.when(free, shared).otherwise(F.col("cap")).alias("target"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pair(acc: Column, x: Column, seed: int) -> Column:
    """One pivotal step: the carried document and x exchange words until one of them is integral."""
    a = acc["cur"]
    item = lambda d, p: F.struct(d["h"].alias("h"), d["doc_id"].alias("doc_id"), d["nth"].alias("nth"), d["size"].alias("size"), p.alias("p"))
    done = lambda d, k: F.concat(acc["out"], F.array(F.struct(d["doc_id"].alias("doc_id"), d["nth"].alias("nth"), d["size"].alias("size"), F.lit(k).alias("k"))))
    state = lambda cur, out: F.struct(cur.alias("cur"), out.alias("out"))
    wa, ra = a["p"] * a["size"], (1 - a["p"]) * a["size"]
    wb, rb = x["p"] * x["size"], (1 - x["p"]) * x["size"]

    def step(m):
        to_a = m["u"] * (m["up"] + m["down"]) < m["down"]  # with probability down / (up + down)
        kept = lambda d, p: item(d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
        return (
            F.when(to_a & (ra <= wb), state(kept(x, x["p"] - m["up"] / x["size"]), done(a, 1)))
            .when(to_a, state(kept(a, a["p"] + m["up"] / a["size"]), done(x, 0)))
            .when(wa <= rb, state(kept(x, x["p"] + m["down"] / x["size"]), done(a, 0)))
            .otherwise(state(kept(a, a["p"] - m["down"] / a["size"]), done(x, 1)))
        )

    moves = F.struct(F.least(ra, wb).alias("up"), F.least(wa, rb).alias("down"), uniform(a["h"], x["h"], seed=seed).alias("u"))
    return F.when(a.isNull(), state(x, acc["out"])).otherwise(_let(moves, step))


_ITEM = "struct<h:bigint,doc_id:bigint,nth:int,size:bigint,p:double>"
_DONE = "array<struct<doc_id:bigint,nth:int,size:bigint,k:int>>"


def _settle(items: DataFrame, seed: int) -> DataFrame:
    """(src, block, item) -> (src, block, acc): every block settled but for the one document in acc.cur."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("cur"), F.array().cast(_DONE).alias("out"))
    group = items.groupBy("src", "block").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return group.select("src", "block", F.aggregate("items", start, lambda acc, x: _pair(acc, x, seed)).alias("acc"))


def _tree(rows: DataFrame, largest: int, seed: int) -> DataFrame:
    """(src, d) with d.k the settled fraction, 0 or 1, of every row of (src, item); largest: most rows of one source."""
    level = stash(_settle(rows.select("src", F.pmod("item.h", F.col("src.blocks")).alias("block"), "item"), seed))
    settled = level.select("src", F.explode("acc.out").alias("d"))
    blocks = math.ceil(largest / BLOCK)
    while blocks > 1:
        blocks = math.ceil(blocks / BLOCK)
        level = stash(_settle(level.select("src", F.floor(F.col("block") / BLOCK).alias("block"), F.col("acc.cur").alias("item")), seed + blocks))
        settled = settled.union(level.select("src", F.explode("acc.out").alias("d")))
    last = F.col("acc.cur")
    k = (uniform(last["h"], seed=seed) < last["p"]).cast("int")
    return settled.union(level.select("src", F.struct(last["doc_id"].alias("doc_id"), last["nth"].alias("nth"), last["size"].alias("size"), k.alias("k")).alias("d")))


def mix(docs: DataFrame, seed: int = 17, most: int = 3, large: float = 4.0) -> DataFrame:
    """source, doc_id, size, nth, source_size, target, copies, taken: a row for each row of docs.

    size is the text's number of words (null: 0). Rows alike in source, doc_id and size are told apart by nth, from 1.
    copies is the number of times the mix holds the document, at most `most`; a document without words gets none, and a
    source without words has target 0. Copies depend on the rows and the seed alone. Null sources are one source.

    Documents over `large` times their source's mean are settled first; what they miss their share by is added to the
    rate of the source's other documents, so that in the end one document of moderate size is all that can be missing.
    """
    sized = stash(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")))
    plan = stash(targets(sized, float(most)))
    n_sources, largest = plan.agg(F.count("*"), F.max("n")).first()
    aimed = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    plan = plan.withColumns({"rate": aimed, "cut": F.col("source_size") / F.col("n") * large})

    def settle(classes: DataFrame, is_large: bool) -> DataFrame:
        src = F.struct("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
        side = classes.select(F.col("source").alias("of"), "cut", src.alias("src"))
        side = F.broadcast(side) if n_sources <= SMALL else side
        mine = sized.join(side, sized.source.eqNullSafe(side.of) & ((F.col("size") > F.col("cut")) == F.lit(is_large)))
        rows = mine.filter("size > 0").select("src", "doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
        item = F.struct(F.xxhash64(F.lit(seed), F.col("src.source"), "doc_id", "size", "nth").alias("h"), "doc_id", "nth", "size", F.col("src.p").alias("p"))
        copies = F.least(F.col("src.whole") + F.col("d.k"), F.lit(most)).cast("long")
        done = _tree(rows.select("src", item.alias("item")), largest or 0, seed)
        done = done.select("src.source", "d.doc_id", "d.size", "d.nth", "src.source_size", "src.target", copies.alias("copies"))
        return done.withColumn("taken", F.col("copies") * F.col("size"))

    first = settle(plan, True)
    taken = first.groupBy("source").agg(F.sum("taken").alias("got"), F.sum("size").alias("had")).withColumnRenamed("source", "of")
    after = plan.join(taken, plan.source.eqNullSafe(taken.of), "left")
    left = F.col("source_size") - F.coalesce("had", F.lit(0))
    shifted = F.when(left > 0, (F.col("target") - F.coalesce("got", F.lit(0))) / left).otherwise(F.lit(0.0))
    after = stash(after.withColumn("rate", F.least(F.greatest(shifted, F.lit(0.0)), F.lit(float(most)))).select(plan.columns))
    of = plan.select(F.col("source").alias("of"), "source_size", "target")
    of = F.broadcast(of) if n_sources <= SMALL else of
    blank = sized.filter("size = 0").join(of, sized.source.eqNullSafe(of.of)).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    blank = blank.select("source", "doc_id", "size", "nth", "source_size", "target", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("taken"))
    return first.union(settle(after, False)).union(blank)
