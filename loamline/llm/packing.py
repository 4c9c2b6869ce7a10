"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces come in descending length; each goes to the open bin that it leaves the
least room in. Where none has room, a bin is opened: for every permitted length the fill that the pieces still to come can
give it is tried, and the length with the least cost for a word of its contents is taken, so that the lengths are chosen
jointly for the sizes at hand. The cost of a sequence grows with its length and, for attention, with its square. In the end
every bin is downsized to the shortest permitted length that holds it.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, n_words, stash

LENGTHS = (512, 1024, 2048, 4096, 8192)


def cost(length: np.ndarray | int, longest: int) -> np.ndarray | float:
    """The price of a sequence: a fixed part, its length, and attention's square."""
    return 16 + length + length * length / (4 * longest)


def filled(falling: list[int], at: int, room: int) -> int:
    """Words that the pieces from `at` on can put into a room, the largest that fits first; falling: negated sizes, ascending."""
    start, n = room, len(falling)
    while room > 0:
        at = bisect_left(falling, -room, at)
        if at >= n:
            break
        size = -falling[at]
        many = min(room // size, bisect_right(falling, -size, at) - at)  # a run of equal sizes at once
        room -= many * size
        at += many
    return start - room


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each size, offset in it, permitted length of each bin) for sizes in descending order."""
    lengths = tuple(sorted(lengths))
    falling = (-sizes).tolist()
    rooms: list[int] = []
    by_room: dict[int, list[int]] = {}
    fill: list[int] = []
    opened: list[int] = []
    of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, s in enumerate(sizes.tolist()):
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
        else:
            best = None
            for length in lengths:
                if length >= s:
                    content = s + filled(falling, i + 1, length - s)
                    price = cost(lengths[bisect_left(lengths, content)], lengths[-1]) / content
                    if best is None or price <= best[0]:
                        best = (price, length)
            room = best[1]
            b = len(fill)
            fill.append(0)
            opened.append(room)
        of[i], offset[i] = b, fill[b]
        fill[b] += s
        left = room - s
        if left:
            if left not in by_room:
                insort(rooms, left)
            by_room.setdefault(left, []).append(b)
    final = np.array([lengths[bisect_left(lengths, f)] for f in fill], np.int64)
    return of, offset, final


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = 2048) -> DataFrame:
    """doc_id, nth, piece, start, length, bin_id, bin_length, bin_offset: a row for each piece of each row of docs.

    A text of more words than the longest length, however long, is cut into pieces of that length and a rest. Pieces of equal
    length go in order of doc_id (null last), nth and piece, and of bins with equal room the one filled last is taken. Rows alike
    in doc_id and size are told apart by nth. Null and blank texts are one row of length 0 in no bin (bin_id null). Pieces
    are dealt at random into groups of about `group` that are packed on their own, so that no task holds more, and
    loss is at most a few bins in each group. The same rows always give the same bins.
    """
    most = max(lengths)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("size")).groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    each = sized.select("doc_id", "size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / most).cast("int") - 1, F.lit(0)))).alias("piece")
    pieces = each.select("doc_id", "nth", "size", piece)
    start = F.col("piece").cast("long") * most
    pieces = stash(pieces.select("doc_id", "nth", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(most)).alias("length")))
    groups = max(1, math.ceil(pieces.count() / group))

    def packed(x: pd.DataFrame) -> pd.DataFrame:
        x = x.assign(none=x["doc_id"].isna()).sort_values(["length", "none", "order", "nth", "piece"], ascending=[False, True, True, True, True], kind="stable")
        of, offset, final = pack(x["length"].to_numpy(), lengths)
        return x.assign(bin_id=x["at"].astype(np.int64) * (1 << 32) + of, bin_length=final[of], bin_offset=offset)[["doc_id", "nth", "piece", "start", "length", "bin_id", "bin_length", "bin_offset"]]

    schema = "doc_id string, nth int, piece int, start long, length long, bin_id long, bin_length long, bin_offset long"
    at = F.pmod(F.xxhash64("doc_id", "nth", "piece"), F.lit(groups)).alias("at")
    full = pieces.filter("length > 0").select("*", at, F.coalesce("doc_id", F.lit(0)).alias("order")).withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("at").applyInPandas(packed, schema)
    none = F.lit(None).cast("long")
    blank = pieces.filter("length = 0").select("doc_id", "nth", "piece", "start", "length", none.alias("bin_id"), none.alias("bin_length"), none.alias("bin_offset"))
    return full.withColumn("doc_id", F.col("doc_id").cast("long")).union(blank)


def sequences(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """bin_id, bin_length, doc_ids, words: the sequences themselves, for documents whose doc_id is unique."""
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.col("start").cast("int") + 1, F.col("length").cast("int"))
    rows = packed.filter("bin_id is not null").join(docs.select("doc_id", "text"), "doc_id")
    parts = rows.groupBy("bin_id", "bin_length").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", words.alias("words")))).alias("parts"))
    return parts.select("bin_id", "bin_length", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.words").alias("words"))
