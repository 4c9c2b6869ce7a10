"""Substring deduplication by relative Lempel-Ziv parsing.

Every document is a reference block for all documents with a larger doc_id. The index holds each window of `window` words
once, by the block and the position where it stands first. It is content-defined: a window is anchored at its smallest
`gram`-word hash, so two documents that share a window share its anchor, and only windows whose anchor lies in several texts
are looked up, all of them. A document is parsed greedily from the left: the window at the cursor refers to a block and a
position, the factor runs on as long as the next windows stand next in that block, and the cursor moves behind the factor.
A factor has `window` words at least and is a duplicate span. At its end the windows that straddle the boundary are
checked on their own, as they may stand in another block; those found are duplicates too.

Exact copies are one factor as a whole and are found by digest, so that large groups of copies cost one text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, join_split, small_batches, stash, word_hashes


def _anchors(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash inside every window, by doubling: one value per window."""
    low, width, have = gram_hashes(words, gram), window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _index(window: int, gram: int):
    def run(batches):
        for b in batches:
            ids, found = [], []
            for doc, text in zip(b.doc_id, b.text):
                words = word_hashes(text)
                if len(words) >= window:
                    a = np.unique(_anchors(words, window, gram))
                    found.append(a.view(np.int64))
                    ids.append(np.full(len(a), doc, np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "anchor": np.concatenate(found)})

    return run


def _windows(window: int, gram: int):
    """The distinct windows of a document that have an anchor in `anchors`, as two independent hashes and the first position."""

    def run(batches):
        for b in batches:
            ids, w0, w1, place = [], [], [], []
            for doc, text, anchors in zip(b.doc_id, b.text, b.anchors):
                if anchors is None:
                    continue
                words = word_hashes(text)
                hit = np.flatnonzero(np.isin(_anchors(words, window, gram).view(np.int64), np.asarray(anchors, np.int64)))
                h, at = np.unique(gram_hashes(words, window)[hit], return_index=True)
                w0.append(h.view(np.int64))
                w1.append(gram_hashes(words, window, 1)[hit][at].view(np.int64))
                place.append(hit[at])
                ids.append(np.full(len(h), doc, np.int64))
            if ids:
                yield pd.DataFrame({"doc_id": np.concatenate(ids), "w0": np.concatenate(w0), "w1": np.concatenate(w1), "place": np.concatenate(place)})

    return run


def parse(windows: np.ndarray, seen: np.ndarray, block: np.ndarray, place: np.ndarray, window: int) -> tuple[list[tuple[int, int, int, int]], list[int]]:
    """The factors (first word, words, block, position in it) of a document, and the first words of found windows that straddle the
    end of a factor. windows: hashes of all windows of the document; seen: those in earlier blocks, with block and position."""
    order = np.argsort(seen)
    seen, block, place = seen[order], block[order], place[order]
    at = np.minimum(np.searchsorted(seen, windows), len(seen) - 1)
    hit = seen[at] == windows
    block, place = block[at], place[at]
    goes_on = np.zeros(len(windows), bool)
    goes_on[:-1] = hit[:-1] & hit[1:] & (block[:-1] == block[1:]) & (place[:-1] + 1 == place[1:])
    hits, stops = np.flatnonzero(hit), np.flatnonzero(~goes_on)
    factors, straddling, cursor = [], [], 0
    while (n := np.searchsorted(hits, cursor)) < len(hits):
        first = int(hits[n])
        last = int(stops[np.searchsorted(stops, first)])
        end = last + window
        factors.append((first, end - first, int(block[first]), int(place[first])))
        straddling += hits[np.searchsorted(hits, last + 1) : np.searchsorted(hits, end)].tolist()
        cursor = end
    return factors, straddling


def _finish(window: int):
    def run(batches):
        for b in batches:
            rows = []
            for doc, text, seen, first in zip(b.doc_id, b.text, b.seen, b["first"]):
                words, factors = (text or b"").split(), []
                keep = np.ones(len(words), bool)
                if first is not None and len(words) >= window:
                    keep[:], factors = False, [(0, len(words), int(first), 0)]
                elif seen is not None:
                    refs = [np.array([x[k] for x in seen], np.int64) for k in ("w0", "block", "place")]
                    factors, straddling = parse(gram_hashes(word_hashes(text), window).view(np.int64), *refs, window)
                    for start, n, *_ in factors:
                        keep[start : start + n] = False
                    for start in straddling:
                        keep[start : start + window] = False
                kept = b" ".join(words if keep.all() else [w for w, k in zip(words, keep) if k])
                rows.append((doc, len(words), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), len(factors), [list(f) for f in factors], kept.decode()))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "spans", "kept_text"])
            yield out.assign(doc_id=pd.array([None if x is None else int(x) for x in out.doc_id], dtype="Int64"))  # ids come as strings: a null would turn longs into doubles

    return run


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16) -> DataFrame:
    """Documents with every word removed that a window shared with a smaller doc_id covers.

    Returns a row for each row of docs: doc_id, n_words, n_removed, kept_sha256, n_factors, spans (array of factors: [first word,
    words, block, first word in the block]), kept_text. Null text is empty. A null doc_id is no reference for others and keeps its words. Rows that
    repeat a doc_id are that same document: they get their results each and do not remove each other. Texts under
    `window` words are kept whole. Work on tables of any size is by anchors and windows; no group meets in one task.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit("")).cast("binary")
    base = docs.select("doc_id", text.alias("text"))
    known = base.filter("doc_id is not null").groupBy("doc_id").agg(*[f(F.unhex(F.sha2("text", 256))).alias(n) for f, n in ((F.min, "digest"), (F.max, "other"))])
    known = stash(known.filter("digest = other").drop("other"))
    first = known.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = stash(join_split(known, first, ["digest"]).filter("doc_id > first").select("doc_id", F.col("first").cast("string").alias("first")))

    anchors = stash(base.filter("doc_id is not null").mapInPandas(_index(window, gram), "doc_id long, anchor long"))
    anchors = anchors.join(copies.select("doc_id"), "doc_id", "left_anti")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    wanted = stash(join_split(anchors, shared, ["anchor"], "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))

    windows = base.join(wanted, "doc_id", "left").mapInPandas(_windows(window, gram), "doc_id long, w0 long, w1 long, place long")
    index = windows.groupBy("w0", "w1").agg(F.min("doc_id").alias("block"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("place")).filter("block < last").drop("last")
    found = join_split(windows.drop("place"), index, ["w0", "w1"]).filter("block < doc_id")
    seen = found.groupBy("doc_id").agg(F.collect_list(F.struct("w0", "block", "place")).alias("seen"))
    tail = seen.withColumn("first", F.lit(None).cast("string")).unionByName(copies.select("doc_id", F.lit(None).cast(seen.schema["seen"].dataType).alias("seen"), "first"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long, spans array<array<long>>, kept_text string"
    return base.join(tail, "doc_id", "left").select(F.col("doc_id").cast("string"), "text", "seen", "first").mapInPandas(_finish(window), schema)
