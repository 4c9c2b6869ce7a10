"""Near-duplicate classes by BagMinHash: weighted-Jaccard signatures, banding, and an exact multiset check.

A document is the multiset of its five-word shingles. BagMinHash runs a Poisson process for each shingle over the levels
of its weight: the levels are grouped in dyadic blocks [0,1), [1,2), [2,4), ..., one process of the block's width as rate
runs over each block, and a point counts for a document if the level it falls on lies below the document's weight. A point
carries its time and one of the registers; a register keeps the earliest point, so two documents agree in a register with
a probability of exactly their weighted Jaccard similarity. Points come in ascending time, and a shingle stops once it
is later than the latest register.

Signatures are cut into bands. Buckets with the same members count once. Documents of a bucket are compared with the
bucket's smallest document, its leader. Where that leaves a bucket's other members in several classes, links between these
may be missing. A large such bucket falls apart first: a text that reaches the similarity with another one shares a feature
with it among a fifth of its own, whichever fifth an order common to both selects, and the order here takes features that the
leader lacks first. So texts that have only boilerplate in common meet no more. In what is left, everything outside the largest
class is compared with everything else, in blocks, so that no link between two classes is lost and no pair list is
written. All comparisons are exact. Of the texts only those in shared buckets move beyond the one join that finds them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected, gram_hashes, join_split, mix, n_words, shingles, small_batches, stash, word_hashes

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Register times, one row per document, of the multisets given as (doc, key, weight) triples."""
    times = np.full((n_docs, registers), np.inf)
    docs, seeds, lows, widths, weights = [], [], [], [], []
    low, width = 0, 1
    while len(key):
        docs.append(doc)
        seeds.append(mix(key ^ mix(np.full(1, low, _U))))
        weights.append(weight)
        lows.append(np.full(len(key), low, np.int64))
        widths.append(np.full(len(key), width, np.int64))
        low, width = low + width, low + width
        more = weight > low
        doc, key, weight = doc[more], key[more], weight[more]
    if not docs:
        return times
    doc, seed, low, width, weight = (np.concatenate(x) for x in (docs, seeds, lows, widths, weights))
    at, flat, last, n = np.zeros(len(doc)), times.reshape(-1), np.full(n_docs, np.inf), 0
    while len(doc):
        n += 1
        draw = mix(seed + _U(n * int(_STEP) % (1 << 64)))
        at = at - np.log(_unit(draw)) / width
        draw = mix(draw ^ _STEP)
        level = low + (_unit(mix(draw + _STEP)) * width).astype(np.int64)
        counts = (level < weight) & (at < last[doc])
        np.minimum.at(flat, doc[counts] * registers + (draw[counts] % _U(registers)).astype(np.int64), at[counts])
        live = np.unique(doc)
        last[live] = times[live].max(axis=1)
        go = at < last[doc]
        doc, seed, low, width, weight, at = (x[go] for x in (doc, seed, low, width, weight, at))
    return times


def _bands(k: int, bands: int, rows: int, chunk: int = 200_000):
    def signed(ids, bags):
        doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
        times = bag_signatures(doc, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags), bands * rows)
        keys = mix(times.view(_U).reshape(len(bags), bands, rows) + _STEP)
        total = mix(np.arange(1, bands + 1, dtype=_U) * _STEP)[None, :]
        for r in range(rows):
            total = mix(total ^ keys[:, :, r])
        return pd.DataFrame({"doc_id": np.array(ids, np.int64), "buckets": list(total.view(np.int64))})

    def run(batches):
        for b in batches:
            ids, bags, size = [], [], 0
            for doc, text in zip(b.doc_id, b.text):
                bag = shingles(text, k)
                if len(bag[0]):
                    ids.append(doc)
                    bags.append(bag)
                    size += len(bag[0])
                if size >= chunk:
                    yield signed(ids, bags)
                    ids, bags, size = [], [], 0
            if ids:
                yield signed(ids, bags)

    return run


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets of hashes with counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _verify(k: int, least: float):
    """Exact comparison of members with their leader. Rows come sorted by (leader, shard), the leader's texts first; only
    the current leader's multisets are held, so that memory does not grow with a group."""

    def run(batches):
        last, bags = None, []
        for x in batches:
            keep = []
            for leader, shard, doc, text in zip(x.leader, x.shard, x.doc_id, x.text):
                if (leader, shard) != last:
                    last, bags = (leader, shard), []
                bag = shingles(text, k)
                if doc == leader:
                    bags.append(bag)
                keep.append(doc != leader and any(similarity(bag, own) >= least for own in bags))
            yield pd.DataFrame({"a": x.doc_id[keep], "b": x.leader[keep]})

    return run


def _features(text: bytes, k: int) -> np.ndarray:
    """The multiset as a set: each repetition of a shingle counts as a feature of its own."""
    words = word_hashes(text)
    g = np.sort(gram_hashes(words, min(k, max(1, len(words)))))
    first = np.searchsorted(g, g)
    return mix(g + (np.arange(len(g)) - first).astype(_U) * _STEP)


def _cell(k: int, least: float, columns: int = 4096):
    """Exact comparison of the strays of a cell with all its members; links that join two classes, as a forest."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        sides = [x[x.stray], x[~x.stray]]
        sets = [[_features(t, k) for t in s.text] for s in sides]
        sizes = [np.array([len(f) for f in s], np.float64) for s in sets]
        if not len(sets[0]) or not len(sets[1]):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        flat = [np.concatenate(s) for s in sets]
        rows = [np.repeat(np.arange(len(s)), n.astype(int)) for s, n in zip(sets, sizes)]
        common = np.intersect1d(*flat)
        both = np.zeros((len(sets[0]), len(sets[1])), np.float32)
        places = []
        for f, r in zip(flat, rows):
            at = np.minimum(np.searchsorted(common, f), max(len(common) - 1, 0))
            hit = common[at] == f if len(common) else np.zeros(len(f), bool)
            order = np.argsort(at[hit], kind="stable")
            places.append((at[hit][order], r[hit][order]))
        for start in range(0, len(common), columns):
            dense = []
            for (at, r), s in zip(places, sets):
                lo, hi = np.searchsorted(at, [start, start + columns])
                m = np.zeros((len(s), columns), np.float32)
                m[r[lo:hi], at[lo:hi] - start] = 1
                dense.append(m)
            both += dense[0] @ dense[1].T
        total = sizes[0][:, None] + sizes[1][None, :] - both
        label = [s.label.to_numpy() for s in sides]
        hits = np.argwhere((both >= least * total - 1e-9) & (label[0][:, None] != label[1][None, :]))
        root: dict[int, int] = {}

        def find(v):
            while root.get(v, v) != v:
                v = root[v]
            return v

        links = []
        for i, j in hits:
            p, q = find(int(label[0][i])), find(int(label[1][j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((sides[0].doc_id.iat[i], sides[1].doc_id.iat[j]))
        return pd.DataFrame(links, columns=["a", "b"]).astype(np.int64)

    return run


def _candidates(docs: DataFrame, k: int, bands: int, rows: int, copies: DataFrame) -> DataFrame:
    """bucket, leader, doc_id: the members of every bucket that holds two documents or more. Of buckets with the same members
    (bands repeat them) one is kept, so that a pair meets once and not in each band."""
    signed = stash(docs.mapInPandas(_bands(k, bands, rows), "doc_id long, buckets array<long>"))
    signed = signed.join(copies.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti").select("doc_id", F.explode("buckets").alias("bucket"))
    leaders = signed.groupBy("bucket").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
    shared = stash(join_split(signed, leaders, ["bucket"]).distinct())
    return stash(_distinct_sets(shared).drop("last"))


def _distinct_sets(members: DataFrame) -> DataFrame:
    """members without buckets that hold the same documents as a bucket of a smaller number."""
    sets = members.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"))
    kept = sets.groupBy("lo", "hi", "n", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    return join_split(members, kept, ["bucket"], "left_semi")


def _beside_leader(texts: DataFrame, pairs: DataFrame, shard: int = 512) -> DataFrame:
    """leader, shard, doc_id, label, text of pairs (doc_id, leader, label), sorted, each leader's own texts first. A leader with many
    members has its text dealt to several shards; a text moves once for each leader, whatever the number of buckets."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    members = join_split(pairs, sizes, ["leader"]).select("doc_id", "leader", "label", F.pmod(F.xxhash64("doc_id"), "shards").cast("int").alias("shard"))
    leaders = sizes.select(F.col("leader").alias("doc_id"), "leader", F.col("leader").alias("label"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    rows = texts.join(members.union(leaders), "doc_id").select("leader", "shard", "doc_id", "label", "text")
    return rows.repartition("leader", "shard").sortWithinPartitions("leader", "shard", F.col("doc_id") != F.col("leader"))


def _star(texts: DataFrame, shared: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b): the members of buckets that are similar to their bucket's leader b."""
    rows = _beside_leader(texts, shared.filter("doc_id <> leader").select("doc_id", "leader", F.col("doc_id").alias("label")).distinct())
    return stash(rows.mapInPandas(_verify(k, least), "a long, b long"))


def _common(k: int, most: int = 1 << 23):
    """What the texts of a sample of a group have in common: the features that two or more of them hold, with their numbers of texts,
    and the group's sizes as they came. Texts are read until they hold `most` bytes."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        read = np.cumsum([len(t) for t in x.text]) - [len(t) for t in x.text] < most
        f, n = np.unique(np.concatenate([_features(t, k) for t in x.text[read]]), return_counts=True)
        return pd.DataFrame({"leader": x.leader.iloc[:1], "common": [f[n > 1].tobytes()], "counts": [n[n > 1].astype(np.int64).tobytes()], "sizes": x.sizes.iloc[:1]})

    return run


def _least_partner(n: int, sizes: np.ndarray, least: float) -> float:
    """The smallest size that a text similar to one of n features, and no longer, may have. sizes holds the smallest and the largest
    size, in turn, of parts of the group."""
    low = least * n
    fit = sizes[::2][sizes[1::2] >= low]
    return min(max(low, fit.min()), n) if len(fit) else low


def _prefix(k: int, least: float):
    """(leader, doc_id, label, feature, short) for each member of a leader's buckets: the features of which two texts of similarity
    `least` share one.

    Let x and y be such texts, x no shorter than y, in any order of features that is the same for both. They share
    least / (1 + least) * (|x| + |y|) features, where |y| is least * |x| or more and no less than the smallest such size in the group,
    and so 2 * least / (1 + least) * |y|. With these numbers, one of the first |x| - ceil(shared) + 1 of x is among the first
    |y| - ceil(shared) + 1 of y; the latter are marked `short`. Features that fewer texts of the group's sample hold come first, so
    that texts which differ from the group by more than the similarity permits meet by what they have beside it only.
    Rows come as in `_verify`; the row whose doc_id is the leader heads the group and yields nothing. It holds what `_common`
    found or, without that, a text that has been compared with all.
    """

    def run(batches):
        last, common, counts, sizes = None, np.empty(0, _U), np.empty(0, np.int64), np.empty(0)
        for x in batches:
            out = [(np.empty(0, np.int64),) * 4 + (np.empty(0, bool),)]
            found = zip(x.common, x.counts, x.sizes) if "common" in x else [(None, None, None)] * len(x)
            for leader, shard, doc, label, text, (known, texts, has) in zip(x.leader, x.shard, x.doc_id, x.label, x.text, found):
                if (leader, shard) != last:
                    last, common, counts, sizes = (leader, shard), np.empty(0, _U), np.empty(0, np.int64), np.empty(0)
                if doc == leader and known is not None:
                    common, counts, sizes = np.frombuffer(known, _U), np.frombuffer(texts, np.int64), np.array(has, np.float64)
                elif doc == leader:
                    common = np.union1d(common, _features(text, k))
                    counts = np.ones(len(common), np.int64)
                elif n := len(f := _features(text, k)):
                    at = np.minimum(np.searchsorted(common, f), max(len(common) - 1, 0))
                    order = np.lexsort((f, np.where(common[at] == f, counts[at], 0) if len(common) else f))
                    both = least / (1 + least) * (n + _least_partner(n, sizes, least)), 2 * least / (1 + least) * n
                    long, short = (n - math.ceil(share - 1e-9) + 1 for share in both)
                    out.append((np.full(long, leader), np.full(long, doc), np.full(long, label), f[order[:long]].view(np.int64), np.arange(long) < short))
            yield pd.DataFrame({name: np.concatenate(c) for name, c in zip(("leader", "doc_id", "label", "feature", "short"), zip(*out))})

    return run


def _mixed(members: DataFrame) -> DataFrame:
    """bucket, main, n, strays of every bucket (bucket, doc_id, label) that holds several classes: main is the largest one, strays counts
    the documents outside of it."""
    classes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sums = classes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays"))
    return sums.filter("strays > 0")


def _one_for_leader(members: DataFrame, by: str = "leader") -> DataFrame:
    """members (bucket, leader, doc_id, label, main, n, strays) where the buckets of a leader are one, if that takes no more comparisons
    than bucket by bucket. The bands of one group of near copies are many buckets of nearly the same texts, and a pair met in each.
    By `main` the same is done with all buckets that have the same largest class; a number of their own is their leader."""
    apart = members.groupBy(by, "bucket").agg(F.first(F.col("n") * F.col("strays")).alias("pairs")).groupBy(by).agg(F.sum("pairs").alias("apart"), F.count("*").alias("buckets")).filter("buckets > 1")
    docs = stash(join_split(members, apart, [by]).select(F.col(by).alias("group"), "doc_id", "label").distinct())
    classes = docs.groupBy("group", "label").agg(F.count("*").alias("n"))
    sums = classes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays"))
    one = stash(sums.join(apart.withColumnRenamed(by, "group"), "group").filter("n * strays <= apart").select("group", "main", "n", "strays"))
    bucket = F.xxhash64("group") if by == "leader" else F.xxhash64("group", F.lit(by))
    whole = join_split(docs, one, ["group"]).withColumn("bucket", bucket)
    whole = whole.withColumn("leader", F.col("group") if by == "leader" else F.col("bucket")).drop("group")
    return join_split(members, one.select(F.col("group").alias(by)), [by], "left_anti").unionByName(whole)


def _headed(texts: DataFrame, big: DataFrame, k: int, sample: int = 32, shard: int = 512) -> DataFrame:
    """Rows for `_prefix`: the members of groups (leader, doc_id, label) with their texts, dealt to shards; each shard is headed by what
    about `sample` of the group's texts have in common. The sample settles an order of features only; every order gives the same links."""
    groups = stash(big.groupBy("leader").agg(F.count("*").alias("n")))
    place = F.xxhash64("doc_id", F.lit("sample"))
    members = join_split(big, groups, ["leader"]).select("leader", "doc_id", "label", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / shard)).cast("int").alias("shard"), (F.pmod(place, F.ceil(F.col("n") / sample)) == 0).alias("sampled"))
    rows = stash(texts.join(members, "doc_id").select("leader", "shard", "doc_id", "label", "text", "sampled"))
    size = F.greatest(F.lit(1), n_words(F.col("text").cast("string")) - k + 1)
    sizes = rows.select("leader", size.alias("size")).groupBy("leader", F.floor(20 * F.log("size")).alias("step")).agg(F.array(F.min("size"), F.max("size")).alias("ends"))
    sizes = sizes.groupBy("leader").agg(F.flatten(F.collect_list("ends")).alias("sizes"))
    found = join_split(rows.filter("sampled"), sizes, ["leader"]).select("leader", "text", "sizes").groupBy("leader")
    found = found.applyInPandas(_common(k), "leader long, common binary, counts binary, sizes array<long>")
    shards = groups.select("leader", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / shard) - 1).cast("int"))).alias("shard"))
    heads = shards.join(found, "leader").select("leader", "shard", F.col("leader").alias("doc_id"), F.col("leader").alias("label"), F.lit(None).cast("binary").alias("text"), "common", "counts", "sizes")
    return rows.drop("sampled").unionByName(heads, allowMissingColumns=True)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("leader", "shard").sortWithinPartitions("leader", "shard", F.col("doc_id") != F.col("leader"))


def _from_middle(k: int):
    """(leader, doc_id, label, far): in how many features each member of `_headed`'s groups differs from what most of the sample hold."""

    def run(batches):
        last, middle = None, np.empty(0, _U)
        for x in batches:
            far = []
            for leader, shard, doc, text, known, texts in zip(x.leader, x.shard, x.doc_id, x.text, x.common, x.counts):
                if (leader, shard) != last:
                    last, middle = (leader, shard), np.empty(0, _U)
                if doc == leader and known is not None:
                    counts = np.frombuffer(texts, np.int64)
                    middle = np.frombuffer(known, _U)[2 * counts > counts.max(initial=0)]
                    far.append(-1)
                else:
                    f = _features(text, k)
                    far.append(len(f) + len(middle) - 2 * len(np.intersect1d(f, middle, assume_unique=True)))
            far = np.array(far, np.int64)
            yield pd.DataFrame({"leader": x.leader, "doc_id": x.doc_id, "label": x.label, "far": far})[far >= 0]

    return run


def _middle_links(texts: DataFrame, rows: DataFrame, big: DataFrame, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the members of `_headed`'s groups to the group's middle, the member that differs least from what most have in
    common, and (node, label), the labels that become one by them. A bucket's leader may be any text; of a group of copies
    that each differ from one text in some places, the middle is similar to nearly all that are similar to any."""
    middles = stash(_dealt(rows).mapInPandas(_from_middle(k), "leader long, doc_id long, label long, far long"))
    middles = middles.groupBy("leader").agg(F.min_by(F.struct("doc_id", "label"), F.struct("far", "doc_id")).alias("middle"))
    pairs = join_split(big, middles, ["leader"]).filter("label <> middle.label")
    pairs = stash(pairs.select("doc_id", F.col("middle.doc_id").alias("leader"), "label", F.col("middle.label").alias("main")).distinct())
    links = _star(texts, pairs, k, least)
    classes = links.join(pairs, (F.col("a") == F.col("doc_id")) & (F.col("b") == F.col("leader"))).select(F.col("label").alias("a"), F.col("main").alias("b"))
    return links, connected(classes)


def _large(members: DataFrame, large: int) -> DataFrame:
    """leader, pairs: the comparisons within the buckets of each leader that has a bucket of over `large` documents."""
    whole = members.groupBy("bucket", "leader").agg(F.first("n").alias("n"), F.first("strays").alias("strays"))
    return whole.groupBy("leader").agg(F.sum(F.col("n") * F.col("strays")).alias("pairs"), F.max("n").alias("n")).filter(F.col("n") > large).drop("n")


def _fallen_apart(texts: DataFrame, tagged: DataFrame, mixed: DataFrame, k: int, least: float, large: int) -> tuple[DataFrame, DataFrame | None]:
    """bucket, doc_id, label, main: the members of mixed buckets, where large buckets are replaced by groups of documents that share a
    feature of `_prefix`, and the links (a, b) to the middles of large buckets, which labels hold already. Buckets and groups hold every
    other pair that may be linked; a leader's buckets stay whole where groups would need more comparisons."""
    members = stash(_one_for_leader(stash(join_split(tagged, mixed, ["bucket"])), "main"))
    members = stash(_one_for_leader(members))
    big = stash(join_split(members, _large(members, large), ["leader"]).select("leader", "doc_id", "label").distinct())
    if big.isEmpty():
        return members.select("bucket", "doc_id", "label", "main"), None
    rows = _headed(texts, big, k)
    links, labels = _middle_links(texts, rows, big, k, least)
    labels = labels.select(F.col("node").alias("label"), F.col("label").alias("to"))
    relabelled = lambda x: x.join(labels, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")
    members = stash(relabelled(members.drop("main", "n", "strays")))
    members = stash(join_split(members, _mixed(members), ["bucket"]))
    whole = stash(_large(members, large))
    rows = _dealt(relabelled(rows.join(whole.select("leader"), "leader", "left_semi")))
    features = rows.mapInPandas(_prefix(k, least), "leader long, doc_id long, label long, feature long, short boolean")
    features = stash(features.withColumn("bucket", F.xxhash64("leader", "feature")).drop("feature"))
    classes = features.groupBy("leader", "bucket", "label").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    groups = classes.groupBy("leader", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("strays"), F.max("short").alias("short"))
    groups = stash(groups.filter("strays > 0 and short"))
    needed = groups.groupBy("leader").agg(F.sum(F.col("n") * F.col("strays")).alias("needed"))
    fallen = whole.join(needed, "leader", "left").filter(F.coalesce("needed", F.lit(0)) < F.col("pairs")).select("leader")
    fallen = stash(fallen)
    stay = join_split(members, fallen, ["leader"], "left_anti").select("bucket", "doc_id", "label", "main")
    chosen = stash(groups.join(fallen, "leader", "left_semi").select("bucket", "main"))
    return stay.union(join_split(features, chosen, ["bucket"]).select("bucket", "doc_id", "label", "main").distinct()), links


def _stray_links(texts: DataFrame, shared: DataFrame, labels: DataFrame, sizes: DataFrame, k: int, least: float, block: int, most: int) -> DataFrame:
    """(a, b): links between classes that the comparison with leaders left apart in one bucket. Leaders have been compared with
    all, so others remain: what is outside the largest class of a bucket, or of a group that it fell into, is compared with all
    of it, in cells of two blocks of about `block` bytes and `most` texts."""
    tagged = shared.filter("doc_id <> leader").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    tagged = stash(tagged.select("bucket", "leader", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    members, links = _fallen_apart(texts, tagged, _mixed(tagged), k, least, 2 * most)
    members = stash(_distinct_sets(stash(members)).join(sizes, "doc_id"))
    stray = F.col("label") != F.col("main")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(F.coalesce(F.sum(size), F.lit(0)) / block), F.ceil(F.count(size) / most)).cast("int")
    counts = members.groupBy("bucket").agg(blocks(F.col("size")).alias("all_blocks"), blocks(F.when(stray, F.col("size"))).alias("stray_blocks"))
    members = join_split(members, counts, ["bucket"])
    place = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = members.select("bucket", each("stray_blocks").alias("i"), place("all_blocks").alias("j"), F.lit(False).alias("stray"), "doc_id", "label")
    strays = members.filter(stray).select("bucket", place("stray_blocks").alias("i"), each("all_blocks").alias("j"), F.lit(True).alias("stray"), "doc_id", "label")
    cells = texts.join(every.union(strays), "doc_id")
    found = cells.groupBy("bucket", "i", "j").applyInPandas(_cell(k, least), "a long, b long")
    return stash((found.union(links) if links else found).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 32, rows: int = 6, block: int = 4_000_000, most: int = 128) -> DataFrame:
    """doc_id and class_id (the smallest doc_id of the class) for each row of docs.

    Two documents are linked if the weighted Jaccard similarity of their k-word shingle multisets is `least` or more;
    classes are what links connect. Texts under k words are one shingle; null and blank texts have none and are a class of
    their own, as are rows whose doc_id is null (class_id null). Rows that repeat a doc_id are one document, linked by any of
    its texts. Two texts of similarity 0.8 share no band with a probability of (1 - 0.8**6)**32 = 6e-5. Copies
    are compared once. Texts of any length are hashed whole; `block` bounds the bytes of text, and `most` the texts, that one
    comparison of two blocks holds, but for a single longer text; buckets of over twice `most` may fall apart first. Neither
    changes the classes. Extra columns are not read.
    """
    small_batches(docs.sparkSession)
    base = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    full = F.max(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]")).alias("full")
    digest = F.unhex(F.sha2("text", 256))
    known = stash(base.groupBy("doc_id").agg(F.min(digest).alias("digest"), F.max(digest).alias("other"), F.max(F.length("text")).alias("size"), full))
    alike = known.filter("digest = other and full")
    first = alike.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = stash(join_split(alike, first, ["digest"]).filter("doc_id > first").select("doc_id", "first"))

    shared = _candidates(base, k, bands, rows, copies)
    texts = stash(base.join(shared.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi"))
    star = _star(texts, shared, k, least)
    labels = connected(star)
    rest = _stray_links(texts, shared, labels, known.select("doc_id", "size"), k, least, block, most)
    if not rest.isEmpty():
        labels = connected(star.union(rest))

    labels = labels.withColumnRenamed("node", "rep")
    with_rep = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(copies, "doc_id", "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep"))
    return with_rep.join(labels, "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
