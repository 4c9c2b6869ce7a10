"""Toxicity, hard negatives and importance resampling against brute force, on odd rows, and on held-out words."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loamline.llm")
from loamline.llm import hard_negatives, importance, toxicity  # noqa: E402

R = random.Random(5)


def word(n=6):
    return "".join(R.choice("abcdefghijklmnoprstu") for _ in range(n))


PLAIN = [word(R.randint(3, 8)) for _ in range(300)]
BAD = ["grumblefink", "snotwaffle", "dunderhead"]


def text(n, bad=()):
    ws = [R.choice(PLAIN) for _ in range(n)]
    for b in bad:
        ws[R.randrange(n)] = b
    return " ".join(ws)


# ---------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def labelled_texts(spark):
    sizes = [R.randint(5, 400) for _ in range(400)]
    rows = [(i, text(n, [R.choice(BAD) for _ in range(max(2, n // 25))] if i % 4 == 0 else ()), 1, "x") for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, toxic string")  # extra columns with clashing names
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (5, 7)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_on_texts_held_out(labelled_texts):
    got = {r.doc_id: r for r in toxicity.score(*labelled_texts).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert [i for i in got if got[i].held_out] == held and len(held) > 50
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) >= 0.95
    assert all(got[i].predicted == (got[i].score >= 0.5) and 0 <= got[i].score <= 1 for i in got)


def test_misspellings_share_vectors(labelled_texts):
    model = toxicity.learn(*labelled_texts)
    strange = sorted(model.word(w) for w in (word(9) for _ in range(200)))
    for unseen in ("grumblefinks", "grumblef1nk", "snotwafle", "dunderheaad"):
        assert model.word(unseen) > strange[-5]
    known = model.words()
    assert model.score(" ".join(PLAIN[:20]) + " snotwafffle dunderheads grumblefinkk!", known) >= 0.5 > model.score(" ".join(PLAIN), known)


def test_toxicity_odd_rows(spark, labelled_texts):
    rows = [(None, "a"), (1, None), (1, ""), (1, " \n"), (2, "x" * 50_000), (2, "x" * 50_000), (3, text(20_000, [R.choice(BAD) for _ in range(400)]))]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labelled_texts[1].filter("false")).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5} and sum(r.held_out for r in got) >= 1
    model = toxicity.learn(*labelled_texts)
    assert model.score(rows[-1][1], model.words()) >= 0.5 > model.score("", model.words()) == model.score(" \t", model.words())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.score(empty, labelled_texts[1]).collect() == []


def test_training_repeats():
    bags = [([[R.choice(PLAIN) for _ in range(20)] + (["grumblefink"] if i % 3 == 0 else [])], int(i % 3 == 0)) for i in range(90)]
    a, b = toxicity.train(bags), toxicity.train(bags)
    assert (a.gain == b.gain).all() and a.bias == b.bias


# ---------------------------------------------------------------- 12


def brute_negatives(rows, every):
    best = {}
    for i, label, x in rows:
        if i is not None and label is not None and x and all(v is not None and math.isfinite(v) for v in x):
            best[i] = min(best.get(i, (x, label)), (x, label))
    whole = {i: (label, [math.floor(256 * v) for v in x]) for i, (x, label) in best.items()}
    out = set()
    for a, (label, q) in whole.items():
        if a % every:
            continue
        score = {i: sum(p * r for p, r in zip(q, v)) for i, (_, v) in whole.items() if i != a and len(v) == len(q)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if whole[i][0] == label][:5]:
            fits = [i for i in order if whole[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out |= {(a, p, n + 1, i, score[p], score[i]) for n, i in enumerate(fits[:3])}
    return out


def vectors_of(spark, rows):
    rows = [(i, label, x, 1, "g") for i, label, x in rows]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, g int, positives string").repartition(3)


def test_hard_negatives(spark):
    rng = np.random.default_rng(2)
    f32 = lambda d: [float(x) for x in rng.normal(0, 0.4, d).astype(np.float32)]
    rows = [(i, int(rng.integers(4)) if i % 3 else 0, f32(70)) for i in range(260)]  # a label with a third of the rows and more
    rows += [(1000 + i, 1, rows[50][2]) for i in range(20)] + [(2000 + i, 2, f32(3)) for i in range(0, 40, 5)] + [(2001 + i, 3, f32(3)) for i in range(0, 40, 5)]
    rows += [(7, 1, rows[7][2]), (7, 3, f32(70)), (None, 1, f32(70)), (300, None, f32(70)), (301, 1, None), (302, 1, []), (303, 1, [None] * 70), (350, 1, [math.nan] * 70), (400, 9, f32(70))]
    want = brute_negatives(rows, 10)
    for block, chunk in ((1024, 32), (16, 7)):
        got = hard_negatives.mine(vectors_of(spark, rows), every=10, block=block, chunk=chunk).collect()
        assert len(got) == len(want) > 100 and {tuple(r) for r in got} == want
    assert hard_negatives.mine(vectors_of(spark, rows).filter("false")).collect() == []


def test_tiles_of_large_products():
    """Products beyond what doubles hold are added exactly."""
    rows = [(i, i % 2, 3 if i % 2 else 1, True, [2**40 + i, 2**20], [9, 2**62]) for i in range(2)] + [(9, 0, 1, False, [2**20 + 1, -3], None)]
    import pandas as pd

    cell = pd.DataFrame(rows, columns=["vec_id", "label", "w", "anchor", "x", "positives"])
    tile = hard_negatives._partial((2, 0, 0, 0, 0), cell)
    *_, positives, scores = hard_negatives._added(tile)
    assert scores.tolist() == [[(2**40 + i) * (2**20 + 1) - 3 * 2**20] for i in range(2)] and positives.tolist() == [[9, 2**62]] * 2


def test_hard_negatives_shuffle_grows_with_the_rows(spark):
    """Scores and copies of vectors stay in the tasks that multiply them: over twice the rows, four times the pairs, about twice as much is shuffled."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    rng, took = np.random.default_rng(3), []
    for n in (2000, 4000):
        v = rng.normal(0, 0.4, (n, 16)).astype(np.float32)
        before = written()
        frame = vectors_of(spark, [(i, int(rng.integers(4)), [float(x) for x in v[i]]) for i in range(n)])
        assert hard_negatives.mine(frame, every=5, block=32, chunk=8).count() > n // 5
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        took.append(written() - before)
    assert took[0] > 0 and took[1] < 2.6 * took[0]


# ---------------------------------------------------------------- 13


def brute_resample(docs, target):
    def features(t):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(ws), Counter(zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(ws) - n + 1))

    rows = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in rows:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out, fits = [], []
    for i, n, f in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] * c for b, c in f.items())
        out.append([i, sum(f.values()), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            fits.append(out[-1])
    for rank, row in enumerate(sorted(fits, key=lambda r: (-r[3], r[0] is None, r[0] or 0))[: 5 * len(fits) // 100], 1):
        row[4] = rank
    return Counter(map(tuple, out))


def test_importance(spark):
    docs = [(i, text(R.randint(0, 60)).title() + R.choice(["", "-Ünïcode 3x", "\nA1 b2"])) for i in range(400)]
    docs += [(500 + i, "One two THREE four " * 6) for i in range(30)] + [(500, "One two THREE four " * 6), (None, text(40)), (600, None), (601, ""), (602, "!! ??"), (603, "w" * 5000 + " é" * 300), (604, text(200_000)), (605, "word"), (606, "two words")]
    target = [text(30) for _ in range(20)] + ["one two three", None, ""]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, part int, weight int, bucket int").repartition(6)
    aim = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "doc_id long, text string")
    got = Counter(tuple(r) for r in importance.resample(frame, aim).collect())
    want = brute_resample(docs, target)
    assert (got - want, want - got) == (Counter(), Counter()) and sum(r[4] is not None for r in got) >= 10  # the generator is shared, so the number depends on the tests run before
    assert importance.resample(frame.filter("false"), aim).collect() == []
    alone = importance.resample(frame, aim.filter("false")).collect()
    assert Counter(map(tuple, alone)) == brute_resample(docs, [])


def test_csr_blocks_are_read_in_small_groups(spark):
    """However many blocks a file has, few are read at a time."""
    import pyarrow.parquet as pq

    r = random.Random(8)
    frame = spark.createDataFrame([(i, " ".join(str(r.randrange(10**6)) for _ in range(100))) for i in range(6000)], "doc_id long, text string").coalesce(1)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in importance.csr(frame).inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 30 and len(groups) >= 3
    assert max(g.total_byte_size for g in groups) < 4 << 20


def test_crc_of_joined_strings():
    joiner = importance._Joiner(8)
    pairs = [(R.randbytes(R.randint(0, 30)), R.randbytes(n)) for n in (0, 1, 2, 7, 8, 9, 40, 300)]
    crc = lambda side: np.array([zlib.crc32(p[side]) for p in pairs], np.uint32)
    got = joiner.join(crc(0), crc(1), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_buckets_of_a_leader_are_compared_once(spark):
    from loamline.llm import near_dedup

    # 20 bands of leader 1 hold nearly the same 60 documents; leader 500's two buckets share none
    near = [(b, 1, d, d if d % 6 == 0 else 1) for b in range(20) for d in range(2, 62) if d % 20 != b]
    apart = [(100 + d // 100, 500, d, d if d % 50 == 0 else 500 + d // 100) for d in range(601, 800)]
    tagged = spark.createDataFrame(near + apart, "bucket long, leader long, doc_id long, label long")
    members = tagged.join(near_dedup._mixed(tagged), "bucket")
    rows = near_dedup._one_for_leader(members).collect()
    assert len([r for r in rows if r.leader == 1]) == 60 and len({r.bucket for r in rows if r.leader == 1}) == 1
    assert {(r.n, r.strays, r.main) for r in rows if r.leader == 1} == {(60, 10, 1)}
    assert {r.bucket for r in rows if r.leader == 500} == {106, 107} and len([r for r in rows if r.leader == 500]) == 199


def test_middles_link_what_leaders_leave(spark, monkeypatch):
    """Texts with one passage in common, more or less of their own, and leaders with most of it: what leaders leave is linked by the
    group's middle, few comparisons remain, and classes are those of all pairs."""
    from pyspark.sql import functions as F

    from loamline.llm import near_dedup

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    passage = [word() for _ in range(300)]
    own = [80] * 40 + [r.randint(1, 70) for _ in range(160)]
    table = [(i, " ".join([*passage, *(word() for _ in range(n))])) for i, n in enumerate(own)]
    seen, whole = [], near_dedup._distinct_sets

    def kept(members):
        if "main" in members.columns:
            seen.append(members)
        return whole(members)

    monkeypatch.setattr(near_dedup, "_distinct_sets", kept)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs, most=16).collect()}
    bags = [near_dedup.shingles(t.encode()) for _, t in table]
    root = list(range(len(table)))
    for i in range(len(table)):
        for j in range(i + 1, len(table)):
            if root[i] != root[j] and near_dedup.similarity(bags[i], bags[j]) >= 0.8:
                root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    assert got == dict(enumerate(root)) and len(set(root)) > 40
    work = sum(x.n * x.s for x in seen[0].groupBy("bucket").agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("main")).cast("int")).alias("s")).collect())
    assert work <= 4 * len(table)
