"""Every operator of the llm package against brute force on small tables, and on nulls, empty tables, repeated rows and odd columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

pytest.importorskip("loamline.llm")
from loamline.llm import licenses, mixing, near_dedup, packing, pii, quality, substring_dedup, url_filter, vectors  # noqa: E402

RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijkl") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def edited(text, share):
    return " ".join(RNG.choice(VOCABULARY) if RNG.random() < share else w for w in text.split())


def corpus():
    """Copies, near copies in chains, shared passages, nulls, blanks, repeated rows, equal ids with different texts, one very long text."""
    base, passage, hot = prose(300), prose(80), prose(60)
    rows = [(i, prose(RNG.randint(1, 250)), f"s{i % 3}") for i in range(1, 40)]
    rows += [(100 + i, base, "s0") for i in range(4)] + [(110 + i, edited(base, 0.004 * i), "s0") for i in range(25)]
    rows += [(200 + i, f"{prose(40)} {passage}  \t{prose(30)}", None) for i in range(4)] + [(210 + i, f"{prose(5 + i)}\n{hot}", "s1") for i in range(30)]
    rows += [(300, None, "s1"), (301, "", None), (302, " \n\t ", "s1"), (303, "one", "s2"), (304, "one", "s2"), (305, "é" * 50 + " ü", "s2")]
    rows += [(None, base, "s0"), (None, None, None), (7, rows[6][1], rows[6][2]), (7, rows[6][1], rows[6][2]), (8, prose(100), "s1"), (400, prose(20_000), "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names the operators use inside."""
    rows = [(i, t, s, 1, 2, 3, 4) for i, t, s in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, bucket int, nth int, label int").repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


WORD = re.compile("[^\x20\x09-\x0d]+")


def words(t):
    return WORD.findall(t or "")


# ---------------------------------------------------------------- 6


def test_substring_dedup(docs, rows):
    first = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = Counter()
    for i, t, _ in rows:
        w = words(t)
        keep = [True] * len(w)
        for j in range(len(w) - 49):
            if i is not None and first[tuple(w[j : j + 50])] < i:
                keep[j : j + 50] = [False] * 50
        kept = " ".join(x for x, k in zip(w, keep) if k)
        want[(i, len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    got = substring_dedup.remove_repeats(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == want
    assert sum(r.n_removed for r in got) > 2000
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(words(t))
    for r in got:
        assert len(r.spans) == r.n_factors and all(a + n <= b for (a, n, *_), (b, *_) in zip(r.spans, r.spans[1:]))
        for start, n, block, place in r.spans:  # every factor stands so in its block, an earlier document
            assert n >= 50 and block < r.doc_id
            assert any(w[start : start + n] == v[place : place + n] for w in texts[r.doc_id] for v in texts[block])


def test_substring_parse_is_greedy(spark):
    """A passage that one block holds whole is one factor; where blocks change the cursor moves on, and windows across the border count."""
    a, b, own = prose(120).split(), prose(130).split(), prose(30).split()
    mixed = a[10:100] + b[20:90]
    rows = [(1, a), (2, b), (3, a[60:] + b[:80]), (4, own + a[5:115] + own), (5, own + mixed + own[:7]), (6, own[::-1] + a[60:] + b[:80])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    assert [list(s) for s in got[4].spans] == [[30, 110, 1, 5]]
    assert [list(s) for s in got[5].spans] == [[30, 90, 1, 10], [120, 70, 2, 20]]
    assert [list(s) for s in got[6].spans] == [[30, 60, 1, 60], [90, 80, 2, 0]] and got[6].n_removed == 140
    assert got[3].n_removed == 140 and got[1].n_factors == 0


def test_substring_windows_across_factor_ends():
    """Windows 0-2 stand in block 7, 3-9 in block 9: the factor of three windows ends inside of theirs."""
    windows = np.arange(100, 112)
    seen = np.arange(100, 110)
    block, place = np.where(seen < 103, 7, 9), np.where(seen < 103, seen, seen + 40)
    factors, straddling = substring_dedup.parse(windows, seen, block, place, 5)
    assert factors == [(0, 7, 7, 100), (7, 7, 9, 147)] and straddling == [3, 4, 5, 6]


# ---------------------------------------------------------------- 9


def test_near_duplicates(docs, rows):
    bags = {}
    for i, t, _ in rows:
        w = words(t)
        if i is not None and w:
            k = min(5, len(w))
            bags.setdefault(i, []).append(Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)))
    root = {i: i for i, _, _ in rows if i is not None}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = 0
    for a in bags:
        for b in bags:
            if a < b and any(sum((x & y).values()) >= 0.8 * sum((x | y).values()) for x in bags[a] for y in bags[b]):
                links += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = [(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect()]
    assert Counter(got) == Counter((i, None if i is None else find(i)) for i, _, _ in rows)
    assert links >= 30


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    b[:200] = a[:200]
    triples = [(np.full((w > 0).sum(), d), keys[w > 0], w[w > 0]) for d, w in enumerate((a, b))]
    s = near_dedup.bag_signatures(*(np.concatenate(x) for x in zip(*triples)), 2, 4096)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_cells_find_what_leaders_miss(spark):
    """A chain whose members are each similar to the next one, not to the smallest."""
    words_ = prose(400).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words_)))
        for p in RNG.sample(range(400), 5):
            words_[p] = RNG.choice(VOCABULARY) + "x"
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=3).collect()
    assert {r.class_id for r in got} == {0}


def boilerplate(n, seed, shared=300, own=90):
    """n texts that hold the same long passage, and near copies of every eighth of them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    passage, rows = [word() for _ in range(shared)], []
    for i in range(n):
        rows.append([*passage, *(word() for _ in range(own))])
        if i % 8 == 0:
            rows.append([word() if p in (40, 350, 380) else w for p, w in enumerate(rows[-1])])
    r.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("most", [4, 1000])
def test_strays_among_boilerplate(spark, most):
    """Texts in the same buckets, of which few are alike: large buckets fall apart before texts are compared, and no link is
    lost. Without labels from leaders all texts are strays."""
    table = boilerplate(120, 3)
    bags = {i: Counter(zip(*(t.split()[j:] for j in range(5)))) for i, t in table}
    docs = spark.createDataFrame(table, "doc_id long, text string")
    base = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    shared = near_dedup._candidates(base, 5, 32, 6, docs.filter("false"))
    no_labels = spark.createDataFrame([], "node long, label long")
    sizes = docs.select("doc_id", F.length("text").alias("size"))
    links = {(r.a, r.b) for r in near_dedup._stray_links(base, shared, no_labels, sizes, 5, 0.8, 4_000_000, most).collect()}
    buckets = {}
    for r in shared.filter("doc_id <> leader").collect():
        buckets.setdefault(r.bucket, []).append(r.doc_id)
    met = {(a, b) for ids in buckets.values() for a in ids for b in ids if a < b}
    alike = {(a, b) for a, b in met if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values())}
    assert {(min(x), max(x)) for x in links} == alike and 10 <= len(alike) < len(met) / 20


def test_prefixes_hold_a_common_feature():
    """Of two texts as alike as asked, the shorter one's short prefix meets the longer one's prefix, whatever the leader."""
    for seed in range(60):
        r = random.Random(seed)
        y = [r.choice(VOCABULARY) for _ in range(r.randint(20, 90))]
        x = [w if r.random() > 0.02 else r.choice(VOCABULARY) for w in y] + [r.choice(VOCABULARY) for _ in range(r.randint(0, 8))]
        lead = [w if r.random() > 0.2 else "lead" for w in y]
        texts = [" ".join(w).encode() for w in (lead, x, y)]
        if near_dedup.similarity(*(near_dedup.shingles(t) for t in texts[1:])) < 0.8:
            continue
        rows = pd.DataFrame({"leader": 0, "shard": 0, "doc_id": [0, 1, 2], "label": [0, 1, 2], "text": texts})
        got = next(near_dedup._prefix(5, 0.8)([rows]))
        sides = {d: g for d, g in got.groupby("doc_id")}
        assert set(sides[1].feature) & set(sides[2].feature[sides[2].short])


# ---------------------------------------------------------------- 5


def test_mixing(docs, rows):
    got = mixing.mix(docs)
    out = got.collect()
    size = Counter((s, i, len(words(t))) for i, t, s in rows)
    assert Counter((r.source, r.doc_id, r["size"]) for r in out) == size
    total = Counter()
    for (s, _, n), k in size.items():
        total[s] += n * k
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    fixed, everything = {}, sum(total.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = everything - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: rest * weight[s] / share for s in free} if free else {}
        over = [s for s in free if target[s] > 3 * total[s] + 1e-9]
        if not over:
            break
        fixed |= {s: 3.0 * total[s] for s in over}
    target |= fixed
    for r in out:
        assert r.source_size == total[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r["size"]
    assert sorted(out, key=str) == sorted(mixing.mix(docs.repartition(3)).collect(), key=str)


def test_mixing_meets_targets_with_many_documents(spark):
    rows = [(i, prose(RNG.choice([5, 20, 60, 400])), "a" if i % 3 else f"b{i % 4}") for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 400 for r in out), out


# ---------------------------------------------------------------- 2


def test_packing(docs, rows):
    lengths = (64, 256, 1024)
    out = packing.best_fit(docs, lengths, group=40).collect()
    size = Counter()
    for r in out:
        size[(r.doc_id, r.nth, r.start + r.length if r.piece >= 0 else 0)] += 0
        assert (r.bin_id is None) == (r.length == 0)
    total = Counter()
    for r in out:
        total[r.doc_id] += r.length
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(words(t))
    assert total == want
    bins = {}
    for r in out:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    for parts in bins.values():
        parts.sort(key=lambda r: r.bin_offset)
        used = sum(p.length for p in parts)
        assert [p.bin_offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        assert {p.bin_length for p in parts} == {min(n for n in lengths if n >= used)}
    assert sorted(out, key=str) == sorted(packing.best_fit(docs.repartition(2), lengths, group=40).collect(), key=str)


def least_cost(sizes, lengths):
    """The least cost of any partition into permitted lengths, by trying all."""
    best = [np.inf]

    def go(i, bins):
        if i == len(sizes):
            best[0] = min(best[0], sum(packing.cost(min(n for n in lengths if n >= b), max(lengths)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= max(lengths):
                go(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
        go(i + 1, bins + [sizes[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_least_cost():
    rng = np.random.default_rng(8)
    ratios, opened = [], set()
    for n in (3, 5, 7, 8, 8, 8) * 4:
        top = rng.choice([120, 400, 900])
        sizes = np.sort(rng.integers(1, top, n))[::-1].copy()
        of, offset, final = packing.pack(sizes, (128, 256, 512, 1024))
        opened |= set(final.tolist())
        ratios.append(sum(packing.cost(b, 1024) for b in final) / least_cost(sizes.tolist(), (128, 256, 512, 1024)))
    assert max(ratios) < 1.35 and np.mean(ratios) < 1.06, ratios
    assert opened == {128, 256, 512, 1024}


def test_packing_opens_the_length_that_suits_the_sizes():
    """Lengths are chosen jointly: pieces that leave much room in one length go to another."""
    chosen = set()
    for size in (300, 500, 700, 1000, 1365, 2000, 8000):
        final = packing.pack(np.full(480, size))[2]
        price = {n: packing.cost(n, 8192) / (n // size * size) for n in packing.LENGTHS if n >= size}
        best = [n for n in price if price[n] <= min(price.values()) + 1e-12]
        chosen |= set(best)
        assert np.isin(final, best).mean() > 0.8, (size, np.unique(final, return_counts=True))
    assert len(chosen) >= 4


def test_packing_sequences_hold_the_words(spark):
    rows = [(i, prose(RNG.randint(1, 90))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.sequences(packing.best_fit(docs, (32, 64)), docs).collect()
    assert Counter(w for r in out for w in r.words) == Counter(w for _, t in rows for w in t.split())


# ---------------------------------------------------------------- 3

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda m: len(re.sub("[^0-9]", "", m[0]))
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= n(m) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= n(m) <= 15]


def test_base_spans():
    texts = ["a@b@c.com", "@x.y@z.w", "é a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.255", "4539 1488-0343 6467 x 4539148803436468", "+1 (017) 555-7713 +12 +1234567890123456", "", "a@b", "+1--2", "١٢٣.1.1.1 1.1.1.1"]
    alphabet = "0123456789+-. ()@abé%\n"
    texts += ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(1, 200))) for _ in range(400)]
    texts += ["".join(RNG.choice("0459. -@a") for _ in range(120)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_detection(spark):
    card = "4539148803436467"
    rows = [(1, f"see 1.2.3.4 and a@b.org, {card} or +1 (017) 555-7713."), (2, None), (3, ""), (None, "x@y.z"), (1, f"see 1.2.3.4 and a@b.org, {card} or +1 (017) 555-7713."), (4, f"call 7536784127813051 {card} now"), (5, "plain prose of 12 words, at 3.14 and 2024-01-02, order 1234567"), (6, "9" * 200_000 + "@" + "1." * 50_000)]
    out = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out.collect())
    want = Counter()
    for i, t in rows:
        spans = plain_spans(t or "") if i != 6 else pii.base_spans(t)
        n = Counter(s[0] for s in spans)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
    assert got == want
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert spans[4].endswith(f"card:{22}:{38}") and spans[5] == ""
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows[:5], "doc_id long, text string")).collect()}
    assert clean[1] == "see <ip> and <email>, <card> or <phone>." and clean[2] is None


def test_added_spans_overlap_nothing_in_texts_full_of_them(spark):
    trees = pii.trained(spark)
    for n in (3, 20_000):
        text = " ".join(f"mail a{i}@b{i}.org, phone (555) {i % 900 + 100}-{i % 9000 + 1000} card 4539148803436467 {i % 10**6}" for i in range(n))
        base, added = pii.find(text, trees)
        assert added and sum(k == "email" for k, _, _ in base) == n
        end = np.zeros(len(text) + 1, int)
        for _, a, b in added + base:
            end[a] += 1
            end[b] -= 1
        covers = np.cumsum(end)
        assert covers.max() == 1 or all(covers[a:b].max() == 1 for _, a, b in added)


def test_proposals_of_every_spelling_and_grouping(spark):
    trees = pii.trained(spark)
    for s in ("Ann (AT) mail.example.com", "ann {at} mail.example.com", "ann [At] example (Dot) org", "ann at example DOT org", "ann(at)example.org"):
        assert ("email", 6, 6 + len(s)) in pii.candidates(f"write {s} now"), s
    for s in ("Ann (AT) mail.example.com", "ann {at} mail.example.com"):
        assert ("email", 12, 12 + len(s)) in pii.find(f"contact me: {s}, thanks", trees)[1], s
    card = "4539148803436467"
    for k in (4, 2, 1):
        for by in " -":
            s = by.join(card[i : i + k] for i in range(0, 16, k))
            for text in (f"card: {s} 7536784127813051 now", f"card: 7536784127813051 {s} now"):
                at = text.index(s)
                base, added = pii.find(text, trees)
                assert not base and ("card", at, at + len(s)) in pii.candidates(text), text
                assert ("card", at, at + len(s)) in added, text
    long_run = " ".join("7" * 50_000)
    assert len([c for c in pii.candidates(long_run) if c[0] == "card"]) <= 7 * 50_000


def test_proposals_have_no_bounds_of_length(spark):
    """Local parts, hosts and runs of groups one step and more beyond what any bound once allowed, and single digits and slashes."""
    trees = pii.trained(spark)
    emails = ["a" * n + " [at] example.org" for n in (64, 65, 3000)] + ["bob [at] " + ".".join("abcdefgh"[:n]) + ".example.org" for n in (4, 5, 6, 8)] + ["bob at " + "x" * 64 + " dot example dot org"]
    phones = ["01 23 45 67 89 10", "0033 1 23 45 67 89", "06 12 34 56 78", "030/1234567"]
    for kind, spellings in (("email", emails), ("phone", phones)):
        for s in spellings:
            text = f"contact me: {s}, thanks"
            assert (kind, 12, 12 + len(s)) in pii.candidates(text), s
            assert pii.find(text, trees)[1] == [(kind, 12, 12 + len(s))], s
    for s in ("12/05/2024", "2024-05-12", "1 2 3", "1.2.3.4.5.6", " ".join("1234" for _ in range(40))):
        assert not pii.find(f"on {s} it was", trees)[1], s
    # a run of any length is proposed in pieces, at a bounded number for each group
    assert len([c for c in pii.candidates("7 " * 50_000) if c[0] == "phone"]) <= 9 * 50_000
    assert [c for c in pii.candidates("12 345678km") if c[0] == "phone"] == []


def test_trees_are_calibrated(spark):
    trees = pii.trained(spark)
    x, y = pii.examples(800, seed=77)
    s = trees.score(x)
    chosen = s >= trees.thresholds[x[:, 0].astype(int)]
    assert y[chosen].mean() > 0.97 and chosen[y == 1].mean() > 0.7


# ---------------------------------------------------------------- 4 and 8


@pytest.fixture(scope="module")
def embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 24))
    x[500:900] = x[0] + rng.standard_normal((400, 24)) * 0.02  # a hot vector
    x[20] = x[21] = x[22]  # ties
    rows = [(i, [float(v) for v in np.float32(r)], "extra") for i, r in enumerate(x)]
    rows += [(5000, None, ""), (5050, [], ""), (5100, [0.0] * 24, ""), (5150, [1.0] * 23 + [None], ""), (5200, [1.0] * 23 + [float("nan")], ""), (5250, [1.0] * 23 + [float("inf")], ""), (None, [1.0] * 24, ""), (7, rows[7][1], "again"), (5300, [1.0, 2.0], "short"), (5301, [0.5, 2.0], "short")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(6).cache(), np.float32(x).astype(np.float64)


def test_nearest(embeddings):
    df, x = embeddings
    got = {}
    for r in vectors.nearest(df, block=200).collect():
        got.setdefault(r.query_id, []).append(r)
    assert [(r.rank, r.vec_id) for r in got.pop(5300)] == [(1, 5301)]  # the other one of its dimension
    assert set(got) == set(range(0, 1500, 20))
    s = x @ x.T
    found = 0
    for q, rs in got.items():
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, 21)) and all(r.vec_id != q for r in rs)
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert np.allclose([r.score for r in rs], [s[q, r.vec_id] for r in rs], rtol=0, atol=1e-12)
        best = np.sort(np.delete(s[q], q))[-20]
        found += sum(r.score >= best - 1e-9 for r in rs) / 20
    assert found / len(got) >= 0.9


def test_nearest_returns_all_candidates_of_a_small_table(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((12, 8)) * 5
    df = spark.createDataFrame([(i * 10, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(df, functions=8, width=0.1, probes=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    got = {q: sorted(v) for q, v in got.items()}
    s = x @ x.T
    assert got == {q * 10: [(n + 1, int(j) * 10) for n, j in enumerate(j for j in np.argsort(-s[q], kind="stable") if j != q)] for q in range(0, 12, 2)}
    assert vectors.nearest(df.limit(1)).count() == 0


def test_nearest_takes_the_smallest_of_many_copies(spark):
    """Several hundred identical vectors in one bucket, delivered in any order."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((900, 16))
    hot = rng.permutation(900)[:400]
    x[hot] = x[hot[0]] / np.linalg.norm(x[hot[0]]) * 9
    rows = [(int(i), [float(v) for v in x[i]]) for i in rng.permutation(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = sorted(int(i) for i in hot if i % 20 == 0)
    assert len(asked) > 10
    for n, block in ((3, 1024), (7, 150)):
        got = {}
        for r in vectors.nearest(df.repartition(n), block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        for q in asked:
            assert [v for _, v in sorted(got[q])] == [int(i) for i in sorted(hot) if i != q][:20]


def test_exact_top(embeddings):
    df, x = embeddings
    n = np.floor(256 * x)
    s = n @ n.T
    want = set()
    for q in range(0, 1500, 50):
        order = [j for j in np.argsort(-s[q], kind="stable") if j != q][:5]
        want |= {(q, i + 1, int(j), int(s[q, j])) for i, j in enumerate(order)}
    assert {tuple(r) for r in vectors.exact_top(df.filter("vec_id <> 5100"), block=170).select("query_id", "rank", "vec_id", "score").collect() if r[0] < 5000} == want


def test_bounds_drop_pairs():
    """Every resolution drops pairs, what is left holds the best, and a threshold that is carried over drops more."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 48)).cumsum(axis=1)
    x = np.floor(64 * (centres[rng.integers(12, size=900)] + 0.4 * rng.standard_normal((900, 48))))
    ids = np.arange(900)
    q, of = x[:40], ids[:40]
    s = q @ x.T
    s[np.arange(40), np.arange(40)] = -np.inf
    want = [(i, int(j), int(s[i, j])) for i in range(40) for j in np.argsort(-s[i], kind="stable")[:5]]
    left, fewer = [], []
    assert vectors.search_cell(q, of, x, ids, 5, (1, 4, 16), None, left) == want
    assert left[0] == 40 * 899 and left[0] > left[1] > left[2] > left[3] and left[3] < 0.3 * left[0], left
    assert vectors.search_cell(q, of, x, ids, 5, (1, 4, 16), -np.sort(-s, axis=1)[:, 4], fewer) == want
    assert all(a <= b for a, b in zip(fewer, left)) and sum(fewer) < sum(left)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((40, 30)), rng.standard_normal((50, 30))
    for segments in (1, 4, 16, 64):
        assert (vectors.segment_features(a, segments) @ vectors.segment_features(b, segments).T >= a @ b.T - 1e-9).all()


# ---------------------------------------------------------------- 7


@pytest.fixture(params=["true", "false"], ids=["coalesced", "as many partitions as set"])
def coalesced(spark, request):
    """Small tables would else lie in one partition, and nothing would go on from one to the next."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.unset(key)


def test_url_filter(spark, coalesced):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/es/x", "allow"), ("a.example.org", "", "block"), ("com", "/fr/", "allow"), ("com", "/fr/", "block"), ("x.com", "/", "allow"), ("a." * 200 + "org", "/", "block"), (None, "/", "block"), ("net", None, "block")]
    hosts = ["example.org", "a.example.org", "b.a.example.org", "aexample.org", "org", "x.com", "y.x.com", "com", "net", "x.com:80", "é.org", "", "a..org"]
    paths = ["", "/", "/es/", "/es/x/y", "/fr/", "/fr", "/\x02", "/é/"]
    urls = [f"{s}://{h}{p}{t}" for s in ("http", "") for h in hosts for p in paths for t in ("", "?a://b/", "#f")] + ["HTTP://EXAMPLE.ORG/es/", "no scheme", None, "", "x://", "a://b://c.org/", "http://" + "a." * 300 + "org/" + "p" * 5000]
    rows = [(i, u, 1, "t") for i, u in enumerate(urls)] + [(0, urls[0], 1, "t"), (None, urls[1], 1, "t")]

    def judge(u):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best[2] if best else "allow"

    df = spark.createDataFrame(rows, "page_id long, url string, lane int, at string")
    got = url_filter.judge(df, url_filter.rule_table(spark, rules)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *judge(u)) for i, u, _, _ in rows)
    assert url_filter.judge(df, url_filter.rule_table(spark, [("z", "/", "allow")])).filter("rule is not null").count() == 0
    assert url_filter.judge(df, url_filter.rule_table(spark).limit(0)).filter("rule is not null").count() == 0


def test_pages_without_url_are_split(spark):
    """All null URLs are one key: its rows must be split over tasks when they meet their verdict."""
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 60 == 0, F.concat(F.lit("http://h"), "id", F.lit(".org/"))).alias("url"))
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    for k, v in zip(old, ("20k", "20k", "-1", "-1", "1")):
        spark.conf.set(k, v)
    try:
        out = url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id", "rule", F.spark_partition_id().alias("task")).toPandas()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hot = out[out.rule.isna()]
    assert len(out) == 60_000 and len(hot) == 59_000
    assert hot.task.value_counts().max() < len(hot) / 2


def test_rules_reach_over_partitions(spark, coalesced):
    """Nested rules whose intervals span several partitions, and one key that many hosts share."""
    rules = [("org", "", "block"), ("org", "/", "allow"), ("org", "/a", "block"), ("org", "/a/b", "allow"), ("c.org", "/a", "block"), ("h5.org", "/a/b", "block")]
    urls = [(i, f"http://h{i % 40}.{'c.' * (i % 3)}org{p}") for i, p in enumerate(["", "/", "/a", "/a/b/c", "/b", "/x"] * 60)]
    got = {r.page_id: r.rule for r in url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rule_table(spark, rules)).collect()}
    for i, u in urls:
        host, slash, path = u[7:].partition("/")
        fits = [h + p for h, p, _ in rules if ("." + host).endswith("." + h) and (slash + path).startswith(p)]
        assert got[i] == max(fits, key=len), u


# ---------------------------------------------------------------- 1


def test_license_scan(spark):
    lines = [t for _, t in licenses.TEMPLATES]
    changed = lambda t, k: " ".join(w for i, w in enumerate(t.split()) if i % k)
    texts = [f"{prose(20)}\n{lines[i % len(lines)]}\n{prose(9)}" for i in range(20)] + [changed(lines[i], 7) for i in range(len(lines))] + [lines[2].upper(), None, "", " ", "MIT", prose(3000), f"{prose(5)}\n \n{lines[6][:150]}\n{lines[6][150:]}\n\n{prose(4)}", "é ü " * 5]

    def grams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:]))

    known = [grams(t) for t in lines]
    want = Counter()
    for i, t in enumerate(texts):
        units = [("document", [t or ""]), ("paragraph", re.split(r"\n[ \t\r]*\n\s*", t or "")), ("line", re.split(r"\r?\n", t or ""))]
        for unit, parts in units:
            for n, part in enumerate(parts):
                g = grams(part)
                best = max(((2 * len(g & k) / (len(g) + len(k)), -j) for j, k in enumerate(known)), default=(0, 0)) if g else (0, 0)
                if best[0] >= 0.8:
                    want[(i, unit, n, licenses.TEMPLATES[-best[1]][0], -best[1], round(best[0], 12))] += 1
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, unit string, templates int")
    got = Counter((*tuple(r)[:5], round(r.dice, 12)) for r in licenses.scan(df).collect())
    assert got == want and len(want) > 40


def test_license_templates_beyond_the_bound_go_in_parts(spark):
    """The best template of every unit is the same however many parts the templates need; one larger than the bound is a part."""
    lines = [t for _, t in licenses.TEMPLATES]
    texts = [f"{prose(20)}\n{t}\n{prose(9)}" for t in lines] + [" ".join(w for i, w in enumerate(t.split()) if i % 9) for t in lines] + [None, "", prose(40)]
    df = spark.createDataFrame([*enumerate(texts), *list(enumerate(texts))[:5]], "doc_id long, text string")
    units = lambda rows: Counter((*r[:5], round(r.dice, 12)) for r in rows if r.unit != "window")
    whole = licenses.scan(df).collect()
    parts = licenses.scan(df, bound=45).collect()
    assert units(parts) == units(whole) and len(units(whole)) > 20
    assert {(r.doc_id, r.license) for r in parts} == {(r.doc_id, r.license) for r in whole}


def test_license_notices_among_other_words(spark):
    """Notices inside long lines, in wrapped comments, beside one another, and beside notices on lines of their own."""
    lines, number = [t for _, t in licenses.TEMPLATES], {}
    for i, (name, _) in enumerate(licenses.TEMPLATES):
        number.setdefault(name, i)
    long = [i for i, t in enumerate(lines) if len(t.split()) > 20]

    def wrapped(t, mark):
        w = t.split()
        return "\n".join(f"{mark} {' '.join(w[i : i + 9])}" for i in range(0, len(w), 9))

    texts, want = [], []
    for i, t in enumerate(lines):
        texts.append(f"{prose(30)} {t} {prose(30)}")
        want.append({licenses.TEMPLATES[i][0]})
    for i in long:
        texts.append(f"# Copyright (C) 2020 Ann Other\n#\n{wrapped(lines[i], '#')}\n#\n{wrapped(prose(60), '#')}\nimport os\n" + prose(40))
        want.append({licenses.TEMPLATES[i][0]})
        texts.append(f" * Copyright (C) 2020 Ann Other {prose(9)}\n{wrapped(lines[i], ' *')}\n{wrapped(prose(60), ' *')}\nint x;")
        want.append({licenses.TEMPLATES[i][0]})
    texts += [f"{prose(9)} {lines[0]} {lines[4 - 1]} {prose(9)}", f"{lines[0]}\n{prose(12)} {lines[3]} {prose(12)}", prose(500)]
    want += [{"MIT", "Apache-2.0"}, {"MIT", "Apache-2.0"}, set()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(df.union(df)).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.dice >= 0.8
    assert [{r.license for r in got.get(i, [])} for i in range(len(texts))] == want
    assert all(r.unit_no == 30 and r.template == i and r.dice == 1 for i in range(len(lines)) for r in got[i] if r.unit == "window")
    assert sum(r.unit == "window" for r in got[0]) == 2


# ---------------------------------------------------------------- 10


def test_quality(spark):
    good = [(i, ". ".join(prose(RNG.randint(5, 12)).capitalize() for _ in range(RNG.randint(3, 30))) + ".", 1) for i in range(400)]
    bad = [(1000 + i, RNG.choice([lambda: "Buy " * RNG.randint(5, 300), lambda: " | ".join(prose(40).split()), lambda: prose(50).upper().replace(" ", "!! ") + "!!"])(), 0) for i in range(200)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(None, "some text", "en"), (9001, None, "en"), (9002, "", "en"), (5, rows[5][1], "en")], "doc_id long, text string, held_out string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (9001, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, labels).collect()
    assert len(out) == len(rows) + 4
    by = {r.doc_id: r for r in out}
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and all(r.held_out == quality.is_held_out(r.doc_id) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert by[9001].score == by[9002].score and by[None].held_out


# ---------------------------------------------------------------- empty tables


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [substring_dedup.remove_repeats(none), near_dedup.near_duplicates(none), mixing.mix(none), packing.best_fit(none), pii.detect(none), vectors.nearest(vecs), vectors.exact_top(vecs), url_filter.judge(pages, url_filter.rule_table(spark)), licenses.scan(none), quality.score(none, labels)]
    for df in results:
        assert df.collect() == []
    assert {r.score for r in quality.score(docs.limit(3), labels).collect()} <= {0.5}
