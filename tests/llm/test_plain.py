"""What SQL cannot express against plain Python written from the methods' descriptions: pivotal rounding, the discriminant, added
spans, and the whole pipeline on a small table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("loamline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from loamline.llm import mixing, packing, pii, quality  # noqa: E402

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("aeiounrstl") for _ in range(RNG.randint(2, 7))) for _ in range(300)]
WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


# ---------------------------------------------------------------- 5: every pairing replayed


def hashed(seed, *values):
    """Spark's xxhash64: the hash of each value seeds the next; (value, bytes) for numbers; nulls are passed over."""
    h = xxhash.xxh64_intdigest(int(seed).to_bytes(4, "little", signed=True), 42)
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v[0]).to_bytes(v[1], "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def unit(seed, *hashes):
    return ((hashed(seed, *((h, 8) for h in hashes)) % (1 << 64)) >> 11) / float(1 << 53)


def pair(a, b, seed, done):
    """Two documents [h, key, size, p] exchange words until one of them is integral; the other is returned."""
    up = min((1 - a[3]) * a[2], b[3] * b[2])
    down = min(a[3] * a[2], (1 - b[3]) * b[2])
    sign, moved = (1, up) if unit(seed, a[0], b[0]) * (up + down) < down else (-1, down)
    a_ends = (1 - a[3]) * a[2] <= b[3] * b[2] if sign == 1 else a[3] * a[2] <= (1 - b[3]) * b[2]
    ends, stays, way = (a, b, -sign) if a_ends else (b, a, sign)
    done[ends[1]] = int((sign == 1) == a_ends)
    return [*stays[:3], min(1.0, max(0.0, stays[3] + way * moved / stays[2]))]


def rounded(items, blocks, largest, seed):
    """key -> 0 or 1 for items [h, key, size, p] of one source, by blocks and then up the tree."""
    done, level = {}, {}
    for x in sorted(items):
        at = x[0] % blocks
        level[at] = pair(level[at], x, seed, done) if at in level else x
    n = -(-largest // mixing.BLOCK)
    while n > 1:
        n, above, deep = -(-n // mixing.BLOCK), {}, seed + -(-n // mixing.BLOCK)
        for x, at in sorted((x, at) for at, x in level.items()):
            at //= mixing.BLOCK
            above[at] = pair(above[at], x, deep, done) if at in above else x
        level = above
    for x in level.values():
        done[x[1]] = int(unit(seed, x[0]) < x[3])
    return done


def plain_targets(total):
    names = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    weight, fixed = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, share = sum(total.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        target = {s: rest * weight[s] / share for s in free}
        over = {s: 3.0 * total[s] for s in free if target[s] > 3 * total[s] + 1e-9}
        if not over:
            return target | fixed
        fixed |= over


def plain_mix(rows, seed=17):
    """(source, doc_id, size, nth) -> copies for rows (doc_id, text, source)."""
    seen, keys = Counter(), []
    for i, t, s in rows:
        k = (s, i, len(WORD.findall(t or "")))
        seen[k] += 1
        keys.append((*k, seen[k]))
    total, count = Counter(), Counter()
    for k in keys:
        total[k[0]] += k[2]
        count[k[0]] += 1
    target, copies = plain_targets(total), {k: 0 for k in keys}
    for s in total:
        mine = [k for k in keys if k[0] == s]
        large = {k for k in mine if k[2] > total[s] / count[s] * 4}
        rate = min(target[s] / total[s], 3.0) if total[s] else 0.0
        for part in (large, set(mine) - large):
            if part is not large:
                left = total[s] - sum(k[2] for k in large)
                rate = min(max((target[s] - sum(copies[k] * k[2] for k in large)) / left, 0.0), 3.0) if left > 0 else 0.0
            whole = int(rate)
            items = [[hashed(seed, s, None if k[1] is None else (k[1], 8), (k[2], 8), (k[3], 4)), k, k[2], rate - whole] for k in part if k[2]]
            for k, up in rounded(items, -(-count[s] // mixing.BLOCK), max(count.values()), seed).items():
                copies[k] = min(whole + up, 3)
    return copies


def test_every_pairing_of_the_mix(spark):
    rows = [(i, prose(RNG.choice([3, 20, 60, 300])), f"s{RNG.choice([0, 0, 0, 1, 2])}") for i in range(2500)]
    rows += [(9000, prose(5000), "s1"), (9001, None, "s1"), (9002, " ", None), (9003, prose(9), None), (9004, prose(30), None)]
    rows += [(7, prose(11), "s9"), (7, prose(11), "s9"), (8, prose(40), "s9")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.source, r.doc_id, r["size"], r.nth): r.copies for r in got} == plain_mix(rows)
    assert max(Counter(s for _, _, s in rows).values()) > 2 * mixing.BLOCK  # the tree has levels


# ---------------------------------------------------------------- 10: the densities written out


def plain_scores(rows, labels):
    """One score for each (doc_id, text): log densities of two Gaussians with shrunk covariances, by determinant and inverse."""
    x = np.array([quality.statistics((t or "").encode()) for _, t in rows])
    train = [(x[n], q) for n, (i, _) in enumerate(rows) for j, q in labels if i is not None and i == j and q in (0, 1) and not quality.is_held_out(i)]
    every = np.array([v for v, _ in train])
    centre, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    z, logs = np.clip((x - centre) / scale, -12, 12), []
    for c in (0, 1):
        own = (np.array([v for v, q in train if q == c]) - centre) / scale
        cov = 0.95 * np.cov(own.T, bias=True) + 0.1 * np.eye(x.shape[1])
        d = z - own.mean(axis=0)
        logs.append(-0.5 * np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(own) + 1))
    return 1 / (1 + np.exp(-np.clip(0.1 * (logs[1] - logs[0]), -30, 30)))


def labelled(n):
    """Documents good and bad, with their labels."""
    good = [(i, ". ".join(prose(RNG.randint(5, 12)).capitalize() for _ in range(RNG.randint(4, 25))) + ".", 1) for i in range(n)]
    return good + [(1000 + i, RNG.choice([lambda: "Buy " * RNG.randint(5, 200), lambda: " | ".join(prose(40).split()), lambda: prose(50).upper()])(), 0) for i in range(n // 2)]


def test_scores_are_log_density_differences(spark):
    known = labelled(200)
    rows = [(i, t) for i, t, _ in known] + [(None, "some text"), (9001, None), (9002, ""), (9003, prose(30_000))]
    labels = [(i, q) for i, _, q in known]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = sorted((str(i), s) for (i, _), s in zip(rows, plain_scores(rows, labels)))
    for got, (i, s) in zip(sorted((str(r.doc_id), r.score) for r in out), want):
        assert got[0] == i and abs(got[1] - s) < 1e-6


# ---------------------------------------------------------------- 3: added spans, proposal by proposal


def tree_value(nodes, x):
    at = 0
    while nodes[at][0] >= 0:
        at = int(nodes[at][2] if x[int(nodes[at][0])] <= nodes[at][1] else nodes[at][3])
    return nodes[at][4]


def plain_find(text, trees):
    """Base spans, and the proposals that pass, the best first, each against all spans taken before."""
    base, scored = pii.base_spans(text), []
    for n, (k, a, b) in enumerate(pii.candidates(text)):
        x = pii.features(text, k, a, b)
        margin = sum(w * tree_value(t, x) for t, w in zip(trees.trees, trees.weights))
        scored.append((-1 / (1 + np.exp(-2 * margin)), n, (k, a, b)))
    taken = list(base)
    for s, _, (k, a, b) in sorted(scored):
        if -s >= trees.thresholds[pii.KINDS.index(k)] and all(b <= c or a >= d for _, c, d in taken):
            taken.append((k, a, b))
    return taken


def personal():
    digits = lambda n: "".join(RNG.choice("0123456789") for _ in range(n))
    parts = [lambda: prose(4), lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: "4539 1488 0343 6467", lambda: digits(16), lambda: "ann [at] mail dot org", lambda: "bob@mail.com", lambda: f"{digits(2)}.1.2.{digits(2)}", lambda: f"+1 {digits(3)} {digits(7)}", lambda: "call:", lambda: "4539148803436467"]
    return " ".join(RNG.choice(parts)() for _ in range(RNG.randint(1, 25)))


def test_added_spans(spark):
    trees = pii.trained(spark)
    rows = [(i, personal()) for i in range(300)] + [(300, None), (301, ""), (302, " ".join(personal() for _ in range(40)))]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        spans = sorted(plain_find(t or "", trees), key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), t
    assert sum(r.n_added for r in got.values()) > 50


# ---------------------------------------------------------------- the pipeline


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_pack(pieces, lengths=packing.LENGTHS):
    """(size, key) in order -> key: (bin, offset, final length), looking through all open bins for every piece."""
    bins, at, clock = [], {}, 0
    for n, (s, key) in enumerate(pieces):
        clock += 1
        fits = [(length - fill, -since, b) for b, (length, fill, since) in enumerate(bins) if length - fill >= s]
        if fits:
            b = min(fits)[2]
        else:
            best = None
            for length in lengths:
                if length >= s:
                    fill = s
                    for later, _ in pieces[n + 1 :]:
                        fill += later if fill + later <= length else 0
                    price = packing.cost(min(m for m in lengths if m >= fill), max(lengths)) / fill
                    best = (price, length) if best is None or price <= best[0] else best
            b = len(bins)
            bins.append((best[1], 0, clock))
        length, fill, _ = bins[b]
        at[key], bins[b] = (b, fill), (length, fill + s, clock)
    return {key: (b, offset, min(m for m in lengths if m >= bins[b][1])) for key, (b, offset) in at.items()}


def plain_pipeline(docs, labels, trees):
    scores = plain_scores([(i, t) for i, t, _ in docs], labels)
    docs = sorted(d for d, s in zip(docs, scores) if s >= 0.3)
    bags, label = [bag(t) for _, t, _ in docs], list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            both, either = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if either and both >= 0.8 * either:
                label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    docs = [d for n, d in enumerate(docs) if label[n] == n]
    clean = []
    for i, t, s in docs:
        for k, a, b in sorted(plain_find(t, trees), key=lambda x: -x[1]):
            t = f"{t[:a]}<{k}>{t[b:]}"
        clean.append((i, t, s))
    copies = plain_mix(clean)
    pieces = []
    for (_, i, size, _), n in copies.items():
        for nth in range(1, n + 1):
            for piece, start in enumerate(range(0, size, max(packing.LENGTHS))):
                pieces.append((min(size - start, max(packing.LENGTHS)), (i, nth, piece)))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    packed = plain_pack(pieces)
    return sorted((*key, size, *packed[key]) for size, key in pieces), len(docs)


def test_pipeline_on_a_small_table(spark, tmp_path):
    known = labelled(120)
    docs = [(i, t, f"s{i % 3}") for i, t, _ in known]
    whole = [t for _, t, q in known if q]
    docs += [(2000 + n, t, "s1") for n, t in enumerate(whole[:10])]  # copies
    docs += [(2100 + n, f"{whole[20]} {prose(1 + n // 3)}", "s0") for n in range(9)]  # near copies
    docs += [(2200 + n, f"{t} Write to ann [at] mail dot org or (555) 123-4567, call: bob@mail.com.", "s2") for n, t in enumerate(whole[40:50])]
    docs += [(3000, ". ".join(prose(9).capitalize() for _ in range(2000)) + ".", "s0")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q) for i, _, q in known]
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want, kept = plain_pipeline(docs, labels, pii.trained(spark))
    assert 100 < kept < len(docs) - 30
    assert sorted((r.doc_id, r.nth, r.piece, r.length, r.bin_id, r.bin_offset, r.bin_length) for r in got) == want
