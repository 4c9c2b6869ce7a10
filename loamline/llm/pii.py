"""Personal data by candidate gradient boosting.

Base patterns find the plain cases. Around them, generators with high recall propose overlapping spans of the same kinds:
spelled-out e-mail addresses, dotted quads inside longer runs, card numbers inside runs of several numbers, phone numbers
without a country code. Boosted trees (spark.ml) score each proposal by its format and context, and a threshold calibrated for
each kind on examples set aside selects what is added; base spans always stay. The trees are trained once per
application on generated examples, and then applied inside the tasks, so that texts are neither shuffled nor joined.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({ ]at[\])} ] ?[A-Za-z0-9-]++(?:(?: ?[\[({ ]dot[\])} ] ?|\.)[A-Za-z0-9-]++)++", re.I)
#: What every match of _SPELLED holds from its "at" on: a text without it has none.
_SPELLED_TAIL = re.compile(r"[\[({ ]at[\])} ] ?[A-Za-z0-9-]++(?: ?[\[({ ]dot[\])} ] ?|\.)[A-Za-z0-9-]", re.I)
_DOTTED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
#: Numbers one separator apart; phone numbers of two groups and more are proposed inside such runs.
_RUN = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++\)?(?:[ ./-]\(?[0-9]++\)?)++")
_RUN_GROUP = re.compile(r"\(?[0-9]+\)?")
_RUN_BEFORE, _RUN_AFTER = re.compile(r"[0-9 ./()-]*$"), re.compile(r"[0-9 ./()-]*")
_GROUP = re.compile(r"[0-9]+")
#: Words that speak for or against a kind, looked for shortly before a candidate.
HINTS = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "addr", "server"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "tel", "call", "mobile", "fax")}
AGAINST = ("version", "order", "isbn", "ref", "token", "serial", "total", "build")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 if v > 4 else v * 2
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start: leftmost non-overlapping matches, without the failing ones.

    An address is found from its @ sign: its local part is the run of local characters before it that no earlier address
    holds, which is what a search from the left finds, at a cost linear in the text.
    """
    out = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                done = m.end()
    if _DIGIT.search(text):
        for m in _QUAD.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _NUMBER.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _phones(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """All runs of two groups and more with 7 to 15 digits, and the whole run if it has at most 15. A last group that runs on into
    a word is left out."""
    groups = [g.span() for g in _RUN_GROUP.finditer(text, start, end)]
    if text[end : end + 1].isalnum():
        groups.pop()
    sizes = [sum(map(str.isdigit, text[a:b])) for a, b in groups]
    out = []
    for i, (a, _) in enumerate(groups):
        digits = 0
        for j in range(i, len(groups)):  # every group has a digit, so at most 15 are taken
            digits += sizes[j]
            if digits > 15:
                break
            if j > i and (digits >= 7 or (i == 0 and j == len(groups) - 1)):
                out.append((a, groups[j][1]))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping proposals, with high recall; spans that the base patterns find may be among them."""
    out = []
    if _SPELLED_TAIL.search(text):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _DOTTED.finditer(text)]
        for m in _RUN.finditer(text):
            out += [("phone", a, b) for a, b in _phones(text, m.start(), m.end())]
        for m in _NUMBER.finditer(text):
            if m.end() - m.start() < 13:
                continue
            groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
            for i, (start, _) in enumerate(groups):
                size = 0
                for lo, hi in groups[i : i + 19]:  # every group has a digit, so the break below comes first
                    size += hi - lo
                    if size > 19:
                        break
                    if size >= 13:
                        out.append(("card", start, hi))
    return out


FEATURES = ("kind", "length", "digits", "groups", "longest_group", "shortest_group", "luhn", "first_digit", "parts_ok", "parens", "dashes", "spaces", "dots", "letter_before", "letter_after", "digit_near", "touches_number", "hint", "against", "spelled_dots", "brackets", "last_part", "rest_of_run")


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s = text[start:end]
    digits = "".join(_GROUP.findall(s))
    groups = [len(g) for g in _GROUP.findall(s)] or [0]
    before, after = text[max(0, start - 2) : start], text[end : end + 2]
    context = text[max(0, start - 28) : start].lower()
    low = s.lower()
    return [
        KINDS.index(kind), min(end - start, 80), len(digits), len(groups), max(groups), min(groups), float(bool(digits) and luhn(digits)), int(digits[:1] or 0), float(kind == "ip" and all(int(x) <= 255 for x in s.split("."))),
        float("(" in s and ")" in s and any(map(str.isdigit, s))), s.count("-"), s.count(" "), s.count("."), float(before[-1:].isalpha()), float(after[:1].isalpha()), float(before[-1:].isdigit() or after[:1].isdigit()),
        float(bool(before[-1:] in tuple("-./+") and before) or bool(after[:1] in tuple("-/") and after) or (after[:1] == "." and after[1:2].isdigit())),
        float(any(h in context for h in HINTS[kind])), float(any(h in context for h in AGAINST)), len(re.findall(r"\bdot\b", low)), float(any(c in s for c in "[({")), len(re.split(r"[ .\])}]", s)[-1]),
        sum(map(str.isdigit, _RUN_BEFORE.search(text[max(0, start - 12) : start])[0] + _RUN_AFTER.match(text[end : end + 12])[0])),
    ]


# ---------------------------------------------------------------- training on generated examples


def _with_check_digit(digits: str) -> str:
    return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates in n generated texts, half of which hold personal data."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"aeiou") + pick(*"bdlmnrstv") for _ in range(rng.integers(1, 4)))
    grouped = lambda s, k, by: by.join(s[i : i + k] for i in range(0, len(s), k))
    x, y = [], []
    for _ in range(n):
        kind, good = pick(*KINDS), bool(rng.integers(2))
        if kind == "email":
            host = pick(" dot ", ".", " [dot] ", "(dot)").join([*(word() for _ in range(pick(1, 1, 1, 2, 3, 6, 9))), pick("com", "org", "net", "de")])
            s = pick(word(), word(), word() + "." + word(), "".join(word() for _ in range(20))) + pick(" [at] ", "(at)", " (at) ", " at ") + host
            if " at " in s and "dot" not in s:
                good = False
            if not good:
                s = pick(f"{word()} at {word()} dot {word()}ing", f"{word()} at {word()}.{word()}", f"{word()} at {word()}.{word().title()}")
        elif kind == "ip":
            s = ".".join(str(rng.integers(1, 256)) for _ in range(4))
            if not good:
                s = pick(s + "." + digits(2), ".".join(str(rng.integers(256, 999)) for _ in range(4)), digits(1) + "." + s)
        elif kind == "card":
            s = _with_check_digit(pick("4", "51", "37", "60") + digits(13))[:17]
            s = _with_check_digit(s[:-1])
            if good:
                s = grouped(s, pick(16, 16, 4, 4, 2, 1), pick(" ", "-"))
                s = pick(s, digits(16) + " " + s, s + " " + digits(16)) if rng.integers(2) else s
            else:
                s = s[:-1] + str((int(s[-1]) + 1 + rng.integers(8)) % 10)
                s = pick(s, digits(40), digits(16) + "-" + digits(16), word() + s)
        else:
            s = pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"00{rng.integers(1, 99)} {digits(3)} {digits(4)} {digits(3)}", f"00{rng.integers(1, 99)} {digits(1)} {grouped(digits(8), 2, ' ')}", f"0{digits(1)} {grouped(digits(pick(8, 10)), 2, ' ')}", f"0{digits(2)}/{digits(pick(6, 7, 8))}")
            if not good:
                s = pick(f"20{digits(2)}-0{rng.integers(1, 9)}-{digits(2)}", f"{digits(2)}.{digits(3)}", f"{digits(3)} {digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(3)}", f"{digits(5)}-{digits(4)}", f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", grouped(digits(40), pick(2, 3, 4), " "), f"{digits(2)}/{digits(2)}/20{digits(2)} {digits(2)}")
        hint = pick(*HINTS[kind]) + pick(": ", " ") if good and rng.integers(2) else pick("", "", pick(*AGAINST) + " ")
        left = " ".join(word() for _ in range(rng.integers(1, 5))) + pick(" ", ". ", ", ") + hint
        text = left + s + pick(" ", ". ", ", ", "\n") + " ".join(word() for _ in range(3))
        core = (len(left), len(left) + len(s))
        for k, a, b in candidates(text):
            span = text[a:b]
            number = re.sub("[ -]", "", span)
            right = luhn(number) and len(number) == 16 and not text[a - 1].isalnum() if k == "card" else good and k == kind and (a, b) == core
            x.append(features(text, k, a, b))
            y.append(float(right))
    return np.array(x, float), np.array(y)


class Trees:
    """Boosted trees as flat arrays, and the threshold of each kind."""

    def __init__(self, trees: list[np.ndarray], weights: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, np.ones(len(KINDS))

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for nodes, w in zip(self.trees, self.weights):
            at = np.zeros(len(x), int)
            while (inner := nodes[at, 0] >= 0).any():
                f = nodes[at, 0].astype(int)
                step = np.where(x[np.arange(len(x)), f] <= nodes[at, 1], nodes[at, 2], nodes[at, 3]).astype(int)
                at = np.where(inner, step, at)
            margin += w * nodes[at, 4]
        return 1 / (1 + np.exp(-2 * margin))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> None:
        """For each kind the least score from which on `precision` of the set-aside candidates are right."""
        s = self.score(x)
        for k in range(len(KINDS)):
            mine = x[:, 0] == k
            order = np.argsort(-s[mine], kind="stable")
            right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
            good = np.flatnonzero(right >= precision)
            self.thresholds[k] = max(0.5, s[mine][order][good[-1]]) if len(good) else 1.1


def _flat(tree) -> np.ndarray:
    """A spark.ml regression tree as rows of (feature or -1, threshold, left, right, prediction)."""
    rows: list[list[float]] = []

    def add(node) -> int:
        here = len(rows)
        rows.append([-1, 0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[here][:2] = [split.featureIndex(), split.threshold()]
            rows[here][2], rows[here][3] = add(node.leftChild()), add(node.rightChild())
        return here

    add(tree._java_obj.rootNode())
    return np.array(rows, float)


@lru_cache(maxsize=4)
def _trained(app: str, n: int, rounds: int, depth: int, seed: int, precision: float) -> Trees:
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    spark = SparkSession.getActiveSession()
    x, y = examples(n, seed)
    data = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).coalesce(1)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, cacheNodeIds=False).fit(data)
    out = Trees([_flat(t) for t in model.trees], list(model.treeWeights))
    out.calibrate(*examples(n, seed + 1), precision)
    return out


def trained(spark: SparkSession, n: int = 2500, rounds: int = 12, depth: int = 4, seed: int = 5, precision: float = 0.99) -> Trees:
    """The model: the bound on the training sample is n generated texts, whatever the input."""
    return _trained(spark.sparkContext.applicationId, n, rounds, depth, seed, precision)


class _Taken:
    """Disjoint intervals in order; a span is looked up, and added, without a walk over the others."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i > 0 and self.ends[i - 1] > a

    def add(self, a: int, b: int) -> None:
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(text: str, trees: Trees) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of one text; added spans overlap neither base spans nor each other."""
    base = base_spans(text)
    taken = _Taken((a, b) for _, a, b in base)
    proposed = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
    if not proposed:
        return base, []
    x = np.array([features(text, *c) for c in proposed])
    s = trees.score(x)
    added, used = [], _Taken(())
    for i in np.argsort(-s, kind="stable"):
        k, a, b = proposed[i]
        if s[i] >= trees.thresholds[int(x[i, 0])] and not used.meets(a, b):
            added.append((k, a, b))
            used.add(a, b)
    return base, added


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added for each row of docs.

    Offsets are code points, ends exclusive. Null text is empty; a null doc_id stays null. Each row stands for itself, repeated ones
    too, and other columns are not read. Texts of any length are searched whole, at a cost linear in the text.
    """
    small_batches(docs.sparkSession)
    trees = trained(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text):
                base, added = find(text, trees)
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span found in `text` replaced by its kind in angle brackets; null stays null."""
    small_batches(docs.sparkSession)
    trees = trained(docs.sparkSession)

    def clean(t: str | None) -> str | None:
        if t is None:
            return None
        base, added = find(t, trees)
        end, parts = 0, []
        for k, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
            if a >= end:
                parts += [t[end:a], f"<{k}>"]
            end = max(end, b)
        return "".join([*parts, t[end:]])

    @F.pandas_udf("string")
    def redacted(x: pd.Series) -> pd.Series:
        return x.map(clean, na_action="ignore")

    return docs.withColumn(text, redacted(F.col(text)))
