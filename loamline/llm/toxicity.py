"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of itself, all looked up in one hashed table, so that a spelling
that was never seen has the vectors of the n-grams it shares with seen ones. A window of consecutive words is the mean of its
distinct words and goes through a linear softmax. A text is scored by its most toxic window, which keeps a short insult in a long
text from being averaged away; in training too, a text's label is charged to that window, so vectors and softmax
learn together where in the text the label comes from.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stash

#: Stripped from both ends of a word; inside of it everything stays, as misspellings use signs too.
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
WINDOW = 64
#: Words without a meaning, of vector zero, that every window holds: one word alone does not make a window.
BLANK = 12


def words_of(text: str) -> list[str]:
    """Lower-cased words between blanks, without punctuation around them."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGES))]


def windows(text: str, size: int = WINDOW) -> list[list[str]]:
    """The words of overlapping windows that cover the text, each half a window further on; words that repeat in a window count once."""
    ws = words_of(text)
    return [list(dict.fromkeys(ws[a : a + size])) for a in range(0, max(len(ws) - size // 2, 1), size // 2)] if ws else []


def subwords(word: str, buckets: int) -> list[int]:
    """Places in the table of the word itself (three times), of its n-grams of 3 to 5 characters and of its longer beginnings, ends marked."""
    w: str | bytes = f"<{word}>"
    if w.isascii():  # slices of bytes need no encoding of their own
        w = w.encode()
    grams = [w, w, w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)), *(w[:n] for n in range(6, min(len(w), 10)))]
    return [zlib.crc32(g if isinstance(w, bytes) else g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[start:end] of all pairs, one after another, and their lengths."""
    sizes = ends - starts
    return values[np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())], sizes


def _add_by(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, width) sums of the rows by index."""
    return np.stack([np.bincount(index, c, n) for c in rows.T], axis=1)


@dataclass
class Model:
    """For each place of the table the difference of its two logits, and that of the biases: vectors times softmax, multiplied out."""

    gain: np.ndarray
    bias: float

    def word(self, w: str) -> float:
        places = subwords(w, len(self.gain))
        return sum(self.gain[p] for p in places) / len(places)

    def words(self) -> Words:
        return Words(self)

    def score(self, text: str, known: Words) -> float:
        """Probability of the most toxic window; known: scores of words met before."""
        means = [sum(map(known.__getitem__, ws)) / (len(ws) + BLANK) for ws in windows(text)]
        return float(1 / (1 + np.exp(-np.clip(max(means, default=0.0) + self.bias, -30, 30))))


class Words(dict):
    """Scores of words under a model, each computed when it is first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.places, self.gain = len(model.gain), array("d", model.gain.tolist())

    def __missing__(self, w: str) -> float:
        gain, places = self.gain, subwords(w, self.places)
        self[w] = value = sum([gain[p] for p in places]) / len(places)
        return value


def train(bags: list[tuple[list[list[str]], int]], buckets: int = 1 << 18, width: int = 8, steps: int = 120, patience: int = 25, rate: float = 2.0, rare: int = 4, seed: int = 3) -> Model:
    """Fit on (windows of words, label) for each text. Every step takes each text's most toxic window and moves table, softmax and
    biases down the gradient of the cross-entropy, with momentum, by at most `rate` in any place: places move in proportion to their
    gradients, so that what many texts agree on is learned before what one text could be told by. A fifth of the texts is
    set aside; the step that suits them best is the result, and `patience` steps without a better one end the work. Words met in fewer than
    `rare` texts are blanks here; a score reads them by their n-grams.
    Without texts of both labels every score is their share (0.5 without texts)."""
    marks = np.array([y for _, y in bags], int)
    if len(set(marks.tolist())) < 2:
        share = (marks.sum() + 1) / (len(marks) + 2)
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    texts_of = Counter(w for texts, _ in bags for w in {w for window in texts for w in window})
    number = {w: i for i, w in enumerate(sorted(w for w, n in texts_of.items() if n >= rare))}
    flat = [[number[w] for w in window if w in number] for texts, _ in bags for window in texts]
    word, ends = np.array([w for window in flat for w in window], np.int64), np.cumsum([len(w) for w in flat])
    starts, sizes = np.concatenate([[0], ends[:-1]]), np.array([len(window) + BLANK for texts, _ in bags for window in texts])
    last = np.cumsum([len(texts) for texts, _ in bags]) - 1
    owner = np.repeat(np.arange(len(bags)), np.diff(last, prepend=-1))
    grams = [subwords(w, buckets) for w in number]
    n_grams = np.array([len(g) for g in grams], np.int64)
    gram, gram_word = np.array([p for g in grams for p in g], np.int64), np.repeat(np.arange(len(grams)), n_grams)
    gram_at = np.concatenate([[0], np.cumsum(n_grams)]).astype(np.int64)
    slow = 1 / np.sqrt(1 + np.bincount(gram, np.array([texts_of[w] for w in number], float)[gram_word], buckets))
    aside = np.arange(len(bags)) % 5 == 0 if len(bags) >= 50 else np.zeros(len(bags), bool)
    fitted, judged = np.flatnonzero(~aside), aside if aside.any() else ~aside
    share = marks[fitted].mean().clip(0.01, 0.99)
    rng = np.random.default_rng(seed)
    weights = [np.zeros((buckets, width)), rng.normal(0, 0.3, (width, 2)), np.log([1 - share, share])]
    moves, paid = [np.zeros_like(x) for x in weights], [1e-12, 1e-12, 1e-2]
    best, best_loss, best_step = None, np.inf, 0
    for step in range(steps):
        table, soft, bias = weights
        gain = table @ (soft[:, 1] - soft[:, 0])
        running = np.concatenate([[0.0], np.cumsum((np.bincount(gram_word, gain[gram], len(grams)) / n_grams)[word])])
        margin = (running[ends] - running[starts]) / sizes
        top = np.lexsort((margin, owner))[last]  # the most toxic window of each text
        loss = np.logaddexp(0, -np.where(marks == 1, 1, -1) * (margin[top] + bias[1] - bias[0]))[judged].mean()
        if loss < best_loss:
            best, best_loss, best_step = Model(gain, float(bias[1] - bias[0])), loss, step
        elif step - best_step >= patience:
            break
        top = top[fitted]
        wrong = (1 / (1 + np.exp(-np.clip(margin[top] + bias[1] - bias[0], -30, 30))) - marks[fitted]) / len(fitted)
        off = np.column_stack([-wrong, wrong])  # of the cross-entropy, by logit
        chosen, counts = _ranges(word, starts[top], ends[top])
        of, share_of = np.repeat(np.arange(len(top)), counts), np.repeat(1 / sizes[top], counts)[:, None]
        used, at = np.unique(chosen, return_inverse=True)
        held, counts = _ranges(gram, gram_at[used], gram_at[used + 1])
        vectors = _add_by(np.repeat(np.arange(len(used)), counts), table[held], len(used)) / n_grams[used][:, None]
        mean = _add_by(of, vectors[at] * share_of, len(top))
        of_word = _add_by(at, (off @ soft.T)[of] * share_of, len(used)) / n_grams[used][:, None]
        gradients = (_add_by(held, np.repeat(of_word, counts, axis=0), buckets) * slow[:, None], mean.T @ off, off.sum(axis=0))
        for i, gradient in enumerate(gradients):
            moves[i] = 0.8 * moves[i] - gradient
            paid[i] += np.abs(moves[i]).max() ** 2
            weights[i] = weights[i] + rate * moves[i] / np.sqrt(paid[i])
    return best


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of each text in order, words joined by blanks; none of a text without words."""
    for b in batches:
        rows = []
        for row, toxic, text in zip(b.row, b.toxic, b.text):
            rows += [(row, toxic, i, " ".join(ws)) for i, ws in enumerate(windows(text))]
        yield pd.DataFrame(rows, columns=["row", "toxic", "nth", "window"])


def learn(docs: DataFrame, labels: DataFrame, most: int = 10_000, most_windows: int = 40_000) -> Model:
    """A model of at most `most` labelled texts that are not held out, in the order of a hash of doc_id, and at most `most_windows`
    windows of theirs: the documented bounds on the sample that the model is fitted on. Labels other than 0 and 1, null ids
    and texts without words are left aside."""
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(~_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marks), "doc_id").select(F.xxhash64("doc_id", "text", "toxic").alias("row"), "toxic", "text")
    cut = stash(rows.mapInPandas(_cut, "row long, toxic int, nth int, window string"))
    sample = cut.orderBy("row", "nth", "toxic", "window").limit(most_windows).toPandas()
    return train([([[intern(w) for w in x.split(" ")] for x in g.window], int(g.toxic.iat[0])) for _, g in sample.groupby("row", sort=True)])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, remember: int = 500_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    score is the probability, from 0 to 1, that the text is toxic; predicted is 1 from `threshold` on. Only text is an input of a
    score. Null text is empty text and has the score of the bias alone. Texts of any length are scored whole, in time linear
    in their length. Rows that repeat are scored each; extra columns are not read. Rows whose crc32(doc_id as text) is
    divisible by 5, and those without doc_id, are held out and never learned from. Without labels every score is 0.5.
    A task keeps the scores of at most `remember` words at a time, which changes no result.
    """
    small_batches(docs.sparkSession)
    model = learn(docs, labels)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = model.words()
        for texts in batches:
            out = []
            for text in texts:
                if len(known) > remember:
                    known.clear()
                out.append(model.score(text, known))
            yield pd.Series(out, dtype=float)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), scored(F.coalesce("text", F.lit(""))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
