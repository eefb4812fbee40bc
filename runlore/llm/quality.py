"""Quality rules: counts of a text against fixed thresholds, then a calibrated logistic regression over hashed word
and character n-grams that is trained on labelled quality rows and scored in Arrow batches.

The features of a text are means over its words: of each word the word itself and its character n-grams (as written:
case and signs matter), and of each pair of neighbours the word 2-gram; a word right after itself is one feature of
all such pairs. The regression is linear, so a batch of texts sums weights over the n-grams of its different words,
and these sums over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let_go
from .hashed_text import Adam, Bags, labelled_sample, text_runs, word_features
from .words import Words, pair_hash, words_of

BUCKETS = 1 << 18
LOW, HIGH = 1, 3
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 0.5
#: A text is kept when its calibrated probability of good quality reaches this.
KEEP = 0.5
FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, quality double, kept boolean"
#: The bucket of a word right after itself.
_SAME = 77


def _pairs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word 2-gram."""
    of = words.text
    within = of[1:] == of[:-1]
    a, b = words.hashes[:-1][within], words.hashes[1:][within]
    bucket = (pair_hash(a, b) >> np.uint64(20)) % np.uint64(BUCKETS)
    return of[1:][within], np.where(a == b, _SAME, bucket.astype(np.int64))


@dataclass
class QualityModel:
    """weights: per bucket; scale and shift: of the calibration on rows that were not trained on."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def probabilities(self, words: Words) -> np.ndarray:
        """Each text's calibrated probability of good quality."""
        n = len(words.counts)
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        word, bucket = word_features(words, first, LOW, HIGH, BUCKETS)
        of_word = np.bincount(word, self.weights[bucket], len(first)) / np.maximum(1, np.bincount(word, minlength=len(first)))
        x = self.bias + np.bincount(words.text, of_word[back], n) / np.maximum(1, words.counts)
        of, bucket = _pairs(words)
        x += np.bincount(of, self.weights[bucket], n) / np.maximum(1, words.counts - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * x + self.shift, -60, 60)))


def repeated_words(words: Words) -> np.ndarray:
    """Of each text, how many words stand in a window of three words that the text has twice or more, first places
    included. Windows are compared by 64-bit hashes."""
    h, of = words.hashes, words.text
    covered = np.zeros(len(h) + 2, bool)
    if len(h) > 2:
        at = np.flatnonzero(of[2:] == of[:-2])
        window = pair_hash(pair_hash(h[at], h[at + 1]), h[at + 2])
        window = pair_hash(window, of[at].astype(np.uint64))
        _, back, n = np.unique(window, return_inverse=True, return_counts=True)
        again = at[n[back] > 1]
        for k in range(3):
            covered[again + k] = True
    return np.bincount(of, covered[: len(h)], len(words.counts)).astype(np.int64)


def base_counts(texts: list[str | None]) -> tuple[Words, pd.DataFrame]:
    """The words of texts, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each."""
    words = words_of(texts, lower=False)
    blanks, rows = BLANKS.decode(), []
    for n, text in zip(words.counts, texts, strict=True):
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(blanks)]
        chars = len(text) - sum(map(text.count, blanks))
        rows.append((n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines"])
    return words, out.assign(n_repeat_words=repeated_words(words))


def train_quality(rows: list[tuple[str, int]], steps: int = 80, rate: float = 0.05, decay: float = 1e-7, held: int = 5) -> QualityModel:
    """Fits on (text, label) rows; every held-th row is set aside for the calibration. Without rows of both classes
    the model says that any text is good."""
    y = np.array([r[1] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return QualityModel(np.zeros(BUCKETS, np.float32), 60.0)
    found = words_of([r[0] for r in rows], lower=False)
    _, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
    word, bucket = word_features(found, first, LOW, HIGH, BUCKETS)
    words = Bags(word, bucket, len(first))
    parts = np.maximum(1, np.bincount(word, minlength=len(first)))
    entry, n = np.unique(found.text * len(first) + back, return_counts=True)
    of, at = entry // len(first), entry % len(first)
    docs = Bags(of, at, len(y), n / (found.counts[of] * parts[at]))
    of, at = _pairs(found)
    grams = Bags(of, at, len(y), 1 / np.maximum(1, found.counts - 1)[of])
    fit = np.arange(len(y)) % held != held - 1
    share = np.where(y == 1, 0.5 / max(1, (y[fit] == 1).sum()), 0.5 / max(1, (y[fit] == 0).sum())) * fit
    weights, bias, of_weights, of_bias = np.zeros(BUCKETS), np.zeros(1), Adam(BUCKETS, rate), Adam(1, rate)
    for _ in range(steps):
        x = docs.forward(words.forward(weights)) + grams.forward(weights) + bias[0]
        d = (1 / (1 + np.exp(-np.clip(x, -60, 60))) - y) * share
        g = words.backward(docs.backward(d, len(first)), BUCKETS) + grams.backward(d, BUCKETS)
        weights += of_weights.step(g + decay * weights)
        bias += of_bias.step(np.array([d.sum()]))
    x = docs.forward(words.forward(weights)) + grams.forward(weights) + bias[0]
    scale, shift = _calibrated(x[~fit], y[~fit]) if 0 < y[~fit].sum() < (~fit).sum() else (1.0, 0.0)
    return QualityModel(weights.astype(np.float32), float(bias[0]), scale, shift)


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make sigmoid(scale * x + shift) a probability of y, with smoothed targets; the slope may
    not turn round."""
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    at, step = np.array([1.0, 0.0]), Adam(2, 0.05)
    for _ in range(400):
        d = (1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -60, 60))) - t) / len(y)
        at += step.step(np.array([(d * x).sum(), d.sum()]))
    return max(1e-3, float(at[0])), float(at[1])


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", zeros: int = 1500, ones: int = 1500, max_chars: int = 8_000, **options
) -> QualityModel:
    """A model of a bounded sample of labelled rows: at most so many zeros and ones, texts of at most max_chars characters (see labelled_sample)."""
    model = train_quality(labelled_sample(docs, labels, label, zeros, ones, max_chars)[0], **options)
    let_go()
    return model


def quality(df: DataFrame, model: QualityModel, text: str = "text") -> Column:
    """A struct column (FIELDS) of a whole text's counts, base verdict, probability of good quality, and whether it is
    kept: that it passes the base rules and its probability reaches KEEP. A null text has no words and fails. The
    model's size is fixed by its number of buckets (1 MB), so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(FIELDS)
    def score(texts: pd.Series) -> pd.DataFrame:
        made = []
        for run in text_runs(texts):
            words, out = base_counts(run)
            out["base_failed"] = (out["n_words"] < MIN_WORDS) | (out["n_repeat_words"] > MAX_REPEATED * out["n_words"])
            out["quality"] = shared.value.probabilities(words)
            made.append(out.assign(kept=~out["base_failed"] & (out["quality"] >= KEEP)))
        return pd.concat(made) if made else pd.DataFrame({x.split()[0]: [] for x in FIELDS.split(", ")})

    return score.asNondeterministic()(F.col(text))  # so that it is not computed once more for a filter
