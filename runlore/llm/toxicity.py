"""Toxicity: a linear softmax over the mean of subword embeddings, both trained jointly in numpy.

A word's subwords are the word itself and its character n-grams, hashed to buckets with an embedding each. A
misspelling that was never seen shares most n-grams, and so most vectors, with the word it comes from. As the
classifier is linear in the mean, a trained model folds into one number per bucket, and scoring a batch of texts sums
that number over the n-grams of its different words, and these sums over its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_text import Adam, Bags, labelled_sample, text_runs, word_features
from .words import NOT_ALNUM, Words, words_of

LOW, HIGH = 3, 5
PRIOR = 200.0


def _words(texts: list[str | None]) -> Words:
    return words_of([(t or "").lower() for t in texts], lower=False, blanks=NOT_ALNUM)


def _bags(words: Words, back: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and weight of each different word of each text. A word counts by the root of its number, so that one
    that is said over and over doesn't make up a text, and weights are by all subwords and PRIOR more that say
    nothing, so that a few words say little."""
    entry, n = np.unique(words.text * len(parts) + back, return_counts=True)
    of, at = entry // max(1, len(parts)), entry % max(1, len(parts))
    root = np.sqrt(n)
    return of, at, root / (PRIOR + np.bincount(of, root * parts[at], len(words.counts)))[of]


@dataclass
class ToxicityModel:
    """projected: per bucket, embedding times the difference of the two softmax rows; bias: the same of the biases."""

    projected: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Each text's probability of being toxic."""
        words = _words(texts)
        _, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        word, bucket = word_features(words, first, LOW, HIGH, len(self.projected))
        of, at, weight = _bags(words, back, np.bincount(word, minlength=len(first)))
        mean = np.bincount(of, np.bincount(word, self.projected[bucket], len(first))[at] * weight, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.bias + mean, -60, 60)))


def train_toxicity(
    rows: list[tuple[str, int]], share: float | None = None, buckets: int = 1 << 19, dim: int = 4, steps: int = 60,
    rate: float = 0.1, decay: float = 1e-5, scale: float = 10.0, min_seen: int = 1, seed: int = 1,
) -> ToxicityModel:
    """Fits on (text, label) rows; share: of label 1 where the model is used, to which rows are weighted. Without rows, or with one class only, the model says that class's smoothed share
    (0.5 without rows). All buckets are learnt, and decay keeps those that few texts hold small; with min_seen, buckets seen fewer times stay at 0. Full-batch steps on the logarithmic loss; the sums run over words, then subwords."""
    y = np.array([r[1] for r in rows], int)
    drawn = (y.sum() + 1) / (len(y) + 2)
    share = min(0.99, max(0.01, drawn if share is None else share))
    if not 0 < y.sum() < len(y):
        return ToxicityModel(np.zeros(buckets, np.float32), float(np.log(drawn / (1 - drawn))))
    found = _words([r[0] for r in rows])
    _, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
    word, bucket = word_features(found, first, LOW, HIGH, buckets)
    of, at, weight = _bags(found, back, np.bincount(word, minlength=len(first)))
    seen = np.bincount(bucket, np.bincount(at, minlength=len(first))[word], buckets)
    often = seen[bucket] >= min_seen
    used, bucket = np.unique(bucket[often], return_inverse=True)
    words = Bags(word[often], bucket, len(first))
    docs = Bags(of, at, len(y), weight)
    rng = np.random.default_rng(seed)
    embed, soft = rng.normal(0, 0.05, (dim, len(used))), rng.normal(0, 0.5, (2, dim))
    bias = np.log(np.array([1 - share, share]))
    steps_of = Adam(embed.shape, rate), Adam(soft.shape, rate), Adam(bias.shape, rate)
    target = np.stack([1 - y, y]).astype(float)
    weight_of = np.where(y == 1, share / drawn, (1 - share) / (1 - drawn))
    for _ in range(steps):
        mean = np.stack([docs.forward(words.forward(e)) for e in embed])
        logits = scale * soft @ mean + bias[:, None]
        logits -= logits.max(0)
        p = np.exp(logits)
        p /= p.sum(0)
        d = (p - target) * weight_of / len(y)
        back_d = scale * soft.T @ d
        g_embed = np.stack([words.backward(docs.backward(b, len(first)), len(used)) for b in back_d]) + decay * embed
        g_soft = scale * d @ mean.T + decay * soft
        embed += steps_of[0].step(g_embed)
        soft += steps_of[1].step(g_soft)
        bias += steps_of[2].step(d.sum(1))
    projected = np.zeros(buckets, np.float32)
    projected[used] = scale * (soft[1] - soft[0]) @ embed
    return ToxicityModel(projected, float(bias[1] - bias[0]))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, where=None, label: str = "toxic", zeros: int = 3000, ones: int = 1500,
    max_chars: int = 8_000, **options,
) -> ToxicityModel:
    """A model of a bounded sample of labelled rows: at most so many zeros and ones, texts of at most max_chars characters (see labelled_sample). where: a condition on the id of the rows that may be learnt from."""
    rows, share = labelled_sample(docs, labels, label, zeros, ones, max_chars, where)
    return train_toxicity(rows, float(np.sqrt(0.5 * share)), **options)  # half-way to even classes, as ones are few


def toxicity_score(df: DataFrame, model: ToxicityModel, text: str = "text") -> Column:
    """A column with the probability that a whole text is toxic; a null or empty text gets the model's bias alone.
    The model's size is fixed by its number of buckets (2 MB), so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value.scores(run) for run in text_runs(texts)] or [np.zeros(0)]))

    return score.asNondeterministic()(F.col(text))  # so that it is not computed once more for a filter
