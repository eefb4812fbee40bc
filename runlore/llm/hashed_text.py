"""Hashed features of words, and sparse sums over them in numpy, shared by the two text classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mixed

_ODD = np.random.default_rng(3).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def word_features(words: Words, at: np.ndarray, low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For some words of texts: word (place in at) and bucket of each of their features, which are the word itself and
    its character n-grams from low to high characters, the word's ends marked."""
    data = words.data
    shown = " ".join(f"<{data[s:e].decode('utf-8', 'replace')}>" for s, e in zip(words.starts[at], words.ends[at], strict=True))
    codes = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = codes == 32
    word = np.cumsum(gap, dtype=np.int32)
    bucket_of = lambda h: ((mixed(h) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    found_word, found_bucket = [], []
    for n in range(low, high + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h += codes[j : j + m] * _ODD[j]
        ok = (word[:m] == word[n - 1 :]) & ~gap[:m]  # a gap starts the next word's number
        found_word.append(word[:m][ok])
        found_bucket.append(bucket_of(h[ok]))
    found_word.append(np.arange(len(at), dtype=np.int32))
    found_bucket.append(bucket_of(words.hashes[at] + _ODD[15]))
    return np.concatenate(found_word), np.concatenate(found_bucket)


_RUN = 1 << 20


class Bags:
    """Rows as sparse sums: entry i adds weight i (1 without weights) times the value of feature i to row i."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, rows: int, weight: np.ndarray | None = None):
        self.row, self.feature, self.rows, self.weight = row.astype(np.int32, copy=False), feature.astype(np.int32, copy=False), rows, weight

    def _summed(self, into: np.ndarray, at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Sums of values[at] by into, in runs, as a sum over all entries at once takes several times their room."""
        out = np.zeros(size)
        for i in range(0, len(into), _RUN):
            run = slice(i, i + _RUN)
            found = values[at[run]]
            out += np.bincount(into[run], found if self.weight is None else found * self.weight[run], size)
        return out

    def forward(self, values: np.ndarray) -> np.ndarray:
        return self._summed(self.row, self.feature, values, self.rows)

    def backward(self, grads: np.ndarray, features: int) -> np.ndarray:
        return self._summed(self.feature, self.row, grads, features)


class Adam:
    """First-order steps for one array."""

    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, grad: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, zeros: int, ones: int, max_chars: int, where=None,
    id_col: str = "doc_id", text: str = "text",
) -> tuple[list[tuple], float]:
    """(text, label) of at most so many labelled documents of each class, those of the lowest id hashes, whose texts
    have at most max_chars characters; and the share of label 1 among all labels. Rows without id, text or a label of
    0 or 1 are left out; of ids that repeat, one row counts. The ids are bounded by the parameters, so they are
    broadcast and what comes to the driver is bounded too."""
    ids = labels.filter(F.col(label).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null")
    if where is not None:
        ids = ids.filter(where(F.col("i")))
    ids = ids.groupBy("i").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("i"))
    picked = ids.filter("y = 0").orderBy("h", "i").limit(zeros).unionByName(ids.filter("y = 1").orderBy("h", "i").limit(ones))
    found = (
        docs.select(F.col(id_col).alias("d"), F.col(text).alias("t"))
        .filter(F.length("t") <= max_chars)
        .join(F.broadcast(picked), F.col("d") == F.col("i"))
        .groupBy("h", "d", "y").agg(F.min("t").alias("t"))
        .orderBy("h", "d")
    )
    share = ids.agg(F.avg("y")).first()[0]
    return [(r["t"], r["y"]) for r in found.select("t", "y").toLocalIterator()], 0.5 if share is None else share


def text_runs(texts: pd.Series, most: int = 700_000) -> Iterator[list[str | None]]:
    """The texts of a batch in runs of bounded total length, or of one text."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run
