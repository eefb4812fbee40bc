"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Texts are lower-cased, and each run of characters that are no letters counts as one gap. Features are n-grams of 1 to
MOST characters (gaps mark the ends of words), hashed into BUCKETS; a text's value for a bucket is its share of the text's
n-grams times the bucket's inverse document frequency, which is counted over all documents that may be learnt from.

Weights come from follow-the-regularised-leader with an elastic-net penalty on a bounded sample of texts, so most of them
are exactly zero and only rows of buckets with weights are sent to workers. A temperature, fitted on a fifth of the
sample that takes no other part, turns the model's values into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go
from .hashed_text import text_runs
from .words import mixed

MOST, BUCKETS = 4, 1 << 17
#: Characters of a language's texts that are learnt from, on average; documents a turn and turns over the sample.
SAMPLE_CHARS, EPOCHS = 1_000_000, 4
#: Characters that are cut to n-grams together.
RUN = 300_000
#: Step size and its offset, and the penalties on the sum of weights and of their squares.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.001
#: What values are multiplied by, as shares are small.
SCALE = 10.0
UNKNOWN = "und"
_ODD = np.random.default_rng(23).integers(0, 1 << 63, MOST + 2, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = r"\p{L}"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of texts, text by text, and their number by text."""
    shown = "\n".join((t or "").replace("\n", " ").lower() for t in texts)
    codes = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 10)
    letter = _is_letter()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    text = np.zeros(len(codes), np.int32)
    text[ends] = 1
    text = np.cumsum(text) - text
    keep = letter.copy()  # of a run of other characters the first one stays, as a gap, if letters stand before it
    keep[1:] |= letter[:-1]
    keep[ends] = True
    codes[ends] = 10
    codes, text = codes[keep], text[keep]
    cut = codes == 10
    base, found, of = codes.copy(), [], []
    h = np.zeros(len(codes), np.uint64)
    bad = np.zeros(len(codes), bool)
    for n in range(1, MOST + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] + base[n - 1 :] * _ODD[n - 1]
        bad = bad[:m] | cut[n - 1 :]
        ok = ~bad
        if n == 1:
            ok = ok & (codes != 32)
        found.append((mixed(h[ok] + _ODD[MOST + 1 : MOST + 2] * np.uint64(n)) >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1))
        of.append(text[:m][ok])
    if not found:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    bucket, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return bucket[order], np.bincount(of, minlength=len(texts))


@dataclass
class LanguageModel:
    """languages in order; row: of each bucket its place in weights (0: none); weights of each language (the first one zero)
    times the buckets' inverse document frequency; bias."""

    languages: list[str]
    row: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text those of all languages, and whether it has a letter."""
        bucket, n = gram_buckets(texts)
        rows, sums = self.row[bucket], np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        for c in range(len(self.languages)):
            if len(some):
                sums[some, c] = np.add.reduceat(self.weights[c][rows], starts, dtype=np.float64)
        values = (sums * (SCALE / np.maximum(n, 1))[:, None] + self.bias) / self.temperature
        return _softmax(values) if self.languages else sums, n > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_language_id(samples: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray) -> LanguageModel:
    """From (buckets, counts, language) of texts and the buckets' inverse document frequencies. Every fifth text of each
    language, of those that have five, is set aside for the temperature."""
    languages = sorted({x[2] for x in samples})
    place = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    if k == 0:
        return LanguageModel([], np.zeros(BUCKETS, np.int32), np.zeros((0, 1), np.float32), np.zeros(0))
    seen, rows, held = dict.fromkeys(languages, 0), [], []
    for bucket, count, language in samples:
        seen[language] += 1
        value = np.append(SCALE * count / max(1, count.sum()) * idf[bucket], 1.0)  # the last is the bias
        (held if seen[language] % 5 == 0 else rows).append((np.append(bucket, BUCKETS), value, place[language]))
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    share = np.bincount([r[2] for r in rows], minlength=k)
    weigh = np.sqrt(len(rows) / (k * np.maximum(1, share)))  # rarer languages count more, half-way to even
    draw = np.random.default_rng(29)
    for _ in range(EPOCHS if k > 1 else 0):
        for i in draw.permutation(len(rows)):
            at, x, y = rows[i]
            own, squares = z[at], n[at]
            w = leader(own, squares)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * (p * weigh[y])
            more = squares + g * g
            z[at] = own + g - (np.sqrt(more) - np.sqrt(squares)) / ALPHA * w
            n[at] = more
    w = leader(z, n)
    model = LanguageModel(languages, np.zeros(BUCKETS, np.int32), np.zeros((k, 1), np.float32), w[BUCKETS])
    used = np.flatnonzero((w[:BUCKETS] != 0).any(axis=1))
    model.row[used] = np.arange(1, len(used) + 1)
    model.weights = np.ascontiguousarray(np.concatenate([model.weights, (w[used] * idf[used][:, None]).T.astype(np.float32)], axis=1))
    if held and k > 1:
        model.temperature = _temperature(np.stack([x @ w[at] for at, x, _ in held]), np.array([y for *_, y in held]))
    return model


def _temperature(values: np.ndarray, y: np.ndarray) -> float:
    """What to divide values by so that the right languages are likeliest, within 1/20 and 20; each language's probability
    is mixed with a little of all, as texts set aside may all be right."""
    k = values.shape[1]

    def loss(log_t: float) -> float:
        p = _softmax(values / np.exp(log_t))[np.arange(len(y)), y]
        return -np.log(p * (1 - 1e-4) + 1e-4 / k).mean()

    low, high, golden = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language_id(
    docs: DataFrame, where: Column | None = None, sample_chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """A model of the rows where it is true that they may be learnt from, whose language isn't null and whose text has a
    letter. Document frequencies are counted over all of them. Weights are learnt from a sample: of each language a share of
    its texts by hash of id and text, so that it has sample_chars characters on average; texts are taken whole, so a
    sample is larger by one text at most where texts are longer. The number of languages is taken to be small."""
    context = docs.sparkSession.sparkContext
    rows = docs.filter(F.lit(True) if where is None else where)
    rows = rows.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit(31), F.col(id_col), F.col(text)).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, documents = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.uint8), 0
        chars: dict[str, int] = {}
        for b in batches:
            documents += len(b)
            for name, size in zip(b["lang"], b["text"].str.len(), strict=True):
                chars[name] = chars.get(name, 0) + size
            for run in text_runs(b["text"], RUN):
                bucket, sizes = gram_buckets(run)
                for own in np.split(bucket, np.cumsum(sizes)[:-1]):
                    held[own] = 1
                    n += held
                    held[own] = 0
        at = np.flatnonzero(n)
        yield pd.DataFrame({"bucket": at, "lang": None, "n": n[at]})
        yield pd.DataFrame({"bucket": -1, "lang": list(chars), "n": list(chars.values())}).astype({"bucket": "int64", "lang": object, "n": "int64"})
        yield pd.DataFrame({"bucket": [-2], "lang": [None], "n": [documents]})
        let_go()

    told = rows.select("text", "lang").mapInPandas(counted, "bucket bigint, lang string, n bigint").groupBy("bucket", "lang").agg(F.sum("n").alias("n")).collect()
    documents = sum(r["n"] for r in told if r["bucket"] == -2)
    shares = {r["lang"]: min(1.0, sample_chars / max(1, r["n"])) for r in told if r["bucket"] == -1}
    idf = np.full(BUCKETS, np.log(1.0 + documents), np.float64)
    at = np.array([r["bucket"] for r in told if r["bucket"] >= 0], np.int64)
    idf[at] = np.log((1.0 + documents) / (1.0 + np.array([r["n"] for r in told if r["bucket"] >= 0], float))) + 0.1
    if not shares:
        return train_language_id([], idf)
    known = context.broadcast(shares)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            limit = b["lang"].map(known.value).to_numpy(float)
            b = b[(b["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)).astype(float) < limit * (1 << 53)]
            made = []
            for t, name, h in zip(b["text"], b["lang"], b["h"], strict=True):
                bucket, count = np.unique(gram_buckets([t])[0], return_counts=True)
                made.append((h, name, bucket.astype(np.int32).tobytes(), count.astype(np.int32).tobytes()))
            yield pd.DataFrame(made, columns=["h", "lang", "bucket", "n"], dtype=object)
        let_go()

    picked = rows.mapInPandas(read, "h bigint, lang string, bucket binary, n binary").orderBy("h", "lang")
    samples = [(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["n"], np.int32), r["lang"]) for r in picked.toLocalIterator()]
    return train_language_id(samples, idf)


def language(df: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct column of a whole text's likeliest language and its probability; `und` and 0 if the text is null or has no
    letter, or nothing was learnt. Of languages that are as likely the first by code points counts. The model's size is
    bounded by buckets times languages, so it is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        names, scores = [], []
        for run in text_runs(texts, RUN):
            p, lettered = shared.value.probabilities(run)
            best = p.argmax(axis=1) if p.shape[1] else np.zeros(len(run), int)
            lettered &= p.shape[1] > 0
            names += [shared.value.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
            scores += [float(own[i]) if ok else 0.0 for own, i, ok in zip(p, best, lettered, strict=True)]
        return pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    return predicted.asNondeterministic()(F.col(text))  # so that it is not computed once for each of its fields
