"""Scoring with an interpolated modified Kneser-Ney bigram model.

Bigrams are counted in Spark: each task sums what it has read and sends it as sorted blocks to shards by a hash of the
context (of context and word for the few contexts that are so frequent that they would overfill a shard). A shard
merges its blocks and stores its bigrams as a sorted array of 64-bit hashes with their counts; what the lower order
and the contexts need goes on, as blocks again, to shards by word, which store a sorted array of word hashes with
counts. The files lie in the folder that driver and executors share; scoring workers map them into memory and look up
sorted batches of hashes, so a worker's own memory stays bounded while the model grows with the corpus. Each shard has
a file, also where it holds nothing, so one that is missing is an error.

A file's content depends on the corpus alone and is put in place by a rename, so a task that runs again after an
executor is lost writes the same file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hash_files import by_number
from .shared_files import arrays, new_folder, put
from .words import mixed, pair_hash, texts_words

#: Hashes of the marks before and after a text.
START, END = np.uint64(0x51A2B3C4D5E6F701), np.uint64(0x0E1D2C3B4A596877)
#: Bytes of text for each shard of bigrams, shards of bigrams for each shard of words, bigrams of a task's block.
SHARD_BYTES, WORD_SHARDS_PER, FLUSH = 24_000_000, 4, 3_000_000


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest width that holds them, behind that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"u{width}").tobytes()


def _wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys and the sums of each of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)


def _discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 1, 2 and from 3 on, from the numbers of n-grams of counts 1 to 4. Where these don't tell
    (a count that doesn't occur), a discount of half a count, which keeps all probabilities proper."""
    n = np.asarray(n, float)
    if (n <= 0).any():
        return np.array([0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]])
    return np.where((d > 0) & (d < np.array([1, 2, 3])), d, 0.5)


def _shard(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, shards: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(heavy, context), max(0, len(heavy) - 1))
    is_heavy = heavy[at] == context if len(heavy) else np.zeros(len(context), bool)
    return (mixed(np.where(is_heavy, pair_hash(context, word), context)) % np.uint64(shards)).astype(np.int64)


def _bigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of each token of all texts, each text's end being a token, and the tokens of each text."""
    words, counts = texts_words(texts)
    n = counts + 1
    last = np.cumsum(n) - 1
    word = np.full(len(words) + len(counts), END, np.uint64)
    is_word = np.ones(len(word), bool)
    is_word[last] = False
    word[is_word] = words
    context = np.concatenate([[START], word[:-1]]) if len(word) else word
    context[last[:-1] + 1] = START
    return context, word, n


@dataclass
class LanguageModel:
    """Where the files are, how bigrams and words are dealt to them, and the numbers of the whole corpus."""

    folder: str
    shards: int
    word_shards: int
    heavy: np.ndarray
    tokens: int = 0
    vocabulary: int = 0
    continuations: int = 0
    bigram_discounts: np.ndarray = field(default_factory=lambda: np.full(3, 0.5))
    word_discounts: np.ndarray = field(default_factory=lambda: np.full(3, 0.5))
    left_over: float = 1.0

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Columns count, continuations, and contexts' words of count 1, 2 and more, of each of different hashes."""
        out = np.zeros((5, len(hashes)), np.int64)
        for s, at in by_number((mixed(hashes) % np.uint64(self.word_shards)).astype(np.int64)):
            keys, *columns = arrays(self.folder, f"words-{s}")
            place, hit = _found(keys, hashes[at])
            for row, column in zip(out, columns, strict=True):
                row[at[hit]] = column[place]
        return out

    def counts(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The counts of different bigrams."""
        out = np.zeros(len(context), np.int64)
        key = pair_hash(context, word)
        for s, at in by_number(_shard(context, word, self.heavy, self.shards)):
            keys, counts, big_at, big = arrays(self.folder, f"bigrams-{s}")
            place, hit = _found(keys, key[at])
            found = counts[place].astype(np.int64)
            over = np.flatnonzero(found == 255)
            found[over] = big[np.searchsorted(big_at, place[over])]
            out[at[hit]] = found
        return out

    def score(self, texts: list[str | None]) -> pd.DataFrame:
        """n_tokens, n_known, base_score, score of each text."""
        context, word, n = _bigrams(texts)
        doc = np.repeat(np.arange(len(n)), n)
        ids, inverse = np.unique(np.concatenate([word, context]), return_inverse=True)
        at_word, at_context = inverse[: len(word)], inverse[len(word) :]
        count, continued, one, two, more = self.words(ids)
        vocabulary = self.vocabulary + 1
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * vocabulary))
        known = (count > 0) & (ids != START)
        base[ids == START] = 0
        lower = (continued - _taken(continued, self.word_discounts)) / max(1, self.continuations) + self.left_over / vocabulary
        d = self.bigram_discounts
        free = np.where(count > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(1, count), 1.0)
        pair = at_context.astype(np.int64) * len(ids) + at_word
        pairs, back = np.unique(pair, return_inverse=True)
        c, w = pairs // len(ids), pairs % len(ids)
        seen = self.counts(ids[c], ids[w])
        p = (seen - _taken(seen, d)) / np.maximum(1, count[c]) + free[c] * lower[w]
        add = lambda x: np.bincount(doc, x, len(n))
        return pd.DataFrame(
            {"n_tokens": n.astype(np.int64), "n_known": add(known[at_word].astype(float)).astype(np.int64), "base_score": add(base[at_word]), "score": add(np.log10(p)[back])}
        )


def _taken(count: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], discounts])[np.minimum(count, 3)]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys of those wanted that are there, and which of them are."""
    order = np.argsort(wanted)
    place = np.empty(len(wanted), np.int64)
    place[order] = np.searchsorted(keys, wanted[order])
    hit = np.flatnonzero(keys[np.minimum(place, len(keys) - 1)] == wanted) if len(keys) else np.zeros(0, np.int64)
    return place[hit], hit


def train_language_model(docs: DataFrame, text: str = "text") -> LanguageModel:
    """Counts all words of all texts (null: empty) in lower case and stores the model's files in the shared folder.
    An empty table gives a model under which only texts' ends and one unknown word exist."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    shards = max(16, math.ceil(size / SHARD_BYTES))
    word_shards = max(4, math.ceil(shards / WORD_SHARDS_PER))
    model = LanguageModel(new_folder(spark, "language-model"), shards, word_shards, _heavy(texts, shards))
    folder, heavy = model.folder, model.heavy

    def blocks(context: np.ndarray, word: np.ndarray) -> Iterator[dict]:
        _, first, count = np.unique(pair_hash(context, word), return_index=True, return_counts=True)
        context, word = context[first], word[first]
        shard = _shard(context, word, heavy, shards)
        order = np.lexsort((context, shard))
        context, word, shard, count = context[order], word[order], shard[order], count[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            run = np.concatenate([[0], np.flatnonzero(np.diff(context[a:b])) + 1, [b - a]])
            yield {
                "shard": int(shard[a]), "contexts": context[a:b][run[:-1]].tobytes(), "runs": _narrow(np.diff(run)),
                "words": word[a:b].tobytes(), "counts": _narrow(count[a:b]),
            }

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            for part in _parts(b["text"]):
                held.append(_bigrams(part)[:2])
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield pd.DataFrame(list(blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))))
                    held, n = [], 0
        if n:
            yield pd.DataFrame(list(blocks(*(np.concatenate(x) for x in zip(*held, strict=True)))))

    def store_bigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        context = np.concatenate([np.repeat(np.frombuffer(c, np.uint64), _wide(r)) for c, r in zip(rows["contexts"], rows["runs"], strict=True)])
        word = np.concatenate([np.frombuffer(w, np.uint64) for w in rows["words"]])
        count = np.concatenate([_wide(c) for c in rows["counts"]])
        del rows
        hashes = pair_hash(context, word)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
        keys, sums = hashes[first], np.add.reduceat(count[order], first) if len(first) else count
        context, word = context[order[first]], word[order[first]]
        del hashes, order, count, first
        over = np.flatnonzero(sums >= 255)
        put(folder, f"bigrams-{key[0]}", keys, np.minimum(sums, 255).astype(np.uint8), over.astype(np.uint64), sums[over].astype(np.uint64))
        of_context = _sums(context, sums, *((sums == k).astype(np.int64) for k in (1, 2)), (sums > 2).astype(np.int64))
        of_word = _sums(word, np.ones(len(word), np.int64))
        found = [(sums == k).sum() for k in (1, 2, 3, 4)]
        out = []
        for s in range(word_shards):
            c = (mixed(of_context[0]) % np.uint64(word_shards)) == s
            w = (mixed(of_word[0]) % np.uint64(word_shards)) == s
            columns = [_narrow(x[c]) for x in of_context[1:]] + [_narrow(of_word[1][w])]
            out.append({"shard": s, "contexts": of_context[0][c].tobytes(), "words": of_word[0][w].tobytes(), "columns": columns, "found": found if s == 0 else [0] * 4})
        return pd.DataFrame(out)

    def store_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.concatenate([np.frombuffer(x, np.uint64) for name in ("contexts", "words") for x in rows[name]])
        n = sum(len(x) // 8 for x in rows["contexts"])
        of_context = [np.concatenate([_wide(x[k]) for x in rows["columns"]]) for k in range(4)]
        continued = np.concatenate([_wide(x[4]) for x in rows["columns"]])
        pad = np.zeros(len(hashes) - n, np.int64)
        values = [np.concatenate([x, pad]) for x in of_context] + [np.concatenate([np.zeros(n, np.int64), continued])]
        words, count, one, two, more, continued = _sums(hashes, *values)
        if END in words:  # it is no context, and each start has its end
            at = int(np.searchsorted(words, END))
            count[at] = 0
        put(folder, f"words-{key[0]}", words, count.astype(np.uint64), continued.astype(np.uint32), *(x.astype(np.uint32) for x in (one, two, more)))
        is_word = (words != START) & (words != END)
        found = np.sum([np.asarray(x, np.int64) for x in rows["found"]], axis=0)
        made = {
            "texts": int(count[words == START].sum()), "tokens": int(count[is_word].sum()), "words": int(is_word.sum()), "continuations": int(continued.sum()),
            "found": [int(x) for x in found], "continued": [int((continued == k).sum()) for k in (1, 2, 3, 4)] + [int((continued > 2).sum())],
        }
        return pd.DataFrame([made])

    block = "shard int, contexts binary, runs binary, words binary, counts binary"
    part = "shard int, contexts binary, words binary, columns array<binary>, found array<bigint>"
    total = "texts bigint, tokens bigint, words bigint, continuations bigint, found array<bigint>, continued array<bigint>"
    nothing = F.lit(_narrow(np.zeros(0, np.int64)))
    every = spark.range(0, shards, 1, 1).select(
        F.col("id").cast("int").alias("shard"), F.lit(b"").alias("contexts"), nothing.alias("runs"), F.lit(b"").alias("words"), nothing.alias("counts")
    )
    rows = (
        texts.mapInPandas(counted, block).unionByName(every).repartition(shards, "shard").groupBy("shard").applyInPandas(store_bigrams, part)
        .repartition(word_shards, "shard").groupBy("shard").applyInPandas(store_words, total).collect()  # one row for each shard of words
    )
    ends = sum(r["texts"] for r in rows)
    if not ends:
        return model
    model.tokens = sum(r["tokens"] for r in rows) + ends
    model.vocabulary = sum(r["words"] for r in rows) + 1
    model.continuations = sum(r["continuations"] for r in rows)
    model.bigram_discounts = _discounts(np.sum([r["found"] for r in rows], axis=0))
    kinds = np.sum([r["continued"] for r in rows], axis=0)
    model.word_discounts = _discounts(kinds[:4])
    model.left_over = float((model.word_discounts * kinds[[0, 1, 4]]).sum() / model.continuations)
    _set_end(model, ends)
    return model


def _set_end(model: LanguageModel, ends: int) -> None:
    """The end's count, which is the number of texts, in the file of its shard."""
    name = f"words-{int(mixed(np.array([END]))[0] % np.uint64(model.word_shards))}"
    columns = [np.array(x) for x in arrays(model.folder, name)]
    columns[1][np.searchsorted(columns[0], END)] = ends
    put(model.folder, name, *columns)


def _parts(texts: pd.Series, most: int = 4_000_000) -> Iterator[list[str | None]]:
    """The texts in runs of bounded total length, or of one text."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "") + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _heavy(texts: DataFrame, shards: int, share: float = 0.02) -> np.ndarray:
    """Hashes of contexts so frequent that they would fill half a shard or more, as a sample of texts estimates. They
    are at most 2 * shards, and only tell where counts are kept, not what they are."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _parts(b["text"]):
                h, n = np.unique(texts_words(part)[0], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    counts = texts.sample(share, seed=7).mapInPandas(seen, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * (2 * shards) >= F.lit(total)).select("h").collect() if total else []
    return np.sort(np.array([START, *(np.int64(r["h"]).view(np.uint64) for r in found)], np.uint64))


def language_model_scores(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each row its id as "id", n_tokens, n_known (tokens that training has), base_score (log10 by smoothed word
    counts), score (the model's log10 probability of the text) and perplexity; a null text is an empty one. Repeated
    rows are scored each."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for part in _parts(b["text"]):
                out = model.score(part)
                out.insert(0, "id", b["id"].iloc[at : at + len(part)].to_numpy())
                out["perplexity"] = 10 ** (-out["score"] / out["n_tokens"])
                at += len(part)
                yield out

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(scored, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")
