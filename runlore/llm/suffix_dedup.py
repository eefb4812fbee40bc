"""Removal of every byte covered by a long string that occurs elsewhere too, by column-wise construction.

Whole texts are far too many suffixes to sort together, and most of them are alike nothing. So the texts are first
cut to collections of short documents that can hold a repeat. Of each window of PASSAGE bytes the GRAM-byte string with
the smallest hash is its anchor; equal windows have equal anchors at equal places. An anchor that occurs once can't
belong to a repeated window. Around each occurrence of the others stands a document: the bytes that strings of LENGTH
bytes that start with such a window can reach. All documents of an anchor are aligned at it, so strings that are equal
start in the same column. Strings of LENGTH bytes are removed; that shorter ones, of PASSAGE bytes, are shared is only
reported.

A collection takes in one symbol of each of its documents in a round, from the last column to the first. Each round
updates the order of the documents' suffixes (the rows of the collection's Burrows-Wheeler transform that start in
this column: a stable sort by the new symbol) and the common prefixes of neighbours (one more than the least between
neighbours with the same symbol, else none). A suffix repeats a string when it shares its bytes with a neighbour. Rows
of the transform that start in other columns could only tell again what their own rounds have told, so they are not
kept, and a round costs time in proportion to the documents. Columns are read and written one after the other.

Documents that are equal are one with a count. An anchor with very many different documents would overfill its
collection; the windows of those are counted one by one by a hash instead, which any number of tasks can share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .hash_files import HashFiles
from .shared_files import removed
from .words import mixed

LENGTH, PASSAGE, GRAM = 400, 256, 128
_LEFT = PASSAGE - GRAM
_STARTS = _LEFT + 1
COLUMNS = LENGTH + _LEFT
#: Documents of one anchor that are built into one collection, bytes of a collection, and documents that a task
#: remembers having sent.
HOT, COLLECTION, MOST_SEEN = 20_000, 12_000_000, 400_000
_CHUNK, _REACH = 400_000, 2 * LENGTH
_BASE = 0xD1B54A32D192ED03
_POWERS = [
    np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_CHUNK + 2 * _REACH, b, np.uint64)]))
    for b in (_BASE, pow(_BASE, -1, 1 << 64))
]
_BYTE = np.random.default_rng(99).integers(0, 1 << 64, 256, np.uint64)
_KIND = 1 << 20


def _sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f (the least or greatest) of each n neighbours, of which it takes twice as many in each step."""
    have = 1
    while 2 * have <= n:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (n - have)], x[n - have :]) if n > have else x


def anchors(raw: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For texts laid end to end, in runs: places of anchors, their hashes, first and last place of their documents
    (last exclusive), and the documents' hashes."""
    starts = np.concatenate([[0], ends[:-1]])
    for a in range(0, len(raw), _CHUNK):  # chunks that stay in a processor's cache
        b = min(len(raw), a + _CHUNK)
        low, high = max(0, a - _REACH), min(len(raw), b + _REACH)
        part = raw[low:high]
        if len(part) < PASSAGE:
            continue
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWERS[0][: len(part)], out=total[1:])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * _POWERS[1][: len(part) - GRAM + 1])
        rank = np.maximum((grams >> np.uint64(32)).astype(np.uint32), 1)
        least = _sliding(rank, _STARTS, np.minimum)
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        bounds = np.clip(np.append(starts[first:last], ends[last - 1]) - low, 0, len(part))
        for e in np.unique(bounds).tolist():  # windows that reach over a text's end don't count
            least[max(0, e - PASSAGE + 1) : e] = 0
        pad = np.zeros(_STARTS - 1, np.uint32)
        most = _sliding(np.concatenate([pad, least, pad]), _STARTS, np.maximum)
        place = np.flatnonzero(most == rank)
        place = place[(place + low >= a) & (place + low < b)]
        text = np.searchsorted(ends, place + low, "right")
        left = np.maximum(place - _LEFT, starts[text] - low)
        right = np.minimum(place + LENGTH, ends[text] - low)
        shape = ((place - left) * 1024 + (right - place)).astype(np.uint64)
        document = mixed(mixed((total[right] - total[left]) * _POWERS[1][left]) + shape)
        yield place + low, grams[place], left + low, right + low, document


def _laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def _runs(texts: pd.Series, most: int = 2_000_000) -> Iterator[tuple[int, list[bytes]]]:
    run, size, start = [], 0, 0
    for i, t in enumerate(texts):
        run.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(run[-1])
        if size >= most:
            yield start, run
            run, size, start = [], 0, i + 1
    if run:
        yield start, run


def repeats(columns: np.ndarray, left: np.ndarray, right: np.ndarray, copies: np.ndarray) -> list[np.ndarray]:
    """For documents that stand in the rows of columns (bytes left to right of COLUMNS): in which of the first columns
    a string of LENGTH bytes starts that is in another document at the same place too, or in a copy of its own, and
    then the same of PASSAGE bytes."""
    n, lengths = len(columns), (LENGTH, PASSAGE)
    found = np.zeros((2, _STARTS, n), bool)
    order = np.arange(n)
    until = np.zeros(n, np.int64)  # where the common prefix with the neighbour before ends
    for c in range(COLUMNS - 1, -1, -1):
        symbol = columns[order, c].astype(np.int16)
        inside = (left[order] <= c) & (c < right[order])
        symbol[~inside] = -1
        by = np.argsort(symbol, kind="stable")
        before = np.concatenate([[0], by[:-1]])
        same = np.zeros(n, bool)
        same[1:] = (symbol[by[1:]] == symbol[by[:-1]]) & (symbol[by[1:]] >= 0)
        at = np.flatnonzero(same)
        fresh = np.full(n, c, np.int64)
        if len(at):
            spans = np.stack([before[at] + 1, by[at] + 1], 1).ravel()
            ends = np.minimum.reduceat(np.append(until, 0), spans)[::2]
            fresh[at] = np.maximum(ends, c + 1)
        order, until = order[by], fresh
        for kind, length in enumerate(lengths if c < _STARTS else ()):
            long = until - c >= length
            here = long.copy()
            here[:-1] |= long[1:]
            found[kind, c, order] = here
    column = np.arange(_STARTS)[:, None]
    again = (copies > 1) & (left <= column)
    return [(f | again & (column + length <= right)).T for f, length in zip(found, lengths, strict=True)]


def _values(found: list[np.ndarray], keys: np.ndarray) -> pd.DataFrame:
    """Rows key, value of each run of columns in which repeated strings start, first those of LENGTH, then of PASSAGE."""
    out = []
    for kind, f in enumerate(found):
        row, first, last = _spans(f)
        out.append(pd.DataFrame({"key": keys[row], "value": kind * _KIND + first * 1024 + last}))
    return pd.concat(out)


def _spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run in rows of booleans."""
    padded = np.zeros((len(found), found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    row, first = np.nonzero(change == 1)
    return row, first, np.nonzero(change == -1)[1] - 1


def repeated_strings(docs: DataFrame, text: str = "text") -> HashFiles:
    """From hashes of documents around anchors to their runs of columns in which repeated strings start."""
    texts = docs.select(F.col(text).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, run in _runs(b["text"]):
                for _, hashes, *_ in anchors(*_laid(run)):
                    key, n = np.unique(hashes, return_counts=True)
                    yield pd.DataFrame({"key": key.view(np.int64), "value": n})

    counts = texts.mapInPandas(anchored, "key bigint, value bigint").groupBy("key").agg(F.sum("value").alias("value"))
    known = HashFiles.written(counts.filter("value > 1"), size * 2 // _STARTS)
    shards = max(8, math.ceil(known.total * COLUMNS / COLLECTION))

    def documents(hot: bool):
        """The different documents of anchors that are hot, or of those that are not."""

        def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            times: dict[int, int] = {}
            for b in batches:
                for _, run in _runs(b["text"]):
                    raw, ends = _laid(run)
                    for place, hashes, left, right, document in anchors(raw, ends):
                        at, n = known.find(hashes.view(np.int64))
                        at = at[(n > HOT) == hot]
                        keys, first, n = np.unique(document[at].view(np.int64), return_index=True, return_counts=True)
                        seen = np.array([times.get(k, 0) for k in keys.tolist()], np.int64)
                        if len(times) > MOST_SEEN:
                            times.clear()
                        times.update(zip(keys.tolist(), (seen + n).tolist(), strict=True))
                        new = seen < 2
                        at, n, again = at[first][new], n[new], seen[new] > 0  # bytes go once, and no more copies than tell
                        yield pd.DataFrame({
                            "document": document[at].view(np.int64), "anchor": hashes[at].view(np.int64), "start": (_LEFT - (place[at] - left[at])).astype(np.int32),
                            "bytes": pd.Series([None if x else raw[y:z].tobytes() for x, y, z in zip(again, left[at], right[at], strict=True)], dtype=object), "copies": n,
                        })

        return texts.mapInPandas(made, "document bigint, anchor bigint, start int, bytes binary, copies bigint")

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        copies = rows.groupby("document")["copies"].sum()
        rows = rows[rows["bytes"].notna()].drop_duplicates("document")
        left = rows["start"].to_numpy(np.int64)
        right = left + np.array([len(x) for x in rows["bytes"]], np.int64)
        columns = np.zeros((len(rows), COLUMNS), np.uint8)
        for row, start, data in zip(columns, left, rows["bytes"], strict=True):
            row[start : start + len(data)] = np.frombuffer(data, np.uint8)
        found = repeats(np.asfortranarray(columns), left, right, copies[rows["document"]].to_numpy())
        return _values(found, rows["document"].to_numpy())

    pairs = "key bigint, value bigint"
    found = documents(hot=False).withColumn("shard", F.pmod("anchor", F.lit(shards))).repartition(shards, "shard").groupBy("shard").applyInPandas(build, pairs)
    if known.greatest > HOT:
        found = found.unionByName(_counted(documents(hot=True)))
    made = HashFiles.written(found, known.total)
    removed(docs.sparkSession, known.folder)
    return made


def _windows(document: bytes, anchor: int, start: int, length: int) -> np.ndarray:
    """Hashes of the strings of this length that start in the first columns of a document, with their anchor and column.
    Documents of a text overlap, but none of its strings is twice at the same anchor and column."""
    raw = np.frombuffer(document, np.uint8)
    n = min(max(0, len(raw) - length + 1), _STARTS - start)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POWERS[0][: len(raw)], out=total[1:])
    window = mixed((total[length : length + n] - total[:n]) * _POWERS[1][:n]) if n else np.zeros(0, np.uint64)
    place = np.uint64((anchor + length) % (1 << 64)) + (start + np.arange(n)).astype(np.uint64)
    return mixed(window + mixed(place)).view(np.int64)


def _counted(documents: DataFrame) -> DataFrame:
    """Runs of columns in which repeated strings start, by counting the strings of documents: counts meet before the
    shuffle, and repeated strings are looked up in files, so neither documents nor strings are brought together."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_windows(*x, n) for n in (LENGTH, PASSAGE) for x in zip(b["bytes"], b["anchor"], b["start"], strict=True)]
            copies = np.repeat(np.tile(b["copies"].to_numpy(), 2), [len(x) for x in made])
            key, back = np.unique(np.concatenate(made or [np.zeros(0, np.int64)]), return_inverse=True)
            yield pd.DataFrame({"key": key, "value": np.bincount(back, copies, len(key)).astype(np.int64)})

    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = documents.groupBy("document").agg(
        F.max("anchor").alias("anchor"), F.max("start").alias("start"), F.max("bytes").alias("bytes"), F.sum("copies").alias("copies")
    )
    once = checkpointed(once.filter("bytes is not null").repartition(parts, "document"))
    counts = once.mapInPandas(windows, "key bigint, value bigint").groupBy("key").agg(F.sum("value").alias("value"))
    again = HashFiles.written(counts.filter("value > 1"), once.count() * 2 * _STARTS)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for length in (LENGTH, PASSAGE):
                made = [_windows(*x, length) for x in zip(b["bytes"], b["anchor"], b["start"], strict=True)]
                row = np.repeat(np.arange(len(b)), [len(x) for x in made])
                column = np.concatenate([s + np.arange(len(x)) for s, x in zip(b["start"], made, strict=True)] or [np.zeros(0, np.int64)])
                at = again.find(np.concatenate(made or [np.zeros(0, np.int64)]))[0]
                found.append(np.zeros((len(b), _STARTS), bool))
                found[-1][row[at], column[at].astype(np.int64)] = True
            yield _values(found, b["document"].to_numpy())

    return once.mapInPandas(runs, "key bigint, value bigint")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, spans (array of start and end, in bytes, of maximal removed runs), kept (binary), passages (array of start
    and end) of each row: bytes covered by a string of LENGTH bytes that starts anywhere else too, in this text or another, are
    removed. Strings don't reach across texts and are judged on the texts as they are. Passages are covered by strings of
    PASSAGE bytes that start anywhere else too; they are told and not removed.

    A null text is an empty one; texts shorter than LENGTH stay whole; rows that repeat remove each other's bytes;
    an empty table gives an empty result. Kept bytes may cut a character in two."""
    found = repeated_strings(df, text)

    def edges(mask: np.ndarray) -> list[dict]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        return [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start, run in _runs(b["text"]):
                raw, ends = _laid(run)
                change = np.zeros((2, len(raw) + 1), np.int32)
                for place, _, _, _, document in anchors(raw, ends):
                    at, value = found.find(document.view(np.int64))
                    kind, value = value // _KIND, value % _KIND
                    first = place[at] - _LEFT + value // 1024
                    np.add.at(change, (kind, first), 1)
                    np.add.at(change, (kind, first + value % 1024 - value // 1024 + np.where(kind == 0, LENGTH, PASSAGE)), -1)
                gone, shared = np.cumsum(change[:, :-1], axis=1) > 0
                rows = []
                for e, t in zip(ends, run, strict=True):
                    own = slice(e - len(t), e)
                    spans = edges(gone[own])
                    rows.append((len(t), spans, raw[own][~gone[own]].tobytes() if spans else t, edges(shared[own])))
                out = pd.DataFrame(rows, columns=["n_bytes", "spans", "kept", "passages"])
                out.insert(0, "id", b["id"].iloc[start : start + len(run)].to_numpy())
                yield out

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind, pieces = rows.schema["id"].dataType.simpleString(), "{} array<struct<start: bigint, end: bigint>>"
    return rows.mapInPandas(cut, f"id {kind}, n_bytes bigint, {pieces.format("spans")}, kept binary, {pieces.format("passages")}")


