"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole, down to connected components.

Sets of like size make bands. In a band all shingles are hashed into segments. If the sets x and y are linked, they
differ in at most H = (1 - t)(|x| + |y|) / (1 + t) shingles (t: the least similarity), so of any H + 1 segments one
is equal in both. A set therefore sends hashes of H + 1 of its segments, and linked sets meet in one of them. Which
segments it sends is decided by cost, each kind in its turn where the one before does not yield enough:

1. segments with a rare shingle, equal in both; empty segments and those of common shingles alone are passed over,
   as they would bring together what is not alike;
2. segments twice as large with their one-deletion neighbourhoods, for segments that differ in one shingle at most:
   each counts double, so half as many will do;
3. segments that are not empty;
4. all segments.

If either of two linked sets has enough segments of a kind, they meet there; if neither has, both send the next kind.
Both send along a common order of segments, so sets stop where they have enough: the one that stops first has its
H + 1 segments within what the other has looked at.

What is common is estimated on a bounded sample and decides about cost only. Equal sets are one node from the start.

Signatures go out in two passes. The first sends parts of their hashes only, once for each set of a task, and keeps
those that come twice; nearly all come once and go no further. The second sends signatures that come twice with their
sets' nodes, and writes the sets that send any, with a bitmap of each set. Two bitmaps differ in at most as many bits as
their sets in shingles, so bitmaps tell most sets apart that meet without being linked; only those that may be linked
are read again, to be verified by their shingles.

Nodes that meet are verified against one leader of the place where they meet, the one with most copies, rather than
with each other. Only where different components still meet are sets compared with each other: within a cluster of
such nodes the sets outside of its largest component are compared with all others, in blocks, first by bitmaps and, where
these allow a link, by shingles. So large groups of near copies are linked without rows for all their pairs, and no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few_parts, let_go, small
from .components import components
from .hash_files import HashFiles, Repeated
from .shared_files import new_folder, removed, stored
from .words import mixed, texts_words

#: Rows of the sample that common shingles are taken from, sets that hold a common shingle there, and shingles at most.
SAMPLE, COMMON, MOST_COMMON = 4096, 3, 100_000
#: Up to this many rows of hashes or ids, they are broadcast.
BROADCAST = 100_000
#: A band's largest set by its smallest, and segments beyond H + 1.
BAND, SPARE = 1.4, 1.2
#: Shingles of a block in which sets are compared with each other, and of one in which their bitmaps are.
BLOCK, BITMAP_BLOCK = 400_000, 4_000_000
#: Parts of signatures that a task sends together, those of a shard on average, and nodes that a task remembers.
FLUSH, SHARD, MOST_SEEN = 500_000, 8_000_000, 100_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Sets:
    """Shingles of a batch of texts, without repeats: doc (place in the batch) and token, sorted; first place and
    size by text; node, a hash of the whole set."""

    doc: np.ndarray
    token: np.ndarray
    size: np.ndarray
    first: np.ndarray
    node: np.ndarray


def shingle_sets(texts: list[str | None], k: int) -> Sets:
    words, counts = texts_words(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    of = np.repeat(np.arange(len(counts)), counts)
    doc, token = [], []
    for n in range(1, k + 1):  # texts of n < k words have one shingle of n words
        at = np.flatnonzero(np.arange(len(words)) + k <= ends[of]) if n == k else starts[counts == n]
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = mixed(h * _ODD[j] + words[at + j])
        doc.append(of[at])
        token.append(h)
    doc, token = np.concatenate(doc), np.concatenate(token)
    order = np.lexsort((token, doc))
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    size = np.bincount(doc, minlength=len(counts))
    first = np.cumsum(size) - size
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(token ^ _ODD[63]))])
    node = mixed(total[first + size] - total[first] + size.astype(np.uint64) * _ODD[62])
    return Sets(doc, token, size, first, node)


class Bands:
    """Sizes in bands for a least similarity of percent / 100."""

    def __init__(self, percent: int, largest: int = 1 << 31):
        self.percent = percent
        edges = [1]
        while edges[-1] <= largest * 100 // percent + 1:
            edges.append(max(edges[-1] * 100 // percent + 1, int(edges[-1] * BAND)))
        self.edges = np.array(edges)
        top = self.edges[1:] - 1
        #: Segments of a band.
        self.segments = (np.ceil((self.differ(top, top) + 1) * SPARE) + 1).astype(np.int64)

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many shingles linked sets of these sizes differ at most."""
        return (100 - self.percent) * (x + y) // (100 + self.percent)

    def uses(self, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Sets, band, and number of segments that must be sent: each set in its own band, and in the next one if
        larger sets there can be linked with it. Sets that only equal ones are linked with are left out."""
        own = np.searchsorted(self.edges, size, "right") - 1
        most = size * 100 // self.percent
        top = self.edges[own + 1] - 1
        ok = np.flatnonzero((size > 0) & (self.differ(size, most) > 0))
        for at, band, partner in ((ok, own, np.minimum(most, top)), (ok[most[ok] > top[ok]], own + 1, most)):
            yield at, band[at], self.differ(size[at], partner[at]) + 1


def _signatures(sets: Sets, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and signature of all segments that texts send."""
    place = np.minimum(np.searchsorted(common, sets.token), max(0, len(common) - 1))
    rare = common[place] != sets.token if len(common) else np.ones(len(sets.token), bool)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for at, band, need in bands.uses(sets.size):
        for kind in (1, 2, 3, 4):
            if len(at):
                at, band, need = _send(sets, bands, rare, kind, at, band, need, out)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _send(sets, bands, rare, kind, at, band, need, out):
    """Appends what the texts at these places send of a kind; returns those that don't have enough of it."""
    segments = bands.segments[band] if kind != 2 else (bands.segments[band] + 1) // 2
    goal = need if kind != 2 else (need + 1) // 2
    n = sets.size[at]
    own = np.repeat(np.arange(len(at)), n)
    items = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sets.first[at], n)
    token, is_rare = sets.token[items], rare[items]
    salt = mixed(band.astype(np.uint64) * np.uint64(8) + np.uint64(kind))
    segment = (mixed(token ^ salt[own]) % segments[own].astype(np.uint64)).astype(np.int64)
    base = np.cumsum(segments) - segments
    cell = base[own] + segment
    cells = int(segments.sum())
    order = np.argsort(cell, kind="stable")
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(token[order] + np.uint64(kind)))])
    held = np.bincount(cell, minlength=cells)
    stop = np.cumsum(held)
    content = total[stop] - total[stop - held]
    rares = np.bincount(cell[is_rare], minlength=cells)
    sent = {1: rares > 0, 2: rares > 0, 3: held > 0, 4: np.ones(cells, bool)}[kind]
    good = {1: sent, 2: rares > 1, 3: sent, 4: sent}[kind]
    unit = np.repeat(np.arange(len(at)), segments)
    so_far = np.concatenate([[0], np.cumsum(good)])
    before = so_far[:-1] - so_far[base][unit]  # good segments of the text before this one
    sent &= before < goal[unit]
    here = np.flatnonzero(sent)
    key = mixed(salt[unit[here]] * _ODD[40] + (here - base[unit[here]]).astype(np.uint64) * _ODD[41])
    out.append((at[unit[here]], mixed(key + content[here] + held[here].astype(np.uint64) * _ODD[42])))
    if kind == 2:
        cell_at, token_at, rare_at = cell[order], token[order], is_rare[order]
        keys = np.zeros(cells, np.uint64)
        keys[here] = key
        d = np.flatnonzero(sent[cell_at] & (rares[cell_at] > rare_at))  # what stays has a rare shingle
        c = cell_at[d]
        rest = content[c] - mixed(token_at[d] + np.uint64(kind))
        out.append((at[unit[c]], mixed(keys[c] + rest + (held[c] - 1).astype(np.uint64) * _ODD[42])))
    enough = np.add.reduceat(good, base) >= goal
    return at[~enough], band[~enough], need[~enough]


def _runs(texts: pd.Series, most: int = 300_000) -> Iterator[slice]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def shingle_keys(df: DataFrame, k: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text_hash, n_shingles and node (a 64-bit hash of the set of shingles) of each row."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for run in _runs(b["text"]):
                s = shingle_sets(list(b["text"].iloc[run]), k)
                own = b[["id", "text_hash"]].iloc[run].reset_index(drop=True)
                yield own.assign(n_shingles=s.size, node=s.node.view(np.int64))

    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(keys, f"id {kind}, text_hash bigint, n_shingles bigint, node bigint")


def _common(texts: DataFrame, n: int, k: int) -> np.ndarray:
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for run in _runs(b["text"]):
                s = shingle_sets(list(b["text"].iloc[run]), k)
                yield pd.DataFrame({"token": s.token.view(np.int64), "node": s.node[s.doc].view(np.int64)})

    picked = texts.sample(min(1.0, SAMPLE / max(1, n)), seed=5)
    found = (
        picked.mapInPandas(tokens, "token bigint, node bigint").groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
        .filter((F.col("n") >= COMMON) & (F.col("a") != F.col("b"))).orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token")
    )
    return np.sort(np.array([r[0] for r in found.collect()], np.int64).view(np.uint64))


def jaccard_components(
    df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """id, text_hash, n_shingles, root, component_id of each row of df: words in lower case (A-Z) give a set of k-word shingles
    (a text of fewer words: one shingle of all), two rows are linked when 100 * |x & y| >= percent * |x | y|, and a
    component's id is the smallest id in it (root: the smallest hash of its sets).

    Null and empty texts have no shingles and are linked with nothing, nor are null ids smaller than others; rows that
    repeat are linked as equal sets. An empty table gives an empty result. Shingles are compared by 64-bit hashes."""
    spark = df.sparkSession
    folder = new_folder(spark, "jaccard")
    rows = stored(shingle_keys(df, k, id_col, text), folder, "rows")
    texts = df.select(F.col(text).alias("text"))
    n, shingles = rows.agg(F.count(F.lit(1)), F.sum("n_shingles")).first()
    nodes = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    known = spark.sparkContext.broadcast((Bands(percent), _common(texts, n, k)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (shingles or 0) // SHARD + 1)
    again = Repeated.written(_sent(texts, k, known, shards), shards)
    met = stored(_meeting(texts, k, known, again), folder, "meeting")
    removed(spark, again.folder)
    wanted = lambda nodes, name: _tokens(texts, rows, nodes, k, folder, name)
    linked = stored(_linked(met, wanted, percent, folder), folder, "linked")
    for name in ("meeting", *_STEPS):
        removed(spark, f"{folder}/{name}")
    copies = nodes.join(linked, "node", "left").filter("copies > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "least")
    found = stored(copies, folder, "found")
    component = found.groupBy("root").agg(F.min("least").alias("component"))
    size = found.count()
    if size <= BROADCAST:
        found = few_parts(found, size).join(few_parts(component, size), "root")
    else:
        found = found.join(component, "root")
    found = stored(found.select(F.col("node").alias("found"), "root", "component"), folder, "components")
    if size <= BROADCAST:
        found = F.broadcast(found)
    same = (F.col("node") == F.col("found")) & (F.col("n_shingles") > 0)
    return rows.join(found, same, "left").select(
        "id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root"), F.coalesce("component", "id").alias("component_id")
    )


def _sent(texts: DataFrame, k: int, known, shards: int) -> DataFrame:
    """Parts of the signatures of all texts, each node's once for each task, packed for their shards."""

    def sends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held, n = [], 0
        for b in batches:
            for run in _runs(b["text"]):
                s = _once(shingle_sets(list(b["text"].iloc[run]), k), seen)
                held.append(_signatures(s, *known.value)[1])
                n += len(held[-1])
                if n >= FLUSH:
                    yield Repeated.packed(np.concatenate(held), shards)
                    held, n = [], 0
        if n:
            yield Repeated.packed(np.concatenate(held), shards)
        let_go()

    return texts.mapInPandas(sends, "shard int, keys binary")


def _values(found: list) -> pd.Series:
    """A column of arrays or bytes. Without a kind named, pandas takes one without rows for a column of floats, which Arrow
    does not turn into the column that is due."""
    return pd.Series(found, dtype=object)


def _once(s: Sets, seen: set[int]) -> Sets:
    """The sets without those whose node stands before or has been seen, as if these were empty."""
    fresh = np.zeros(len(s.node), bool)
    for i, node in enumerate(s.node.tolist()):
        if node not in seen:
            seen.add(node)
            fresh[i] = True
    if len(seen) > MOST_SEEN:
        seen.clear()
    return Sets(s.doc, s.token, np.where(fresh, s.size, 0), s.first, s.node)


def _bitmaps(s: Sets, at: np.ndarray) -> list[bytes]:
    """Of each set at these places a bit for each shingle by its hash, in the least power of two of bits that is at
    least twice the set's size."""
    size = s.size[at]
    bits = (1 << np.ceil(np.log2(np.maximum(2 * size, 64))).astype(np.int64)).astype(np.int64)
    base = np.cumsum(bits) - bits
    own = np.repeat(np.arange(len(at)), size)
    items = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s.first[at], size)
    marked = np.zeros(int(bits.sum()), bool)
    marked[base[own] + (mixed(s.token[items] ^ _ODD[50]) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)] = True
    packed = np.packbits(marked, bitorder="little").tobytes()
    return [packed[x // 8 : (x + n) // 8] for x, n in zip(base.tolist(), bits.tolist(), strict=True)]


def _folded(x: np.ndarray) -> np.ndarray:
    """Bitmaps (rows of words) in half as many bits."""
    half = x.shape[-1] // 2
    return x[..., :half] | x[..., half:]


def _may_link(differ: np.ndarray, m: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of m and n shingles that differ in at least so many may be linked."""
    return np.maximum(differ, np.abs(m - n)) * (100 + percent) <= (100 - percent) * (m + n)


def _meeting(texts: DataFrame, k: int, known, again: Repeated) -> DataFrame:
    """node, copies, n, signatures, bitmap: sets that send signatures that are sent twice, how many texts of a run have
    them, their size, and, where a task sees a node first, their bitmap."""

    def meets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            for run in _runs(b["text"]):
                s = shingle_sets(list(b["text"].iloc[run]), k)
                _, back, copies = np.unique(s.node, return_inverse=True, return_counts=True)
                doc, signature = _signatures(_once(s, set()), *known.value)
                hit = again.holds(signature)
                doc, signature = doc[hit], signature[hit]
                order = np.argsort(doc, kind="stable")
                doc, signature = doc[order], signature[order].view(np.int64)
                at, first = np.unique(doc, return_index=True)
                new = _once(Sets(s.doc, s.token, s.size[at], s.first[at], s.node[at]), seen).size > 0
                bitmaps = iter(_bitmaps(s, at[new]))
                signatures = np.split(signature, first[1:]) if len(at) else []
                yield pd.DataFrame({
                    "node": s.node[at].view(np.int64), "copies": copies[back[at]], "n": s.size[at],
                    "signatures": _values(signatures), "bitmap": _values([next(bitmaps) if x else None for x in new]),
                })
        let_go()

    return texts.mapInPandas(meets, "node bigint, copies bigint, n bigint, signatures array<bigint>, bitmap binary")


def _tokens(texts: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, folder: str, name: str) -> DataFrame:
    """node and tokens of these nodes (a column node, stored), read from the texts again. A file of the hashes of one
    text of each node tells which texts to take, so the others are neither shuffled nor cut to shingles."""
    n = nodes.count()
    picked = rows.join(F.broadcast(nodes) if n <= BROADCAST else nodes, "node").groupBy("node").agg(F.min("text_hash").alias("key"))
    wanted = HashFiles.written(picked.select("key", F.col("node").alias("value")), n)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            at, node = wanted.find(b["text_hash"].to_numpy(np.int64))
            for run in _runs(b["text"].iloc[at]):
                s = shingle_sets(list(b["text"].iloc[at[run]]), k)
                right = s.node == node[run].view(np.uint64)
                s = _once(Sets(s.doc, s.token, np.where(right, s.size, 0), s.first, s.node), seen)
                found = np.flatnonzero(s.size)
                made = [s.token[s.first[i] : s.first[i] + s.size[i]].tobytes() for i in found]
                yield pd.DataFrame({"node": s.node[found].view(np.int64), "tokens": _values(made)})

    hashed = texts.select("text", F.xxhash64("text").alias("text_hash"))
    read_again = stored(hashed.mapInPandas(read, "node bigint, tokens binary"), folder, name)
    removed(texts.sparkSession, wanted.folder)
    return read_again.groupBy("node").agg(F.first("tokens").alias("tokens"))


def drop_near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component of jaccard_components: the one with the smallest id (null last; of several
    such, the one with the smallest text hash; of rows that also repeat id and text, any one). Rows without words all
    stay. Columns stay as they are."""
    rows = checkpointed(jaccard_components(df, k, percent, id_col, text).filter("n_shingles > 0"))
    first = F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("text_hash"))
    groups = rows.groupBy("root").agg(F.min(first).alias("kept"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = rows.join(groups.select("root", "kept"), "root").withColumn("stays", first == F.col("kept"))
    by_text = members.groupBy("id", "text_hash").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("rows"))
    verdicts = checkpointed(by_text.filter("not stays or rows > 1").select(F.col("id").alias("i"), F.col("text_hash").alias("h"), "stays"))
    if small(verdicts, BROADCAST):
        verdicts = F.broadcast(verdicts)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(text).alias("text_hash"))
    same = F.col(f"row.`{id_col}`").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h"))
    kept = whole.join(verdicts.filter("not stays"), same, "left_anti")
    repeated = verdicts.filter("stays")
    once = kept.join(repeated, same, "left_semi").withColumn("id", F.col(f"row.`{id_col}`")).dropDuplicates(["id", "text_hash"])
    return kept.join(repeated, same, "left_anti").select("row.*").unionByName(once.select("row.*"))


#: Folders that _linked writes and that nothing needs after it.
_STEPS = (
    "places", "bitmaps", "leaders", "pairs", "nodes", "tokens", "near", "roots", "at", "still", "rest", "clusters", "rooted", "clustered",
    "possible", "possible tokens", "compared",
)


def _compared(pairs: DataFrame, sets: DataFrame, data: str, linked) -> DataFrame:
    """Those of the pairs (a, b) for which linked(x, y) is true of the data (bytes) of their sets (node, n, data)."""

    def meets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.loc[[linked(x, y, m, n) for x, y, m, n in zip(b["x"], b["y"], b["m"], b["n"], strict=True)], ["a", "b"]]
        let_go()

    x = sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col(data).alias("x"))
    y = sets.select(F.col("node").alias("b"), "n", F.col(data).alias("y"))
    return pairs.join(y, "b").join(x, "a").mapInPandas(meets, "a bigint, b bigint")


def _linked(met: DataFrame, tokens, percent: int, folder: str) -> DataFrame:
    """node, root of all nodes with links, from the sets that meet; tokens(nodes, name) gives nodes with their tokens."""

    def may_link(x: bytes, y: bytes, m: int, n: int) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        while len(x) != len(y):
            x, y = (_folded(x), y) if len(x) > len(y) else (x, _folded(y))
        return bool(_may_link(np.bitwise_count(x ^ y).sum(dtype=np.int64), m, n, percent))

    def link(x: bytes, y: bytes, m: int, n: int) -> bool:
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = int((x[np.minimum(np.searchsorted(x, y), m - 1)] == y).sum())
        return 100 * both >= percent * (m + n - both)

    sent = met.select("node", "copies", F.explode("signatures").alias("signature"))
    places = stored(sent.groupBy("signature", "node").agg(F.sum("copies").alias("copies")), folder, "places")
    bitmaps = met.filter("bitmap is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    bitmaps = stored(bitmaps, folder, "bitmaps")
    leader = F.min_by("node", F.struct(-F.col("copies"), F.xxhash64("node"))).alias("leader")
    leaders = places.groupBy("signature").agg(leader, F.min("node").alias("low"), F.max("node").alias("high"))
    leaders = stored(leaders.filter("low <> high").select("signature", "leader"), folder, "leaders")
    near = places.join(leaders, "signature").filter("node <> leader")
    pairs = near.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    pairs = stored(_compared(pairs, bitmaps, "bitmap", may_link), folder, "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    members = tokens(stored(nodes, folder, "nodes"), "tokens")
    near = stored(_compared(pairs, members.withColumn("n", (F.octet_length("tokens") / 8).cast("bigint")), "tokens", link), folder, "near")
    roots = stored(components(near), folder, "roots")
    at = places.join(leaders, "signature").join(roots, "node", "left").select("signature", "node", "leader", F.coalesce("root", "node").alias("root"))
    at = stored(at, folder, "at")
    still = at.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("signature")
    still = stored(at.join(still, "signature").select("node", "leader", "root").distinct(), folder, "still")
    rest = stored(_between(still, bitmaps, tokens, percent, folder), folder, "rest")
    return components(near.unionByName(rest))


def _between(still: DataFrame, bitmaps: DataFrame, tokens, percent: int, folder: str) -> DataFrame:
    """Links a, b between nodes of different roots, enough to join all roots that are linked, among the nodes that meet
    where roots meet, from still(node, leader, root). Nodes that meet, through others too, make a cluster. Its sets are
    compared by bitmaps; those that may be linked with a set of another root are compared by shingles."""
    clusters = stored(components(still.select(F.col("node").alias("a"), F.col("leader").alias("b"))), folder, "clusters")
    clusters = clusters.withColumnRenamed("root", "cluster")
    rooted = stored(still.select("node", "root").distinct().join(clusters, "node"), folder, "rooted")
    rows = stored(bitmaps.join(rooted, "node"), folder, "clustered")

    def possible(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = [_possible(x, y, percent) for x, y in _sides(key, part)]
        return pd.DataFrame({"node": np.concatenate(found or [np.zeros(0, np.int64)])})

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found = [link for x, y in _sides(key, part) for link in _joining(x, y, percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keys = ("task", "whole", "i", "j")
    nodes = _dealt(rows, BITMAP_BLOCK).groupBy(*keys).applyInPandas(possible, "node bigint").distinct()
    nodes = stored(nodes, folder, "possible")
    of_nodes = rows.drop("bitmap").join(tokens(nodes, "possible tokens"), "node")
    return _dealt(stored(of_nodes, folder, "compared"), BLOCK).groupBy(*keys).applyInPandas(join, "a bigint, b bigint")


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows(cluster, node, root, n, ..) of clusters of several roots, as often as they are compared, with task, whole, i, j:
    a cluster's largest root makes blocks of about size shingles on one side and all other roots on another. Each block of
    others meets each block, so sets that are of the largest root all are not compared with each other. Clusters of
    one block of either kind go whole, several to a task."""
    spark = rows.sparkSession
    of_root = rows.groupBy("cluster", "root").agg(F.sum("n").alias("n"))
    sizes = of_root.groupBy("cluster").agg(
        F.max_by("root", F.struct("n", "root")).alias("top"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("roots")
    ).filter("roots > 1").select(
        "cluster", "top", F.ceil(F.col("most") / size).cast("int").alias("tops"), F.ceil((F.col("all") - F.col("most")) / size).cast("int").alias("others")
    )
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (2 * size) + 1)
    is_top, number = F.col("root") == F.col("top"), F.xxhash64("node")
    whole = (F.col("tops") == 1) & (F.col("others") == 1)
    block = F.when(is_top, F.pmod(number, F.col("tops"))).otherwise(F.col("tops") + F.pmod(number, F.col("others"))).cast("int")
    every = F.sequence(F.when(is_top, F.col("tops")).otherwise(F.lit(0)), F.col("tops") + F.col("others") - 1)
    return rows.join(sizes, "cluster").withColumn("block", block).withColumn("other", F.explode(F.when(whole, F.array(F.lit(1))).otherwise(every))).select(
        *rows.columns, "block", whole.alias("whole"), F.when(whole, F.pmod(F.xxhash64("cluster"), F.lit(buckets))).otherwise(F.col("cluster")).alias("task"),
        F.when(whole, 0).otherwise(F.least("block", "other")).alias("i"), F.when(whole, 0).otherwise(F.greatest("block", "other")).alias("j"),
    )


def _sides(key: tuple, part: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """The blocks that meet in a task, by cluster."""
    _, whole, i, j = key
    for _, c in part.groupby("cluster", sort=True):
        if c["root"].nunique() > 1:
            c = c.sort_values("node")
            yield (c, c[c["block"] > 0]) if whole else (c[c["block"] == i], c[c["block"] == j])


def _possible(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> np.ndarray:
    """Nodes of x and y that may be linked with a node of the other that has another root, by their bitmaps."""
    found, classes = set(), {}
    for width, c in y.groupby(y["bitmap"].map(len)):
        rows = np.frombuffer(b"".join(c["bitmap"]), np.uint64).reshape(len(c), -1)
        classes[width // 8] = rows, _folded(rows) if rows.shape[1] > 1 else rows, c["n"].to_numpy(), c["root"].to_numpy(), c["node"].to_numpy()
    for node, root, n, bitmap in zip(x["node"], x["root"], x["n"], x["bitmap"], strict=True):
        own = np.frombuffer(bitmap, np.uint64)
        for words, (rows, folded, sizes, roots, nodes) in classes.items():  # sizes of linked sets are within one class
            if words == len(own):
                differ = np.bitwise_count(rows ^ own)
            elif words == 2 * len(own):
                differ = np.bitwise_count(folded ^ own)
            elif 2 * words == len(own):
                differ = np.bitwise_count(rows ^ _folded(own))
            else:
                continue
            hit = _may_link(differ.sum(1, dtype=np.int64), n, sizes, percent) & (roots != root)
            if hit.any():
                found.add(node)
                found.update(nodes[hit].tolist())
    return np.array(sorted(found), np.int64)


def _joining(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between sets of x and of y with different roots, one for each join of roots."""
    sets = [[np.frombuffer(t, np.uint64) for t in side["tokens"]] for side in (x, y)]
    sizes = [np.array([len(t) for t in side]) for side in sets]
    if not len(sizes[0]) or not len(sizes[1]):
        return []
    tokens = [np.concatenate(side) for side in sets]
    shared = np.intersect1d(*(np.unique(t) for t in tokens))
    both = np.zeros((len(x), len(y)), np.float32)
    rows = [np.repeat(np.arange(len(n)), n) for n in sizes]
    for at in range(0, len(shared), 4096):
        chunk = shared[at : at + 4096]
        held = []
        for t, r, n in zip(tokens, rows, sizes, strict=True):
            place = np.minimum(np.searchsorted(chunk, t), len(chunk) - 1)
            hit = chunk[place] == t
            m = np.zeros((len(n), len(chunk)), np.float32)
            m[r[hit], place[hit]] = 1
            held.append(m)
        both += held[0] @ held[1].T
    either = sizes[0][:, None] + sizes[1][None] - both
    root_x, root_y = x["root"].to_numpy(), y["root"].to_numpy()
    i, j = np.nonzero((100 * both >= percent * either) & (root_x[:, None] != root_y[None]))
    pairs = np.sort(np.stack([root_x[i], root_y[j]]), axis=0)
    _, first = np.unique(pairs, axis=1, return_index=True)
    parent: dict[int, int] = {}

    def find(r: int) -> int:
        while parent.get(r, r) != r:
            r = parent[r]
        return r

    found, node_x, node_y = [], x["node"].to_numpy(), y["node"].to_numpy()
    for k in first:
        p, q = find(int(root_x[i[k]])), find(int(root_y[j[k]]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            found.append((int(node_x[i[k]]), int(node_y[j[k]])))
    return found
