"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, built by range and merged.

A turn's id has 16 bytes, big-endian: 12 of a SHA-256 of its role and text, then the number of its text's bytes. A
conversation's key is its ids one after the other. Equal keys are counted first; the different ones are sorted by range
into shards, so that a very common first turn is split like any other keys. Each shard builds one adaptive radix tree.

Only the prefixes of a shard's first and last key can be in other shards too; these make its spine. All other nodes are
whole in their shard and are written at once. The spine goes on as two rows, a key each with what every depth of it has
gathered beside the spine: sums, so they add up where spines meet. Spines are sharded and merged in the same way, many
to a shard, until one shard is left, whose nodes are all whole. Texts are never moved.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared_files import new_folder, stored

#: Bytes of a turn's id, of which the last ones are its text's length.
WIDTH, LENGTH_BYTES = 16, 4
#: Different keys, and bytes of keys, of a shard on average; spine rows of one.
SHARD_KEYS, SHARD_BYTES, SHARD_SPINES = 40_000, 8 << 20, 4_000
#: Up to this many whole nodes of spines, they are broadcast to find parents.
BROADCAST = 50_000
_NONE = (1 << 63) - 1
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree: the bytes that lead to it from its parent (a compressed path), children by their
    first byte, and what is stored there. The children's layout grows with their number: up to 4 and up to 16 sorted
    bytes beside as many places, up to 48 places with an index of 256, then 256 places."""

    __slots__ = ("bytes", "path", "places", "value")

    def __init__(self, path: bytes):
        self.path, self.bytes, self.places, self.value = path, bytearray(), [], None

    def find(self, byte: int) -> Node | None:
        if len(self.places) == 256:
            return self.places[byte]
        if len(self.bytes) == 256:
            at = self.bytes[byte]
            return self.places[at - 1] if at else None
        at = bisect_left(self.bytes, byte)
        return self.places[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, child: Node) -> None:
        """Adds a child, or puts one in another's place."""
        if len(self.places) == 256:
            self.places[byte] = child
        elif len(self.bytes) == 256:
            at = self.bytes[byte]
            if at:
                self.places[at - 1] = child
            elif len(self.places) < 48:
                self.places.append(child)
                self.bytes[byte] = len(self.places)
            else:
                self.places = [self.places[x - 1] if x else None for x in self.bytes]
                self.places[byte] = child
        else:
            at = bisect_left(self.bytes, byte)
            if at < len(self.bytes) and self.bytes[at] == byte:
                self.places[at] = child
            elif len(self.bytes) < 16:
                self.bytes.insert(at, byte)
                self.places.insert(at, child)
            else:
                index = bytearray(256)
                for i, b in enumerate(self.bytes):
                    index[b] = i + 1
                self.bytes = index
                self.put(byte, child)

    def children(self) -> Iterator[Node]:
        """In order of their bytes."""
        if len(self.places) == 256 or len(self.bytes) < 256:
            yield from (x for x in self.places if x is not None)
        else:
            yield from (self.places[x - 1] for x in self.bytes if x)


def reach(node: Node, key: bytes, at: int, stop: int) -> Node:
    """The node at the first stop bytes of a key, made if it isn't there, from the node at its first at bytes."""
    while at < stop:
        child = node.find(key[at])
        if child is None:
            child = Node(key[at:stop])
            node.put(key[at], child)
            return child
        path = child.path
        n = min(len(path), stop - at)
        if key[at : at + n] != path[:n]:
            n = next(i for i in range(n) if key[at + i] != path[i])
        if n < len(path):  # the path is cut in two
            middle = Node(path[:n])
            child.path = path[n:]
            middle.put(path[n], child)
            node.put(path[0], middle)
            child = middle
        node, at = child, at + n
    return node


@dataclass
class _Flat:
    """Nodes at whole turns, parents before children: depth, parent's place (-1: none), digest of the prefix, bytes of the
    last turn's text, whether the node is of the spine of the first or the last key, and sums: members, least member,
    children, leaves and saved tokens of the subtree."""

    depth: list[int]
    parent: list[int]
    digest: list[bytes]
    text_bytes: list[int]
    first: list[bool]
    last: list[bool]
    sums: list[list[int]]


def _flattened(root: Node, first: bytes, last: bytes) -> _Flat:
    """The tree's nodes at byte depths that end a turn, those within compressed paths included."""
    out = _Flat([0], [-1], [hashlib.sha256().digest()[:16]], [0], [True], [True], [root.value or [0, _NONE, 0, 0, 0]])
    # node, its byte depth before its path, its last whole turn's place, hash up to there, bytes since, agreement with the first and last key
    open_ = [(c, 0, 0, hashlib.sha256(), b"", True, True) for c in root.children()]
    while open_:
        node, at, above, state, rest, on_first, on_last = open_.pop()
        path, end = node.path, at + len(node.path)
        data, base = rest + path, at - len(rest)
        state = state.copy() if len(data) >= WIDTH else state
        for i in range(WIDTH, len(data) + 1, WIDTH):
            turn = data[i - WIDTH : i]
            state.update(turn)
            stop = base + i
            on_first, on_last = on_first and first[stop - WIDTH : stop] == turn, on_last and last[stop - WIDTH : stop] == turn
            out.depth.append(stop // WIDTH)
            out.parent.append(above)
            above = len(out.depth) - 1
            out.digest.append(state.digest()[:16])
            out.text_bytes.append(int.from_bytes(turn[-LENGTH_BYTES:], "big"))
            out.first.append(on_first)
            out.last.append(on_last)
            out.sums.append(node.value if node.value and stop == end else [0, _NONE, 0, 0, 0])
        rest = data[len(data) - len(data) % WIDTH :] if len(data) % WIDTH else b""
        open_ += [(c, end, above, state, rest, on_first, on_last) for c in node.children()]
    return out


def _summed(flat: _Flat, whole: bool) -> None:
    """Adds each node's sums to its parent's, children first. Those of the spine are not ready, unless all is whole."""
    for i in range(len(flat.depth) - 1, -1, -1):
        if whole or not (flat.first[i] or flat.last[i]):
            own = flat.sums[i]
            if not own[2]:
                own[3] = 1
            own[4] += (own[0] - 1) * flat.text_bytes[i]
            if flat.parent[i] >= 0:
                up = flat.sums[flat.parent[i]]
                up[0] += own[0]
                up[1] = min(up[1], own[1])
                up[2] += 1
                up[3] += own[3]
                up[4] += own[4]


_SUMS = [f"s{i}" for i in range(5)]
_NODE = ["digest", "depth", "parent", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
#: Whole nodes (key null), and spines: a key, depths in turns and sums at each of them.
_OUT = pa.schema(
    [("digest", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), *[(c, pa.int64()) for c in _NODE[3:]], ("key", pa.binary()), ("depths", pa.list_(pa.int64()))]
    + [(c, pa.list_(pa.int64())) for c in _SUMS]
)
_OUT_DDL = "digest binary, depth bigint, parent binary, " + ", ".join(f"{c} bigint" for c in _NODE[3:]) + ", key binary, " + ", ".join(f"{c} array<bigint>" for c in ["depths", *_SUMS])


def _shard(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """The nodes and spines of one shard's rows (key, depths, sums)."""
    root, first, last = Node(b""), None, None
    for b in batches:
        for key, depths, *sums in zip(*(b.column(c).to_pylist() for c in ("key", "depths", *_SUMS)), strict=True):
            first, last = key if first is None else min(first, key), key if last is None else max(last, key)
            node, at = root, 0
            for depth, *own in zip(depths, *sums, strict=True):
                node, at = reach(node, key, at, depth * WIDTH), depth * WIDTH
                held = node.value
                node.value = own if held is None else [held[0] + own[0], min(held[1], own[1]), *(x + y for x, y in zip(held[2:], own[2:], strict=True))]
    if first is None:
        return
    flat = _flattened(root, first, last)
    _summed(flat, whole)
    spine = [not whole and (x or y) for x, y in zip(flat.first, flat.last, strict=True)]
    rows = []
    for i, (depth, up, s) in enumerate(zip(flat.depth, flat.parent, flat.sums, strict=True)):
        if not spine[i]:
            known = up >= 0 and not spine[up]
            rows.append((flat.digest[i], depth, flat.digest[up] if up >= 0 else None, s[1], flat.sums[up][1] if known else None, s[0], s[2], s[3], s[4]))
        if len(rows) >= 5_000:
            yield _batch(rows, [])
            rows = []
    paths = []
    if not whole:
        for key, own in ((first, flat.first), (last, [x and not y for x, y in zip(flat.last, flat.first, strict=True)])):
            at = sorted((flat.depth[i], i) for i, x in enumerate(own) if x)
            if at:
                paths.append((key[: at[-1][0] * WIDTH], [d for d, _ in at], *([flat.sums[i][j] for _, i in at] for j in range(5))))
    yield _batch(rows, paths)


def _batch(rows: list[tuple], paths: list[tuple]) -> pa.RecordBatch:
    a, b = list(zip(*rows, strict=True)) or [()] * len(_NODE), list(zip(*paths, strict=True)) or [()] * 7
    none = lambda n: [None] * n
    columns = [[*x, *none(len(paths))] for x in a] + [[*none(len(rows)), *x] for x in b]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal digits of a turn's id; a null role or text is an empty one."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    size = F.octet_length(text)
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(told, 1, 2 * (WIDTH - LENGTH_BYTES)), F.lpad(F.lower(F.hex(size)), 2 * LENGTH_BYTES, "0"))


def conversation_keys(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conv_id and ids (array of hexadecimal turn ids, in order of turns, null first; turns of equal number by their ids)."""
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), turn_id(F.col(role), F.col(text)).alias("id")).filter("conv_id is not null")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "id")))  # nulls come first
    return rows.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.col("t.id").alias("ids"))


def with_shared_starts(keys: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations rebuilt: the first h turns of the conversation c - c % every, then c's own turns after its first h,
    where h is the CRC-32 of c's decimal digits % most."""
    c = F.col("conv_id")
    starts = keys.filter(c % every == 0).select(c.alias("base"), F.slice("ids", 1, most - 1).alias("start"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    whole = keys.withColumn("base", c - c % every).join(starts, "base", "left").withColumn("h", h)
    none = F.array().cast("array<string>")
    own = F.when(F.size("ids") > F.col("h"), F.slice("ids", F.col("h") + 1, F.size("ids"))).otherwise(none)
    return whole.select("conv_id", F.concat(F.slice(F.coalesce("start", none), 1, F.col("h")), own).alias("ids"))


def member_digests(members: DataFrame) -> DataFrame:
    """digest and ends_sha256 of members(digest, conv_id): a SHA-256 of each digest's ids, decimal, ascending, joined by
    commas. Ids are sorted by range, so those of a very common digest are in many tasks, and each joins its own to pieces of
    a bounded number; one task then reads the pieces of a digest in order, one after the other, and never holds them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids = None, []

        def piece():
            return pa.RecordBatch.from_pydict({"digest": pa.array([held], pa.binary()), "first": [ids[0]], "text": [",".join(map(str, ids))]})

        for b in batches:
            for digest, conv_id in zip(b.column("digest").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (digest != held or len(ids) == 50_000):
                    yield piece()
                    ids = []
                held = digest
                ids.append(conv_id)
        if ids:
            yield piece()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, done = None, None, []
        row = lambda: (held, state.hexdigest())
        out = lambda: pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in done], pa.binary()), "ends_sha256": pa.array([x for _, x in done], pa.string())})
        for b in batches:
            for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                if state is not None and digest == held:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append(row())
                    held, state = digest, hashlib.sha256()
                state.update(text.encode())
            if len(done) >= 5_000:
                yield out()
                done = []
        if state is not None:
            done.append(row())
        yield out()

    sorted_ = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    joined = sorted_.select("digest", "conv_id").mapInArrow(pieces, "digest binary, first bigint, text string")
    return joined.repartition("digest").sortWithinPartitions("digest", "first").select("digest", "text").mapInArrow(hashed, "digest binary, ends_sha256 string")


def prefix_nodes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of
    conversations (conv_id, ids): each different sequence of the first d turns, from the root of none (d = 0). conv_id: the
    smallest member; n_leaves: nodes without children in the subtree; saved_tokens: the sum over the subtree of (members -
    1) times the bytes of a node's last text; ends_sha256: of the ids of members that end there.

    A conversation without turns is a member of the root; an empty table has no nodes. Different turns count as equal if 96
    bits of their digests and their lengths are equal. A conversation's ids (16 bytes a turn) have to fit into one value."""
    spark = rebuilt.sparkSession
    folder = new_folder(spark, "trie")
    key = F.unhex(F.array_join("ids", ""))
    members = stored(rebuilt.select("conv_id", key.alias("key")).withColumn("digest", F.substring(F.unhex(F.sha2("key", 256)), 1, 16)), folder, "members")
    keys = members.groupBy("digest").agg(F.first("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("m"))
    one = lambda c: F.array(F.col(c) if isinstance(c, str) else F.lit(c).cast("bigint"))
    depth = (F.octet_length("key") / WIDTH).cast("bigint")
    sums = [one("n"), one("m"), one(0), one(0), one(0)]
    rows = stored(keys.select("key", F.array(depth).alias("depths"), *[x.alias(c) for c, x in zip(_SUMS, sums, strict=True)]), folder, "keys")
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")) if n > 1_000 else 1, n // SHARD_KEYS, (size or 0) // SHARD_BYTES)
    nodes, spines, turn = [], [], 0
    while n:
        whole = shards == 1
        dealt = rows.repartition(1) if whole else rows.repartitionByRange(shards, "key")
        made = stored(dealt.mapInArrow(lambda b, whole=whole: _shard(b, whole), _OUT_DDL), folder, f"round{turn}")
        nodes.append(made.filter("key is null").select(*_NODE))
        if turn:
            spines.append(nodes[-1])
        if whole:
            break
        rows = made.filter("key is not null").select("key", "depths", *_SUMS)
        n, turn = rows.count(), turn + 1
        shards = -(-n // SHARD_SPINES)
    if not nodes:
        empty = spark.createDataFrame([], "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
        return empty
    found = nodes[0]
    for x in nodes[1:]:
        found = found.unionByName(x)
    if spines:  # parents that were not whole yet where their children were
        parents = spines[0]
        for x in spines[1:]:
            parents = parents.unionByName(x)
        parents = parents.select(F.col("digest").alias("parent"), F.col("conv_id").alias("of_parent"))
        if parents.limit(BROADCAST + 1).count() <= BROADCAST:
            parents = F.broadcast(parents)
        missing = F.col("parent_conv_id").isNull() & F.col("parent").isNotNull()
        told = found.filter(missing).join(parents, "parent").withColumn("parent_conv_id", F.col("of_parent"))
        found = found.filter(~missing).select(*_NODE).unionByName(told.select(*_NODE))
    ends = member_digests(members)
    return found.join(ends, "digest", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    )
